"""Personal data: the digest against the plain patterns, hard texts, and the field on sentences it has not seen."""

import hashlib
import random
import re
import time

import pytest

from postflock.llm import pii
from tests.llm.helpers import documents, odd_texts

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _digits(s):
    return [int(c) for c in s if c in "0123456789"]


def _luhn(digits):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(digits))) % 10 == 0


KEEP = {
    "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
    "card": lambda s: 16 <= len(_digits(s)) <= 19 and _luhn(_digits(s)), "phone": lambda s: 8 <= len(_digits(s)) <= 15,
}


def _base(text):
    return [(k, *m.span()) for k, p in PLAIN.items() for m in p.finditer(text or "") if KEEP[k](m.group())]


def _random_texts():
    rng = random.Random(7)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+44 20 7946 0958", "+1(555)0100.", "1.2.3.4", "256.1.1.1", "01.02.03.004.5",
             "a@b.c", "x.y%z@host-1.example.org", "@", ".", "-", " ", "  ", "7", "0", "é", "\n", "+", "(", "1234567890123456789", "a", "@@b.c"]
    return [(i, "".join(rng.choices(parts, k=rng.randint(0, 14)))) for i in range(400)]


@pytest.mark.parametrize("rows", [odd_texts() + _random_texts() + [
    (900, "0" * 399 + "1.2.3.4"), (901, "0" * 600 + "255." + "0" * 500 + ".1.0"), (902, "1" * 500 + ".1.1.1")], []])
def test_digest_is_that_of_the_plain_patterns(spark, rows):
    found = pii.digest(documents(spark, rows)).collect()
    expected = []
    for doc, text in rows:
        base = _base(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        expected.append((doc, *(sum(s[0] == k for s in base) for k in pii.KINDS), hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted(expected, key=str)
    spans = {(r.doc_id, r.base_sha256): r.spans for r in found}
    for doc, text in rows:
        base = [f"{k}:{a}:{b}" for k, a, b in _base(text)]
        key = doc, hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(spans[key].split(","))
        rest = [s.split(":") for s in set(spans[key].split(",")) - set(base) - {""}]
        assert not any(int(a) < y and int(b) > x for _, a, b in rest for _, x, y in _base(text))


@pytest.mark.parametrize("text", [
    "1" * 1_000_000, "(at)" * 250_000, "(at) " * 100_000, "a(at)b(dot)" * 90_000, "x" * 1_000_000 + "@b.c", "5" + " " * 1_000_000 + "6",
    "1." * 300_000, "a@" * 300_000, "a" * 1_000_000 + "@", "[(" * 400_000])
def test_hard_texts_take_seconds(text):
    field, began = pii.train(), time.time()
    pii.find([text], field)
    assert time.time() - began < 20


def test_features_read_whole_words():
    long = "x" * 300
    first, = pii.segments(f"{long}a {' ' * 200} 7 {' ' * 200} after")[0].features
    assert f"bw={long}a" in first and "b=x" in first and "a=x" in first
    assert pii.shape("a" * 70 + "@b.c") == "x@x.x"


def test_spelt_addresses_by_marks():
    for text, covered in (
        ("mail jane (at) mail (dot) org now", "jane (at) mail (dot) org"), ("x jo(at)host(dot)de.", "jo(at)host(dot)de."),
        ("a.b [at] c [punkt] d [punkt] e f", "a.b [at] c [punkt] d [punkt] e"), ("look (at) this", ""), ("(at) x (dot) y", ""),
        ("me (at) x(dot) org yes", "me (at) x(dot) org"), ("me (at) x (dot)org yes", "me (at) x (dot)org"), ("me (at) x (dot)", "")):
        places = pii.spelt_places(text)
        assert (text[places[0][0]:places[-1][1]] if places else "") == covered


#: Sentences that the field has not seen.
UNSEEN = (
    "please ring [phone 020 7123 4567] after lunch", "mail me: [email tom (at) inbox (dot) net] thanks",
    "Tel. [phone 0043 1 5880] extension", "call [phone (212) 555-0134] or come by", "my card is [card 5500 0000 0000 0004]",
    "write to [email eva.k (at) schule (dot) at] soon", "version 2.4.1 came out on 12.03.2021", "they won 4-2 in 1998",
    "room 204 is on floor 3", "phone [phone 555-0123-99] please", "see pages 12-19 and 40", "kontakt [email info (at) firma (dot) de]",
    "it costs 1,200.50 in 2024", "reach [phone 07700 900456] at night", "the ratio was 3:1 at 10:45", "order 20231105 was sent",
    "llame al [phone 600 123 456] por favor", "[email ana (arroba) correo (punto) es] es mi correo")


def test_field_on_unseen_sentences():
    field, right, found, true = pii.train(), 0, 0, 0
    for marked in UNSEEN:
        text, gold = pii.parse(marked)
        spans = pii.field_spans([text], field)[0]
        right, found, true = right + len(set(spans) & set(gold)), found + len(spans), true + len(gold)
    print(f"field: precision {right}/{found}, recall {right}/{true}")
    assert right >= 0.7 * found and right >= 0.7 * true
