"""Personal data in texts: fixed patterns, and a linear-chain conditional random field for other spellings.

The field labels tokens (runs without white space) by the shapes of a token and its neighbours. It is trained
from the small labelled table below, and decoded by Viterbi over batches of segments in numpy. Only a token
with a digit or an ``@``, or one in a spelt-out address such as ``jane (at) mail (dot) org``, may carry a label
other than "none"; every other token's label is known and cuts the chain, so decoding the runs of open tokens
one by one gives the best labelling of the whole text. Spans that the patterns found stay; spans of the field
that meet one of them are dropped.
"""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from postflock.llm.common import bound_batches, texts

KINDS = ("email", "ip", "card", "phone")
#: Labelled sentences: [kind text] marks a span. Fixed training data of the field.
LABELLED = (
    "write to [email jane.doe@example.org] or call [phone +44 20 7946 0958] today",
    "mail [email kim@host.example.com], please",
    "reach me at [email j_smith (at) mail (dot) example (dot) org] any time",
    "kontakt: [email anna (at) posten (dot) de] oder [phone 030 901820]",
    "[email root@localhost] is the sender of 12 messages",
    "contact [email maria.lopez (at) correo (dot) es] for details",
    "the user@ part is empty and @home is a tag",
    "follow @someone and @another since 2019",
    "phone [phone (555) 201-4477] between 9 and 17",
    "tel. [phone 555-201-4477] or [phone 555.201.4478]",
    "call [phone 020 7946 0958] before 12:30",
    "Tel: [phone 0049 30 901820]",
    "fax [phone +1 212 555 0199], room 401",
    "her number is [phone 07700 900123] she said",
    "call [phone 1-800-555-0199] now",
    "card [card 4111 1111 1111 1111] expires 12/27",
    "pay with [card 4111-1111-1111-1111] or cash",
    "amex [card 3782 822463 10005] was charged 45.00",
    "card number [card 378282246310005] is on file",
    "visa [card 5500000000000004] declined",
    "server [ip 10.0.0.12] answered in 35 ms",
    "from [ip 192.168.1.254:8080] to [ip 172.16.0.1/24]",
    "address [ip fe80::1ff:fe23:4567:890a] is local",
    "host [ip 2001:db8::ff00:42:8329] is down",
    "in 2020 there were 3,000 cases and 45% more in 2021",
    "version 2.0.1 and 10.4 were released on 2021-03-04",
    "see section 4.2.1 on page 17",
    "the total is 1,250.00 euros for 3 items",
    "CC BY-NC 4.0 licence and Apache 2.0",
    "born 1984 in room 12b at 10:45",
    "order 99812 of 2023-11-05 shipped",
    "ISBN 978-3-16-148410-0 costs 20.50",
    "rfc 2616 says 200 or 404",
    "token 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b is not one",
    "tag v1.2.3-rc4 of build 20240101",
    "win 3-1 on 12.05.2024 in group 4",
    "pages 120-135 and 14 tables",
    "scores 10 20 30 40 in order",
)
MARKED = re.compile(r"\[(email|ip|card|phone) (.*?)\](?=$|[\s,.;:!?])")
OPEN_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
AT = re.compile(r"[(\[](?:at|arroba)[)\]]", re.IGNORECASE)
DOT = re.compile(r"[(\[](?:dot|punkt|punto|point)[)\]]", re.IGNORECASE)
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
SPELT = re.compile(
    r"(?<!\S)\S+\s*[(\[](?:at|arroba)[)\]]\s*\S+(?:\s*[(\[](?:dot|punkt|punto|point)[)\]]\s*\S+)+", re.IGNORECASE)
TOKEN = re.compile(r"\S+")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
EDGE = ".,;:!?|\"'"
WINDOW = 64
ROUNDS = 300
BLOCK = 512
DECODED_TOKENS = 256 * BLOCK

Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin with a run of digits and ends with one, so a run is tried once, from its first digit.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _emails(text: str) -> list[Span]:
    """The local part holds no ``@``, so the leftmost match around an ``@`` begins where the run of its
    characters begins, but not before the end of the last match."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        tail = DOMAIN.match(text, at)
        start = at
        if tail:
            while start > done and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            found.append(("email", start, tail.end()))
            done = tail.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind, then start."""
    found = _emails(text) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(DIGIT.findall(m.group())) <= 15:
                    found.append(("phone", *m.span()))
    return found


def shape(token: str) -> str:
    """Runs of letters as x or X, of digits as 9 (with how many, up to 7), other characters as they are."""
    out = re.sub(r"[^\W\d_]+", lambda m: "X" if m.group()[0].isupper() else "x", token)
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 7)}", out)


def _features(before: str, token: str, after: str) -> list[str]:
    own = token.strip(EDGE)
    plain = re.sub(r"9[0-9]", "9", shape(own))
    digits = sum(c.isdigit() for c in own)
    return [
        "bias", "s=" + shape(own), "p=" + plain, f"n={min(digits, 16)}", f"@={'@' in own}", f".={min(own.count('.'), 4)}",
        f":={min(own.count(':'), 3)}", f"+={own[:1]}", f"end={token[-1:] in EDGE}", "b=" + shape(before.strip(EDGE)),
        "bw=" + before.strip(EDGE).lower(), "a=" + shape(after.strip(EDGE)),
        f"d={own.lower() if own.lower() in ('(at)', '[at]', '(dot)', '[dot]') else ''}"]


@dataclass
class Segment:
    """Open tokens that follow each other: their places and features."""

    places: list[tuple[int, int]]
    features: list[list[str]]


def spelt_places(text: str) -> list[tuple[int, int]]:
    """Tokens of spelt-out addresses: an at-mark with the word it stands in or behind, the word after it, and as many
    dot-marks, one at least, with a word each. Marks are found first and tokens counted from there, so that no
    token is looked at from each of its places."""
    if not AT.search(text):
        return []
    tokens = [m.span() for m in TOKEN.finditer(text)]
    marks = [AT.search(text, a, b) for a, b in tokens]
    found: set[int] = set()
    last = -1
    for i, mark in enumerate(marks):
        if mark is None or i <= last:
            continue
        a, b = tokens[i]
        first = i if mark.start() > a else i - 1
        end = i if mark.end() < b else i + 1
        dots = DOT.search(text, mark.end(), b) is not None
        while end + 1 < len(tokens):
            own, after = tokens[end], DOT.match(text, *tokens[end + 1])
            if after:
                dots, end = True, end + (1 if after.end() < tokens[end + 1][1] else 2)
            elif text[own[1] - 1] in ")]" and any(m.end() == own[1] for m in DOT.finditer(text, max(own[0], own[1] - 8), own[1])):
                dots, end = True, end + 1
            else:
                break
        if dots and first >= 0 and end < len(tokens):
            found.update(range(first, end + 1))
            last = end
    return [tokens[i] for i in sorted(found)]


def _word_before(text: str, start: int) -> str:
    """The word in front of a place, however many blanks lie between and however long it is."""
    width = WINDOW
    while True:
        low = max(0, start - width)
        bare = text[low:start].rstrip()
        word = bare.split()[-1] if bare else ""
        if not low or len(word) < len(bare):
            return word
        width *= 4


def _word_after(text: str, end: int) -> str:
    found = TOKEN.search(text, end)
    return found.group() if found else ""


def segments(text: str) -> list[Segment]:
    places = {m.span() for m in OPEN_TOKEN.finditer(text)}
    if "(" in text or "[" in text:
        places.update(spelt_places(text))
    runs: list[list[tuple[int, int]]] = []
    for place in sorted(places):
        if runs and place[0] < runs[-1][-1][1]:
            continue
        if runs and text[runs[-1][-1][1]:place[0]].isspace():
            runs[-1].append(place)
        else:
            runs.append([place])
    found = []
    for run in runs:
        words = [_word_before(text, run[0][0]), *(text[a:b] for a, b in run), _word_after(text, run[-1][1])]
        found.append(Segment(run, [_features(*words[i:i + 3]) for i in range(len(run))]))
    return found


@dataclass(frozen=True)
class Field:
    """``index``: feature to row of ``emit`` (features, labels); ``move`` (label before, label)."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def scores(self, parts: list[Segment], low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(segments, tokens, labels) of the tokens from ``low`` to ``high``, padded with 0, and the lengths."""
        lengths = np.array([len(p.places) for p in parts])
        high = lengths.max() if high is None else min(high, lengths.max())
        out = np.zeros((len(parts), high - low, len(LABELS)))
        for n, part in enumerate(parts):
            for t, names in enumerate(part.features[low:high]):
                rows = [self.index[f] for f in names if f in self.index]
                out[n, t] = self.emit[rows].sum(axis=0)
        return out, lengths

    def decode(self, parts: list[Segment]) -> list[list[int]]:
        """Best labels of every segment, all segments in step; "none" stands before and behind each. Scores
        are made for BLOCK tokens at a time; the best sums and the back pointers go on to the next block."""
        if not parts:
            return []
        count, lengths = len(parts), np.array([len(p.places) for p in parts])
        longest = lengths.max()
        best = np.zeros((count, len(LABELS)))
        back = np.zeros((count, longest, len(LABELS)), dtype=np.int8)
        for low in range(0, longest, BLOCK):
            emit = self.scores(parts, low, low + BLOCK)[0]
            for t in range(low, low + emit.shape[1]):
                if not t:
                    best = emit[:, 0] + self.move[0]
                    continue
                ways = best[:, :, None] + self.move[None]
                back[:, t] = ways.argmax(axis=1)
                after = ways.max(axis=1) + emit[:, t - low]
                best = np.where((t < lengths)[:, None], after, best)
        label = (best + self.move[:, 0]).argmax(axis=1)
        out = np.zeros((count, longest), dtype=np.int64)
        for t in range(longest - 1, -1, -1):
            here = t < lengths
            out[here, t] = label[here]
            label = np.where(here, back[np.arange(count), t, label], label)
        return [row[:n].tolist() for row, n in zip(out, lengths)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def parse(marked: str) -> tuple[str, list[Span]]:
    """Text and spans of a labelled sentence."""
    text, spans, at = "", [], 0
    for m in MARKED.finditer(marked):
        text += marked[at:m.start()]
        spans.append((m.group(1), len(text), len(text) + len(m.group(2))))
        text, at = text + m.group(2), m.end()
    return text + marked[at:], spans


def _gold(part: Segment, spans: list[Span]) -> list[int]:
    out = []
    for start, end in part.places:
        inside = [s for s in spans if start < s[2] and end > s[1]]
        first = inside and start <= inside[0][1]
        out.append(LABELS.index(f"{'B' if first else 'I'}-{inside[0][0]}") if inside else 0)
    return out


@functools.lru_cache(maxsize=2)
def train(labelled: tuple[str, ...] = LABELLED, rounds: int = ROUNDS, ridge: float = 0.02) -> Field:
    """Most likely field for the labelled table, by gradient steps (Adam) with forward-backward sums."""
    parts, gold = [], []
    for marked in labelled:
        text, spans = parse(marked)
        for part in segments(text):
            parts.append(part)
            gold.append(_gold(part, spans))
    index = {f: i for i, f in enumerate(sorted({f for p in parts for names in p.features for f in names}))}
    many = len(LABELS)
    lengths = np.array([len(g) for g in gold])
    longest = lengths.max()
    on = np.zeros((len(parts), longest, len(index)))
    true = np.zeros((len(parts), longest, many))
    true_move = np.zeros((many, many))
    for n, (part, labels) in enumerate(zip(parts, gold)):
        for t, names in enumerate(part.features):
            on[n, t, [index[f] for f in names]] = 1
            true[n, t, labels[t]] = 1
        for a, b in zip([0, *labels], [*labels, 0]):
            true_move[a, b] += 1
    emit, move = np.zeros((len(index), many)), np.zeros((many, many))
    state = [np.zeros_like(x) for x in (emit, emit, move, move)]
    live = (np.arange(longest) < lengths[:, None])
    for step in range(1, rounds + 1):
        score = on @ emit
        ahead = np.zeros(score.shape)
        ahead[:, 0] = score[:, 0] + move[0]
        for t in range(1, longest):
            ahead[:, t] = score[:, t] + _logsum(ahead[:, t - 1, :, None] + move[None], 1)
        behind = np.zeros(score.shape)
        for t in range(longest - 1, -1, -1):
            end = (t == lengths - 1)[:, None]
            more = 0 if t + 1 == longest else _logsum(move[None] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(end, move[:, 0], more)
        total = _logsum(ahead[:, 0] + behind[:, 0], 1)
        share = np.exp(ahead + behind - total[:, None, None]) * live[:, :, None]
        moves = np.zeros((many, many))
        moves[0] += share[:, 0].sum(axis=0)
        moves[:, 0] += share[np.arange(len(parts)), lengths - 1].sum(axis=0)
        for t in range(1, longest):
            use = t < lengths
            pair = ahead[use, t - 1, :, None] + move[None] + (score[use, t] + behind[use, t])[:, None, :]
            moves += np.exp(pair - total[use, None, None]).sum(axis=0)
        for x, gradient, m, v in (
            (emit, np.einsum("stf,stl->fl", on, true - share) - ridge * emit, state[0], state[1]),
            (move, true_move - moves - ridge * move, state[2], state[3]),
        ):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient ** 2 - v)
            x += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Field(index, emit, move)


def field_spans(texts_of: list[str], field: Field) -> list[list[Span]]:
    """Spans by the field, for each of a batch of texts; punctuation at their ends is left out."""
    parts = [segments(t) for t in texts_of]
    flat = [p for own in parts for p in own]
    order = sorted(range(len(flat)), key=lambda i: len(flat[i].places))
    labels: list[list[int]] = [[]] * len(flat)
    while order:
        many = max(1, min(256, DECODED_TOKENS // len(flat[order[-1]].places)))
        order, some = order[:-many], order[-many:]
        for i, found in zip(some, field.decode([flat[i] for i in some])):
            labels[i] = found
    out, n = [], 0
    for text, own in zip(texts_of, parts):
        spans: list[Span] = []
        for part in own:
            open_span: list | None = None
            for (start, end), label in zip(part.places, labels[n]):
                mark, _, kind = LABELS[label].partition("-")
                if mark == "I" and open_span and open_span[0] == kind:
                    open_span[2] = end
                else:
                    open_span = [kind, start, end] if mark != "O" else None
                    if open_span:
                        spans.append(open_span)  # type: ignore[arg-type]
            n += 1
        trimmed = []
        for kind, start, end in spans:
            whole = text[start:end]
            start, end = start + len(whole) - len(whole.lstrip(EDGE)), end - (len(whole) - len(whole.rstrip(EDGE)))
            if start < end:
                trimmed.append((kind, start, end))
        out.append(trimmed)
    return out


def find(texts_of: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, further spans of the field) of each text, in code points, end exclusive."""
    found = []
    for text, more in zip(texts_of, field_spans(texts_of, field)):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        free, n, reach = [], 0, 0
        for kind, a, b in sorted(more, key=lambda s: s[1]):
            while n < len(taken) and taken[n][0] < b:
                reach, n = max(reach, taken[n][1]), n + 1
            if reach <= a:
                free.append((kind, a, b))
        found.append((base, sorted(free, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return found


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts and SHA-256 of the pattern spans, and all spans, those of the field
    among the pattern's of their kind. Null and empty texts have none; repeated rows are kept."""
    bound_batches(docs.sparkSession)
    field = train()
    names = [f"n_{k}" for k in KINDS]

    @F.pandas_udf(", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string")
    def run(batch: pd.Series) -> pd.DataFrame:
        out = []
        for base, more in find(batch.tolist(), field):
            both = sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))
            counts = [sum(k == s[0] for s in base) for k in KINDS]
            out.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(both)))
        return pd.DataFrame(out, columns=[*names, "base_sha256", "spans"])

    return texts(docs).select("doc_id", run("text").alias("r")).select("doc_id", "r.*")
