"""Fingerprints, packing, histogram, pieces: against brute force and the public tokenizer."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from postflock.llm import lengths, packing, pieces, winnowing
from postflock.llm.tokens import encoder
from tests.conftest import SMALL
from tests.llm.helpers import LONG, documents, odd_texts


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def reference():
    return TOKENIZER


@pytest.fixture(scope="module")
def small_texts(spark):
    return dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())


def test_windows_choose_the_rightmost_least():
    random.seed(3)
    for _ in range(200):
        text = "".join(random.choice("ab") for _ in range(random.randint(0, 50)))
        grams = winnowing.gram_hashes(text, 4)
        hashes, places = winnowing.winnow(grams, 5)
        expected = set()
        for i in range(max(1, len(grams) - 4) if len(grams) else 0):
            window = list(grams[i:i + 5])
            expected.add(i + max(j for j, x in enumerate(window) if x == min(window)))
        assert sorted(expected) == places.tolist() and (hashes == grams[places]).all()


def test_shared_passages_share_a_mark_at_matching_places():
    random.seed(4)
    passage = "".join(random.choice("abcdefgh ") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
    a, b = "x" * 150 + passage + "y" * 90, "z" * 33 + passage + "w" * 201
    (ha, pa), (hb, pb) = winnowing.fingerprint(a), winnowing.fingerprint(b)
    places = {(h, p - 150) for h, p in zip(ha.tolist(), pa.tolist())}
    assert places & {(h, p - 33) for h, p in zip(hb.tolist(), pb.tolist())}


def test_packed_fingerprint_keeps_hashes_and_places():
    marks = winnowing.fingerprint(LONG[:5000])
    raw = np.frombuffer(base64.b64decode(winnowing.packed(marks)), dtype=[("h", ">u4"), ("g", ">u2")])
    assert (np.cumsum(raw["g"].astype(int)) == marks[1]).all() and (raw["h"] == marks[0] >> np.uint64(32)).all()


def _follow(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return list(zip(ordered, ordered[1:] + ordered[:1]))


def _edited(rows):
    out = []
    for (doc, text), (_, after) in _follow([(i, t or "") for i, t in rows]):
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                    winnowing.packed(winnowing.fingerprint(text)), winnowing.packed(winnowing.fingerprint(edited))))
    return sorted(out, key=str)


@pytest.mark.parametrize("texts", [odd_texts(), [(5, "alone " * 40)], []])
def test_edited_texts(spark, texts):
    found = winnowing.digest(documents(spark, texts)).collect()
    assert sorted(((r[0], *r[1:5]) for r in found), key=str) == _edited(texts)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_edited_texts_of_the_table(spark, small_texts):
    found = winnowing.digest(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    assert sorted(((r[0], *r[1:5]) for r in found), key=str) == _edited(small_texts.items())
    assert np.mean([r.near_edited for r in found]) > 0.4 > 0.1 > np.mean([r.near_next for r in found])


def test_fingerprint_table(spark):
    rows = winnowing.fingerprints(documents(spark, odd_texts())).collect()
    assert len(rows) == len(odd_texts())
    assert all((len(r["hashes"]) == 0) == (r.doc_id in (1, 2) or r.doc_id is None and not r["hashes"]) for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t ab'1.,é☃ "), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_equal_the_tokenizer(text):
    own = encoder()
    assert own.ids(own.packed(text)).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "a", " b", "\n", "é"]), max_size=9).map("".join))
def test_ids_of_added_tokens_equal_the_tokenizer(text):
    own = encoder()
    for whole in (text, f"a {text}<|endoftext|> b"):
        assert own.ids(own.packed(whole)).tolist() == TOKENIZER.encode(whole, add_special_tokens=False).ids


def _check_pieces(pieces_found, ids):
    total = 0
    for doc, rows in pieces_found.items():
        whole = ids[doc]
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole)
            assert r.ids_crc32 == zlib.crc32(whole[at:at + r.length].tobytes())
            at += r.length
        assert at == len(whole)
        total += at
    places = sorted((r.sequence_id * 2048 + r.offset, r.length) for rows in pieces_found.values() for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and (not places or places[0][0] == 0)
    assert all(a // 2048 == (a + n - 1) // 2048 for a, n in places)
    return total


def test_packing_is_whole(spark, small_texts, reference):
    ids = {d: np.array(reference.encode(t, add_special_tokens=False).ids + [1], dtype="<u4") for d, t in small_texts.items()}
    found = {}
    for r in packing.pack(spark.read.parquet(f"{SMALL}/documents.parquet")).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert _check_pieces(found, ids) == sum(map(len, ids.values()))


def test_packing_odd_rows(spark, reference):
    texts = [(i, t) for i, t in odd_texts() if i is not None and i != 6 and i != 11]
    ids = {d: np.array(reference.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for d, t in texts}
    found = {}
    for r in packing.pack(documents(spark, texts, source=None)).collect():
        found.setdefault(r.doc_id, []).append(r)
    _check_pieces(found, ids)
    both = packing.pack(documents(spark, odd_texts())).groupBy().agg({"length": "sum"}).first()[0]
    assert both == sum(len(reference.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in odd_texts())
    assert packing.pack(documents(spark, [])).count() == 0


def test_windows_hold_the_target_proportions(spark):
    rows = [(i, "abc"[i % 3] if i % 10 else "d", 20 + i * 7 % 90) for i in range(6000)]
    queues = spark.createDataFrame(rows, "row_id long, source string, tokens long")
    placed = packing.schedule(queues, window_tokens=8192).toPandas().sort_values("position")
    assert (placed.position.to_numpy() == np.concatenate([[0], placed.tokens.cumsum()[:-1]])).all()
    share = placed.groupby("source").tokens.sum() / placed.tokens.sum()
    counts = placed.pivot_table(index="mix_window", columns="source", values="tokens", aggfunc="sum").iloc[:-1]
    assert ((counts - share * 8192).abs() <= 2 * 110).all().all()
    served = counts.cumsum()
    due = np.outer(np.arange(1, len(counts) + 1) * 8192, share)
    assert (served - due).abs().max().max() <= 110


def test_given_shares(spark):
    queues = spark.createDataFrame([(i, "ab"[i % 2], 100) for i in range(400)], "row_id long, source string, tokens long")
    shares = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "source string, share double")
    first = packing.schedule(queues, 4000, shares).filter("mix_window = 0").groupBy("source").sum("tokens").collect()
    assert dict(first) == {"a": 3000, "b": 1000}


@pytest.mark.parametrize("texts", [odd_texts(), []])
def test_histogram(spark, reference, texts):
    long = np.array([len(reference.encode(t or "", add_special_tokens=False).ids) for _, t in texts])
    sums = lengths.suffix_sums(lengths.histogram(documents(spark, texts)))
    rows = sums.collect()
    assert sorted(r.length for r in rows) == sorted(set(long.tolist()))
    for r in rows:
        assert r.documents == (long == r.length).sum() and r.reaching == (long >= r.length).sum()
        assert r.longer == (long > r.length).sum() and r.tokens == long[long >= r.length].sum()
        assert r.kept_tokens == np.minimum(long, r.length).sum() and r.lost_tokens == long.sum() - r.kept_tokens
        assert abs(r["quantile"] - (long <= r.length).mean()) < 1e-12
    if texts:
        for r in lengths.at_limits(sums, [0, 3, 18, 10**6]).collect():
            assert r.longer == (long > r.context_limit).sum()
            assert r.kept_tokens == np.minimum(long, r.context_limit).sum()
        assert dict(lengths.quantiles(sums, [0.5, 1.0]).collect())[1.0] == long.max()


def _best(text, vocabulary):
    """Highest sum over all segmentations, by trying every one."""
    scores = {p: vocabulary.scores[i] for i, p in enumerate(vocabulary.pieces) if vocabulary.normal[i]}
    low = min(scores.values()) - 10
    best = {0: 0.0}
    for end in range(1, len(text) + 1):
        ways = [best[s] + scores[text[s:end]] for s in range(end) if text[s:end] in scores]
        if text[end - 1] not in scores:
            ways.append(best[end - 1] + low)
        best[end] = max(ways)
    return best[len(text)], scores, low


def test_segmentation_is_best_and_comes_back():
    own = pieces.segmenter()
    random.seed(5)
    texts = ["".join(random.choice("the ing on☃é\n𝄞 日a") for _ in range(random.randint(1, 25))) for _ in range(300)]
    for text in texts:
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        best, scores, low = _best(marked, own.vocabulary)
        ids = own.encode(text).tolist()
        total, run = 0.0, bytearray()
        for i in ids:
            if i in own.vocabulary.byte_ids:
                run.append(own.vocabulary.byte_ids.index(i))
            else:
                total += scores[own.vocabulary.pieces[i]]
        total += low * len(run.decode("utf-8"))
        assert abs(total - best) < 1e-3 and own.decode(np.array(ids)) == text


def test_double_array_holds_every_piece():
    own = pieces.segmenter()
    for i in range(300, 32_000, 37):
        if own.vocabulary.normal[i]:
            raw = own.vocabulary.pieces[i].encode()
            assert (len(raw), i) in list(own._trie.ends(raw, 0))


def test_pieces_of_odd_rows(spark):
    rows = pieces.digest(documents(spark, odd_texts())).collect()
    assert len(rows) == len(odd_texts())
    assert all(r.lossless for r in rows if r.doc_id != 11) and not [r for r in rows if r.doc_id in (1, 2)][0].n_pieces
    back = documents(spark, [(5, "a  b é"), (6, "")]).select(pieces.decoded(pieces.encoded("text")).alias("t")).collect()
    assert [r.t for r in back] == ["a  b é", ""]
    assert pieces.digest(documents(spark, [])).count() == 0
