"""Fill-in-middle, byte-level BPE and the conversation trie: against brute force and the public library."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from postflock.llm import byte_pairs, infill, prefix_trie
from postflock.llm.queries import QUERIES, SQL
from tests.conftest import SMALL
from tests.harness import connect, differences
from tests.llm.helpers import LONG, documents, odd_texts

MORE = [(20, "a <P> b"), (21, "<S>"), (22, "<"), (23, "x<P"), (24, "tail<S\n" * 9), (25, "ü" * 5000 + "plain " * 900)]


def test_every_rank_has_its_place():
    random.seed(1)
    texts = ["".join(random.choice("ab é☃𝄞\n") if random.random() < .5 else "x" * random.randint(0, 40)
                     for _ in range(random.randint(0, 60))) for _ in range(100)]
    for text in [*texts, LONG, "é" * 200_000 + "a" * 200_000 + "𝄞a" * 100_000]:
        for error in (0, 3, 120):
            index = infill.fit(text.encode(), error=error)
            ranks = range(len(text) + 1) if len(text) < 3000 else random.sample(range(len(text) + 1), 50)
            assert index.units == len(text) and np.abs(index.residuals.astype(int)).max(initial=0) <= error + 1
            assert [index.place(r) for r in ranks] == [len(text[:r].encode()) for r in ranks]


def test_plain_text_is_one_segment():
    assert infill.fit(b"plain words " * 1000).ranks.size == 2  # the text, and the block of its end
    assert not infill.fit(b"plain words " * 1000).residuals.any()


def test_lines_are_units_too(spark):
    text = "one\ntwo é\n\nlast"
    index = infill.fit(text.encode(), "lines")
    assert [index.place(r) for r in range(index.units + 1)] == [0, 4, 11, 12, len(text.encode())]
    rows = infill.infill(documents(spark, [(i, text) for i in range(40)]), "lines")
    back = rows.select("n", "prefix_units", infill.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert {r.t for r in back} == {text} and {r.n for r in back} == {4}
    assert {r.prefix_units for r in back} > {0, 1}


def _form(doc, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, cut, out = "plain", (None, None), text
    elif h4 % 100 < 20:
        form, cut, out = "spm", (a, b - a), "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    else:
        form, cut, out = "psm", (a, b - a), "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]
    return (doc, n, form, *cut, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("rows", [odd_texts() + MORE + [(i, f"{i} <é☃" * i) for i in range(30, 90)], []])
def test_forms(spark, rows):
    found = [tuple(r) for r in infill.digest(documents(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted((_form(*r) for r in rows), key=str)


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(byte_pairs.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _coded(library, doc, text):
    ids = library.encode_ordinary(text or "")
    return (doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def _odd_strings():
    random.seed(5)
    letters = "ab  \n\t é1２☃'s! \x85\x1c\x00 𝄞"
    return [(i if i % 7 else None, "".join(random.choices(letters, k=random.randint(0, 40))) if i % 5 else None)
            for i in range(300)]


@pytest.mark.parametrize("rows", [
    odd_texts() + _odd_strings() + [(9, "x" * 100_000), (9, " " * 1000), (10, "don't I'll we've <|endoftext|>")], [(1, None)], []])
@pytest.mark.parametrize("block_bytes", [byte_pairs.BLOCK_BYTES, 50])
def test_ids_and_bytes(spark, library, rows, block_bytes, monkeypatch):
    monkeypatch.setattr(byte_pairs, "DECODED_BYTES", 40 * block_bytes)
    docs = documents(spark, rows).repartition(3)
    coded = byte_pairs.encode(docs, block_bytes=block_bytes)
    found = byte_pairs.decode(coded).select(
        "doc_id", F.floor(F.length("ids") / 2), "ids_sha256", F.sha2("decoded", 256)).collect()
    assert sorted(map(tuple, found), key=str) == sorted((_coded(library, *r) for r in rows), key=str)


def test_whole_table_as_the_library(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op12_byte_bpe"](spark, SMALL).collect()
    assert sorted(map(tuple, found)) == sorted(_coded(library, *r) for r in docs)


def test_a_word_is_encoded_once_however_many_blocks_send_it():
    blocks = [("b1", 3), ("b2", 3), ("b1", 4)]
    rows = byte_pairs.pd.DataFrame(
        [(b, k, byte_pairs.packed_words([b"hot", f" w{k}".encode()]), None, None, None) for b, k in blocks],
        columns=["block", "bucket", "first", "second", "docs", "sizes"])
    asked = []

    class Counted:
        def encode_single_piece(self, word):
            asked.append(word)
            return [7]

    own = byte_pairs._bpe, byte_pairs.ranks
    byte_pairs._bpe, byte_pairs.ranks = (lambda v: Counted()), (lambda v: {})
    try:
        answered = next(byte_pairs._answer("v")(iter([rows])))
    finally:
        byte_pairs._bpe, byte_pairs.ranks = own
    assert asked == [b"hot", b" w3", b"hot", b" w4"]
    assert byte_pairs.unpacked(answered["second"].iloc[1]).tolist() == [7, 7]


def test_code_points_are_classed_as_the_library_does(library):
    differing = byte_pairs.classes()
    random.seed(2)
    splitter, single = byte_pairs.Splitter(differing), byte_pairs._bpe(byte_pairs.VOCABULARY).encode_single_piece
    points = random.sample(sorted(differing), min(300, len(differing))) + random.sample(range(0x80, 0xD800), 2000)
    for c in map(chr, points):
        text = f"a{c}a 1{c}1 {c}{c} a {c}b\n{c}!{c} '{c}s"
        assert [i for w in splitter.words(text) for i in single(w.encode())] == library.encode_ordinary(text)


def test_unknown_ids_are_an_error(spark):
    coded = spark.createDataFrame([(1, bytearray(b"\xff\xff"))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_pairs.decode(coded).collect()


def _trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted((m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children[node]), leaves[node],
                   saved[node], hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(node)).encode()).hexdigest())
                  for node, m in members.items())


def _table(spark, rows):
    more = [(*r, "k", 7, "x", 1) for r in rows]
    return spark.createDataFrame(more, "conv_id long, turn long, role string, text string, id string, part int, line string, depth int")


def _odd_turns():
    random.seed(8)
    rows = [(c, t, random.choice(["user", "assistant", None]), random.choice(["a", "bb", "ééé", "", None, "𝄞"]))
            for c in random.sample(range(500), 120) for t in range(random.randint(0, 7))]
    rows += [(c, t, "user", "same") for c in range(600, 640) for t in range(6)]
    rows += [(700, None, "user", "first"), (700, None, "user", "first"), (700, 1, "user", "z"), (700, 1, "user", "y"),
             (None, 1, "user", "nobody's"), (-105, 1, "user", "below"), (-200, 3, "user", "zero"), (701, 0, "user", LONG)]
    return rows


@pytest.mark.parametrize("part_nodes", [prefix_trie.PART_NODES, 25, 1])
def test_trie_of_odd_turns(spark, part_nodes):
    found = prefix_trie.nodes_report(_table(spark, _odd_turns()), part_nodes).collect()
    assert sorted(map(tuple, found), key=str) == sorted(_trie(_odd_turns()), key=str)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(5, 0, "user", "only")], [(100, 3, None, None)]])
def test_small_tries(spark, rows):
    assert sorted(map(tuple, prefix_trie.nodes_report(_table(spark, rows)).collect()), key=str) == sorted(_trie(rows), key=str)


def test_one_very_long_conversation_is_a_chain_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURN_RANGE", 16)
    monkeypatch.setattr(prefix_trie, "IDS_PER_CHUNK", 4)
    rows = [(200, t, "user", f"t{t}") for t in range(700)] + [(c, t, "user", f"t{t}") for c in range(201, 230) for t in range(20)]
    found = prefix_trie.nodes_report(_table(spark, rows).repartition(5), 50).collect()
    assert sorted(map(tuple, found), key=str) == sorted(_trie(rows), key=str)


def test_trie_rounds_are_few_on_a_chain(spark, monkeypatch):
    kept, names = prefix_trie.stored, []
    monkeypatch.setattr(prefix_trie, "stored", lambda df, name: (names.append(name), kept(df, name))[1])
    rows = [(300, t, "user", f"t{t}") for t in range(1000)]
    report = prefix_trie.nodes_report(_table(spark, rows), 100)
    assert names.count("trie-round") <= 6
    assert {(r.depth, r.n_leaves, r.n_convs) for r in report.collect()} == {(d, 1, 1) for d in range(1001)}


@pytest.mark.parametrize("name,column", [("op11_fill_in_middle", "prefix_chars"), ("op13_prefix_trie", "parent_conv_id")])
def test_new_queries_equal_sql(spark, name, column):
    found, told = QUERIES[name](spark, SMALL).toPandas(), connect(SMALL).sql(SQL[name]).df()
    for c in [column] + ["middle_chars"] * (column == "prefix_chars"):
        found[c], told[c] = found[c].astype(float), told[c].astype(float)
    assert differences(found, told) == ""
