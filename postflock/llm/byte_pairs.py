"""Byte-level BPE by a global shuffle of distinct words: every distinct pre-token is encoded once.

1. *Explode.* Documents are taken in blocks. A block lists its distinct pre-tokens once, and its running text becomes
   the positions of these words in the list (that is the explode, pre-aggregated: a word that holds a third of all
   text is one entry per block, so no key is hot).
2. *Encode once.* Words are dealt by hash; a block's words of one bucket travel as one row. The task that gets a
   bucket encodes each word when it first meets it, whichever block sent it, and answers every block.
3. *Reassemble.* The answers meet the block's positions again, and the ids are laid out by position.

Decoding explodes the distinct ids of a block of documents, joins them with the table of token bytes (one row per
token of the vocabulary, which bounds it) and reassembles in the same task.

Plain rows (word, block, place) do the same; with many rare words they took more disk than the texts themselves.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from postflock.llm.common import bound_batches, texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 10 << 20
DECODED_BYTES = 2 << 20
SLICE_WORDS = 250_000
LEAST_BUCKETS = 32
SPACE, LETTER, NUMBER, OTHER = range(4)
STAND_INS = {SPACE: " ", LETTER: "z", NUMBER: "1", OTHER: "!"}

#: A row with a bucket from 0 on holds the words of a block that fall into it, in ``first``; answered, the numbers of
#: their ids in ``first`` and the ids in ``second``. A row with a bucket below 0 holds what a block keeps: the bucket
#: of each of its words, the positions, and its documents.
BLOCKS = "block string, bucket int, first binary, second binary, docs array<string>, sizes array<long>"


def _path(vocabulary: str) -> str:
    import public_tokenizers

    return vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)


@functools.lru_cache(maxsize=2)
def ranks(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    with open(_path(vocabulary), "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def _bpe(vocabulary: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(vocabulary),
                             special_tokens={})._core_bpe


@functools.lru_cache(maxsize=1)
def classes() -> dict[int, int]:
    """Code points that the tiktoken library and the ``regex`` library class differently, with tiktoken's class:
    the two know different versions of Unicode. Found by asking tiktoken which code points continue a piece that a
    letter, a digit or a mark begins, with a small vocabulary that shows it."""
    import public_tokenizers
    import tiktoken

    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    found = np.full(0x110000, SPACE, dtype=np.int8)
    for kind, first in ((LETTER, b"z"), (NUMBER, b"1"), (OTHER, b"!")):
        shown = {bytes([b]): b for b in range(256)} | {first + bytes([b]): 256 + b for b in range(0xC2, 0xF5)}
        probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=shown, special_tokens={})
        ids = np.array(probe.encode_ordinary("".join(f"{first.decode()}{chr(c)}\n" for c in points)))
        begins = np.concatenate(([0], np.flatnonzero(ids == 10)[:-1] + 1))
        found[np.array(points)[ids[begins] >= 256]] = kind
    ours = np.full(0x110000, SPACE, dtype=np.int8)
    everything = "".join(map(chr, points))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (OTHER, r"[^\s\p{L}\p{N}]")):
        ours[np.array([ord(c) for c in regex.findall(pattern, everything)])] = kind
    return {int(c): int(found[c]) for c in np.flatnonzero(found != ours)}


class Splitter:
    """Pre-tokens of a text, as the pattern of the public tokenizers gives them."""

    def __init__(self, differing: dict[int, int]) -> None:
        import public_tokenizers

        self._find = regex.compile(public_tokenizers.PATTERN)
        self._stands = {c: STAND_INS[kind] for c, kind in differing.items()}
        self._differing = frozenset(map(chr, differing))

    def words(self, text: str) -> list[str]:
        if text.isascii() or self._differing.isdisjoint(text):
            return self._find.findall(text)
        return [text[m.start():m.end()] for m in self._find.finditer(text.translate(self._stands))]


class _Numbered(dict):
    """Numbers its keys as they come up."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**24 as three planes of bytes, compressed; small ones leave the upper planes empty."""
    values = np.asarray(values, dtype=np.int64)
    if values.size and int(values.max()) >= 1 << 24:
        raise ValueError("a number of 2**24 or more")
    return zstandard.compress(b"".join(((values >> shift) & 255).astype(np.uint8).tobytes() for shift in (0, 8, 16)), 6)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(3, -1).astype(np.int32)
    return planes[0] | planes[1] << 8 | planes[2] << 16


def packed_words(words: list[bytes]) -> bytes:
    sizes = packed(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.compress(b"".join(words), 6)


def unpacked_words(data: bytes) -> list[bytes]:
    cut = 4 + int.from_bytes(data[:4], "little")
    ends = np.cumsum(unpacked(data[4:cut])).tolist()
    whole = zstandard.decompress(data[cut:])
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def laid_out(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``starts[i] .. starts[i] + counts[i] - 1`` of all i, one after the other."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.arange(ends[-1] if ends.size else 0) + np.repeat(starts - (ends - counts), counts)


def _apart(before: str, after: str) -> bool:
    """Whether the single space between the two may be cut in front of."""
    return bool(before) and bool(after) and not before[-1].isspace() and not after[0].isspace()


class Block:
    """Documents that are exploded together: distinct words, and the running text as places in their list.

    No pre-token reaches over the space in front of a word: where a space stands alone between two characters that
    are no white space, a text falls into chunks that can be split one by one. Chunks repeat, so each is split once.
    """

    def __init__(self) -> None:
        self.docs: list[str | None] = []
        self._texts: list[pa.Array] = []
        self.bytes = 0

    def add(self, docs: pa.Array, texts_: pa.Array) -> None:
        self.docs.extend(docs.to_pylist())
        self._texts.append(texts_)
        self.bytes += texts_.nbytes

    def _chunks(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Different chunks; all texts as places in that list; chunks per text. A first chunk, which no space
        precedes, is another chunk than the same one behind a space, and the others begin with their space."""
        kind = pa.string() if self.bytes < 1 << 30 else pa.large_string()
        whole = pa.concat_arrays([t.cast(kind) for t in self._texts])
        self._texts = []
        split = pc.split_pattern(whole, " ")
        coded = split.flatten().dictionary_encode()
        keys = coded.dictionary.to_pylist()
        run = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        edges = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        begins = np.array([bool(k) and not k[0].isspace() for k in keys], dtype=bool)
        ends = np.array([bool(k) and not k[-1].isspace() for k in keys], dtype=bool)
        whole_cut = ends[run[:-1]] & begins[run[1:]]
        whole_cut[edges[1:-1] - 1] = True
        firsts, place = np.unique(run[edges[:-1]], return_inverse=True)
        run[edges[:-1]] = len(keys) + place
        chunks = [keys[i] for i in firsts.tolist()]
        for i, key in enumerate(keys):
            keys[i] = " " + key
        chunks = keys + chunks
        odd = np.unique(np.searchsorted(edges, np.flatnonzero(~whole_cut), side="right") - 1).tolist()
        return self._mended(whole, chunks, run, edges, odd) if odd else (chunks, run, np.diff(edges))

    @staticmethod
    def _mended(whole: pa.Array, chunks: list[str], run: np.ndarray, edges: np.ndarray, odd: list[int]):
        """Texts with a space that must not be cut at get longer chunks there."""
        known, runs, low = _Numbered(), [], 0
        for i in odd:
            parts: list[list[str]] = []
            last = ""
            for part in whole[i].as_py().split(" "):
                if parts and not _apart(last, part):
                    parts[-1].append(part)
                else:
                    parts.append([part])
                last = part or " "
            joined = [" " * (j > 0) + " ".join(p) for j, p in enumerate(parts)]
            runs += [run[low:edges[i]], np.array([len(chunks) + known[c] for c in joined], dtype=np.int64)]
            low = edges[i + 1]
        counts = np.diff(edges)
        counts[odd] = [r.size for r in runs[1::2]]
        return chunks + list(known), np.concatenate([*runs, run[low:]]), counts

    def words(self, splitter: Splitter) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct words, the most frequent first; the running text as places in that list; words per text."""
        chunks, run, per_text = self._chunks()
        words, flat, counts = _Numbered(), [], np.ones(len(chunks), dtype=np.int64)
        for i, chunk in enumerate(chunks):
            if chunk.isascii() and chunk[1:].isalpha() and (chunk[0] == " " or chunk.isalpha()):
                flat.append(words[chunk])
            else:
                found = splitter.words(chunk)
                flat.extend(map(words.__getitem__, found))
                counts[i] = len(found)
        flat = np.array(flat, dtype=np.int32)
        starts = np.cumsum(counts) - counts
        passed = np.concatenate(([0], np.cumsum(counts[run])))
        sizes = np.diff(passed[np.concatenate(([0], np.cumsum(per_text)))])
        seen = np.bincount(run, minlength=len(chunks))
        running = np.concatenate([flat[laid_out(starts[part], counts[part])] for part in np.array_split(
            run, 1 + run.size // SLICE_WORDS)])
        order = np.argsort(-np.bincount(flat, weights=np.repeat(seen, counts), minlength=len(words)), kind="stable")
        rank = np.empty(len(words), dtype=np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        names = list(words)
        return [names[i] for i in order.tolist()], rank[running], sizes


BLOCKS_SCHEMA = pa.schema([
    ("block", pa.string()), ("bucket", pa.int32()), ("first", pa.binary()), ("second", pa.binary()),
    ("docs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64()))])


def _explode(buckets: int, block_bytes: int, differing: dict[int, int]):
    def rows(block: Block, splitter: Splitter, name: str) -> pa.RecordBatch:
        words, running, sizes = block.words(splitter)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), dtype=np.int64, count=len(raw))
        name = f"{name}-{zlib.crc32(running.tobytes()):08x}"
        out = [(name, -1 - zlib.crc32(name.encode()) % (1 << 30), packed(bucket), packed(running), block.docs, sizes.tolist())]
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for places in np.split(order, cuts) if order.size else []:
            out.append((name, int(bucket[places[0]]), packed_words([raw[i] for i in places.tolist()]), None, None, None))
        return pa.RecordBatch.from_arrays(
            [pa.array(column, field.type) for column, field in zip(zip(*out), BLOCKS_SCHEMA)], schema=BLOCKS_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, block, made, task = Splitter(differing), Block(), 0, TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                block.add(batch.column(0), batch.column(1))
            if block.bytes >= block_bytes:
                yield rows(block, splitter, f"{task}-{made}")
                block, made = Block(), made + 1
                pa.default_memory_pool().release_unused()
        if block.docs:
            yield rows(block, splitter, f"{task}-{made}")
    return run


def _answer(vocabulary: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket: the words of one bucket are remembered while it lasts."""
        known, single = ranks(vocabulary), _bpe(vocabulary).encode_single_piece
        met: dict[bytes, list[int]] = {}
        current = None
        for batch in batches:
            first, second = batch["first"].to_list(), batch["second"].to_list()
            for i, bucket in enumerate(batch["bucket"].to_list()):
                if bucket < 0:
                    continue
                if bucket != current:
                    met, current = {}, bucket
                found = []
                for word in unpacked_words(first[i]):
                    ids = met.get(word)
                    if ids is None:
                        ids = met[word] = [known[word]] if word in known else single(word)
                    found.append(ids)
                counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
                first[i] = packed(counts)
                second[i] = packed(np.fromiter((x for ids in found for x in ids), dtype=np.int64))
            yield batch.assign(first=first, second=second)
    return run


def width(vocabulary: str = VOCABULARY) -> int:
    """Bytes per packed id."""
    return 2 if max(ranks(vocabulary).values()) < 1 << 16 else 4


def numbers(ids: bytes, size: int) -> np.ndarray:
    return np.frombuffer(ids, dtype=f"<u{size}")


def _laid(block: list[tuple], size: int) -> Iterator[pd.DataFrame]:
    """The documents of one block: its own row first, then the answers in the order of their buckets."""
    (_, _, buckets, running, docs, sizes), *answers = block
    order = np.argsort(unpacked(buckets), kind="stable")
    none = [np.zeros(0, dtype=np.int32)]
    counts = np.concatenate([unpacked(a[2]) for a in answers] or none)
    ids = np.concatenate([unpacked(a[3]) for a in answers] or none).astype(f"<u{size}")
    if counts.size != order.size:
        raise RuntimeError("answers for other words than the block has: its documents were read in another order")
    number = np.empty(order.size, dtype=np.int64)
    start = np.empty(order.size, dtype=np.int64)
    number[order], start[order] = counts, np.cumsum(counts) - counts
    running, ends = unpacked(running), np.cumsum(np.asarray(sizes, dtype=np.int64))
    low = 0
    while low < len(docs):
        base = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + SLICE_WORDS, side="right")))
        words = running[base:int(ends[high - 1])]
        flat = ids[laid_out(start[words], number[words])]
        passed = np.concatenate(([0], np.cumsum(number[words])))[np.concatenate(([0], ends[low:high] - base))]
        yield pd.DataFrame({"doc": list(docs[low:high]),
                            "ids": [flat[a:b].tobytes() for a, b in zip(passed[:-1].tolist(), passed[1:].tolist())]})
        low = high


def _reassemble(vocabulary: str, then=iter):
    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, held = width(vocabulary), []
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if held and held[0][0] != row[0]:
                    yield from _laid(held, size)
                    held = []
                held.append(row)
        if held:
            yield from _laid(held, size)

    return lambda batches: then(coded(batches))


def _met(docs: DataFrame, vocabulary: str, block_bytes: int) -> DataFrame:
    """The rows of every block, with the answers to its words, one after the other."""
    spark = docs.sparkSession
    bound_batches(spark)
    buckets = max(LEAST_BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = texts(docs).select(F.col("doc_id").cast("string").alias("doc"), "text")
    dealt = rows.mapInArrow(_explode(buckets, block_bytes, classes()), BLOCKS).repartition("bucket")
    answered = dealt.sortWithinPartitions("bucket").mapInPandas(_answer(vocabulary), BLOCKS)
    return answered.repartition("block").sortWithinPartitions("block", "bucket")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids) per row of ``docs``: the ids packed, ``width`` bytes each, little-endian.

    A null or empty text has no ids. Null and repeated ids and repeated rows come out each; an empty table gives no
    rows; other columns are not read. A very long text is a block of its own.
    """
    coded = _met(docs, vocabulary, block_bytes).mapInPandas(_reassemble(vocabulary), "doc string, ids binary")
    return coded.select(F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "ids")


def token_bytes(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, token): the bytes of every token."""
    return spark.createDataFrame([(i, bytearray(t)) for t, i in ranks(vocabulary).items()], "id int, token binary")


PARTS = "block int, id int, needed int, doc string, ids binary"


def _explode_ids(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = 0

        def rows(docs: list, coded: list) -> pd.DataFrame:
            different = np.unique(np.concatenate([numbers(x, size) for x in coded])).tolist()
            out = [(made, i, None, None, None) for i in different]
            out += [(made, None, len(different), doc, ids) for doc, ids in zip(docs, coded)]
            return pd.DataFrame(out, columns=["block", "id", "needed", "doc", "ids"]).astype({"id": "Int32", "needed": "Int32"})

        docs, coded, held = [], [], 0
        for batch in batches:
            for doc, ids in zip(batch.doc, batch.ids):
                docs.append(doc)
                coded.append(ids)
                held += len(ids)
                if held >= DECODED_BYTES:
                    yield rows(docs, coded)
                    docs, coded, held, made = [], [], 0, made + 1
        if docs:
            yield rows(docs, coded)
    return run


class Pieces:
    """Byte strings by number, laid out one after the other by numpy."""

    def __init__(self, pieces: dict[int, bytes]) -> None:
        keys = sorted(pieces)
        self.keys = np.array(keys, dtype=np.int64)
        self.sizes = np.array([len(pieces[k]) for k in keys], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.whole = np.frombuffer(b"".join(pieces[k] for k in keys), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        parts = []
        for low in range(0, ids.size, SLICE_WORDS):
            at = np.searchsorted(self.keys, ids[low:low + SLICE_WORDS])
            parts.append(self.whole[laid_out(self.starts[at], self.sizes[at])].tobytes())
        return parts[0] if len(parts) == 1 else b"".join(parts)


def _join_bytes(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A document is decoded when all tokens of its block have come; the join keeps a block in its task."""
        tables: dict[int, dict[int, bytes]] = {}
        waiting: list[tuple] = []

        def decoded(found: list[tuple]) -> pd.DataFrame:
            own = {b: (Pieces(tables[b]), Pieces({k: f"{k},".encode() for k in tables[b]})) for b in {f[0] for f in found}}
            out = []
            for block, _, doc, ids in found:
                read = numbers(ids, size)
                pieces, decimals = own[block]
                out.append((doc, ids, pieces.joined(read), hashlib.sha256(decimals.joined(read)[:-1]).hexdigest()))
            return pd.DataFrame(out, columns=["doc", "ids", "decoded", "ids_sha256"])

        for batch in batches:
            for block, number, needed, doc, ids, token in batch.itertuples(index=False, name=None):
                table = tables.setdefault(block, {})
                if ids is not None:
                    waiting.append((block, int(needed), doc, ids))
                elif token is None:
                    raise ValueError(f"id {int(number)} is not in the vocabulary")
                else:
                    table[int(number)] = token
            ready = [w for w in waiting if len(tables[w[0]]) == w[1]]
            waiting = [w for w in waiting if len(tables[w[0]]) < w[1]]
            yield decoded(ready)
            last = max(tables, default=0)
            tables = {b: t for b, t in tables.items() if b == last or any(w[0] == b for w in waiting)}
        if waiting:
            raise RuntimeError("tokens of a block came to another task")
    return run


def _decoded(parts: DataFrame, vocabulary: str, kind: str) -> DataFrame:
    joined = parts.join(F.broadcast(token_bytes(parts.sparkSession, vocabulary)), "id", "left")
    found = joined.select("block", "id", "needed", "doc", "ids", "token").mapInPandas(
        _join_bytes(width(vocabulary)), "doc string, ids binary, decoded binary, ids_sha256 string")
    return found.select(F.col("doc").cast(kind).alias("doc_id"), "ids", "decoded", "ids_sha256")


def decode(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, decoded, ids_sha256) per row of ``coded(doc_id, ids)``: the bytes that the ids stand for, and the
    SHA-256 of the decimal ids joined by commas, made in the same pass. Null ids count as none; an id outside the
    vocabulary is an error."""
    bound_batches(coded.sparkSession)
    rows = coded.select(F.col("doc_id").cast("string").alias("doc"), F.coalesce("ids", F.lit(b"")).alias("ids"))
    return _decoded(rows.mapInPandas(_explode_ids(width(vocabulary)), PARTS), vocabulary,
                    coded.schema["doc_id"].dataType.simpleString())


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``decode(encode(docs))``, where the task that lays out the ids also explodes them."""
    parts = _met(docs, vocabulary, block_bytes).mapInPandas(
        _reassemble(vocabulary, _explode_ids(width(vocabulary))), PARTS)
    return _decoded(parts, vocabulary, docs.schema["doc_id"].dataType.simpleString())


def digest(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The ids of all texts, and the bytes they decode to, as hashes."""
    return round_trip(docs, vocabulary).select(
        "doc_id", F.floor(F.length("ids") / width(vocabulary)).alias("n_tokens"), "ids_sha256",
        F.sha2("decoded", 256).alias("decoded_sha256"))
