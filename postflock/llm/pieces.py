"""Unigram segmentation into SentencePiece pieces, and back.

A text becomes one leading marker, with every space turned into the marker ``▁``. The best segmentation has
the highest sum of the pieces' scores; it is found by dynamic programming over the text's bytes, where a
double-array trie lists the pieces that begin at a place. Characters without a piece of their own fall back
to byte pieces. No piece has a marker behind another character, so a text can be cut in front of every run
of markers, and the words between the cuts, which repeat, are remembered.
"""

from __future__ import annotations

import functools
import hashlib
import math
import os
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from postflock.llm.common import bound_batches, texts

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CACHED_WORDS = 800_000
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNKNOWN_PENALTY = 10.0
NEVER = -math.inf


class DoubleArray:
    """Trie in two arrays: from state s the byte b leads to ``base[s] + b + 1`` if ``check`` there is s.
    ``value`` is the id of the piece that ends in a state, or -1."""

    def __init__(self, words: Iterable[tuple[bytes, int]]) -> None:
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for word, value in words:
            at = 0
            for b in word:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    values.append(-1)
                at = children[at][b]
            values[at] = value
        size = 2 * len(children) + 512
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.value[0], self.check[0] = values[0], 0
        # the root has the first 256 places; every other state's children stand behind them
        free, wide, work = 257, 257, [(0, 0)]
        while work:
            node, state = work.pop()
            if not children[node]:
                continue
            codes = sorted(children[node])
            while self.check[free] >= 0:
                free += 1
            # a lone child takes the first free place; more children search behind places too crowded for them
            begin = base = ((free if len(codes) == 1 else max(free, wide)) - codes[0] - 1) if node else 0
            while any(self._taken(base + c + 1) for c in codes):
                base += 1
            if len(codes) > 1 and base > begin + 32:
                wide = base + codes[0] + 1
            self.base[state] = base
            for c in codes:
                self.check[base + c + 1] = state
            for c in codes:
                child = children[node][c]
                self.value[base + c + 1] = values[child]
                work.append((child, base + c + 1))

    def _taken(self, place: int) -> bool:
        if place >= len(self.check):
            more = place + 1024 - len(self.check)
            self.base.extend([0] * more)
            self.check.extend([-1] * more)
            self.value.extend([-1] * more)
        return self.check[place] >= 0

    def ends(self, text: bytes, start: int) -> Iterable[tuple[int, int]]:
        """(end, piece) of all pieces that begin at ``start``, the short ones first."""
        base, check, value, state = self.base, self.check, self.value, 0
        for at in range(start, len(text)):
            after = base[state] + text[at] + 1
            if after >= len(check) or check[after] != state:
                return
            state = after
            if value[state] >= 0:
                yield at + 1, value[state]


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id; ``normal`` may stand in a segmentation, ``byte_ids`` are those of the 256 bytes."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    byte_ids: list[int]
    unknown: int

    @staticmethod
    def load(model: str) -> Vocabulary:
        import public_tokenizers
        import sentencepiece

        path = model if os.path.isabs(model) else public_tokenizers.path(model)
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(own.vocab_size())
        byte_ids = [own.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return Vocabulary(
            [own.id_to_piece(i) for i in ids], [own.get_score(i) for i in ids],
            [not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i)) for i in ids],
            byte_ids if all(own.is_byte(i) for i in byte_ids) else [], own.unk_id())


class Segmenter:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        words = [(p.encode(), i) for i, p in enumerate(vocabulary.pieces) if vocabulary.normal[i]]
        if any(MARK in p.lstrip(MARK) for i, p in enumerate(vocabulary.pieces) if vocabulary.normal[i]):
            raise ValueError("a piece has a marker behind another character")
        self._trie = DoubleArray(words)
        self._unknown_score = min(vocabulary.scores[i] for _, i in words) - UNKNOWN_PENALTY
        self._type = np.dtype("<u2" if len(vocabulary.pieces) < 1 << 16 else "<u4")
        self._known: dict[str, bytes] = {}
        of_byte = {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
        self._raw = [of_byte.get(i, p.encode()) for i, p in enumerate(vocabulary.pieces)]
        self._is_byte = np.zeros(len(vocabulary.pieces), dtype=bool)
        self._is_byte[vocabulary.byte_ids] = True

    def viterbi(self, word: str) -> list[int]:
        """Ids of the best segmentation; of equal ones that whose last piece is longest, and so on backwards."""
        raw, scores, unknown = word.encode("utf-8", "surrogatepass"), self.vocabulary.scores, self._unknown_score
        base, check, value, size = self._trie.base, self._trie.check, self._trie.value, len(raw)
        states = len(check)
        best = [NEVER] * (size + 1)
        best[0] = 0.0
        back: list[tuple[int, int]] = [(0, -1)] * (size + 1)
        start = 0
        while start < size:
            here, lead = best[start], raw[start]
            after = start + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            single, state, end = False, 0, start
            while end < size:  # the walk of ``DoubleArray.ends``, in place as it is the inmost loop
                place = base[state] + raw[end] + 1
                if place >= states or check[place] != state:
                    break
                state = place
                end += 1
                piece = value[state]
                if piece >= 0:
                    if end == after:
                        single = True
                    total = here + scores[piece]
                    if total > best[end]:
                        best[end], back[end] = total, (start, piece)
            if not single:
                total = here + unknown
                if total > best[after]:
                    best[after], back[after] = total, (start, -1)
            start = after
        ids: list[int] = []
        end = len(raw)
        while end:
            start, piece = back[end]
            if piece >= 0:
                ids.append(piece)
            elif self.vocabulary.byte_ids:
                ids.extend(self.vocabulary.byte_ids[b] for b in reversed(raw[start:end]))
            else:
                ids.append(self.vocabulary.unknown)
            end = start
        return ids[::-1]

    def _word(self, word: str) -> bytes:
        """Ids of a word with its marker, remembered without it."""
        ids = np.array(self.viterbi(word), dtype=self._type).tobytes()
        if len(self._known) < CACHED_WORDS:
            self._known[word[1:]] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as little-endian unsigned 32-bit numbers; none for an empty one."""
        if not text:
            return np.zeros(0, dtype="<u4")
        known = self._known.get
        words = text.split(" ")
        if "" in words or MARK in text:
            words = WORD.findall(MARK + text.replace(" ", MARK))
            ids = [known(w[1:]) or self._word(w) for w in words]
        else:
            ids = [known(w) or self._word(MARK + w) for w in words]
        return np.frombuffer(b"".join(ids), dtype=self._type).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces are joined before decoding (a broken sequence gives U+FFFD), markers
        become spaces, and the one that was put in front goes."""
        out = b"".join(map(self._raw.__getitem__, ids.tolist()))
        return out.decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")

    def byte_pieces(self, ids: np.ndarray) -> int:
        return int(self._is_byte[ids].sum())


@functools.lru_cache(maxsize=2)
def segmenter(model: str = MODEL) -> Segmenter:
    """One per Python worker."""
    return Segmenter(Vocabulary.load(model))


def encoded(text: Column | str, model: str = MODEL) -> Column:
    """array<int>: the ids of a text."""

    @F.pandas_udf("array<int>")
    def run(batch: pd.Series) -> pd.Series:
        own = segmenter(model)
        return batch.map(lambda t: own.encode(t).astype(np.int32))

    return run(text)


def decoded(ids: Column | str, model: str = MODEL) -> Column:
    """The text of an array of ids; '' for none."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        own = segmenter(model)
        return batch.map(lambda x: own.decode(np.asarray(x)))

    return run(ids)


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per document: number of pieces and of byte pieces, CRC-32 of the ids (unsigned, 32-bit
    little-endian), SHA-256 of the decoded text, and whether that is the text itself. Null texts are empty;
    an empty text has no pieces. A text that holds the marker character itself comes back with a space."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
    def run(batch: pd.Series) -> pd.DataFrame:
        own, out = segmenter(model), []
        for text in batch:
            ids = own.encode(text)
            back = own.decode(ids)
            out.append((ids.size, own.byte_pieces(ids), zlib.crc32(ids.tobytes()),
                        hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
        return pd.DataFrame(out, columns=["n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256", "lossless"])

    return texts(docs).select("doc_id", run("text").alias("r")).select("doc_id", "r.*")
