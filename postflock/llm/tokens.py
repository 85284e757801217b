"""Token ids of a public byte-level vocabulary, for the operators that count or cut tokens."""

from __future__ import annotations

import base64
import functools
import json
import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHED_WORDS = 400_000


class Encoder:
    """Ids of ``byte_bpe_50k.json`` (``add_special_tokens=False``), got through the ranks file of the same
    vocabulary. Where a text holds the string of an added token of the JSON file, that token's id stands, and
    the parts between are encoded one by one.

    No token reaches over the space in front of a word: where a space stands alone between two characters
    that are no white space, the text may be cut in front of it and the parts encoded one by one. Words
    repeat, so their ids are remembered, up to ``CACHED_WORDS`` of them; other words are encoded each time.
    """

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import tiktoken

        path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self._bpe = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        added = {}
        if os.path.exists(names := os.path.splitext(path)[0] + ".json"):
            with open(names, encoding="utf-8") as file:
                added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self._type = np.dtype("<u2" if max([*ranks.values(), *added.values()]) < 1 << 16 else "<u4")
        self._added = {t: np.array([i], dtype=self._type).tobytes() for t, i in added.items()}
        self._cuts = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._words: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self._bpe.encode_ordinary(text), dtype=self._type).tobytes()

    def _word(self, word: str) -> bytes | None:
        """Ids of the word behind a space; None if white space at its ends forbids the cut."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        ids = self._encode(" " + word)
        if len(self._words) < CACHED_WORDS:
            self._words[word] = ids
        return ids

    def packed(self, text: str) -> bytes:
        if self._cuts is None or not self._cuts.search(text):
            return self._ordinary(text)
        parts, at = [], 0
        for m in self._cuts.finditer(text):
            parts += [self._ordinary(text[at:m.start()]), self._added[m.group()]]
            at = m.end()
        return b"".join([*parts, self._ordinary(text[at:])])

    def _ordinary(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return self._encode(text)
        known, parts = self._words.get, [self._encode(first)]
        for word in rest:
            ids = known(word)
            if ids is None and (ids := self._word(word)) is None:
                return self._encode(text)
            parts.append(ids)
        return b"".join(parts)

    def ids(self, packed: bytes) -> np.ndarray:
        """The ids as little-endian unsigned 32-bit numbers."""
        return np.frombuffer(packed, dtype=self._type).astype("<u4")

    @property
    def width(self) -> int:
        """Bytes per packed id."""
        return self._type.itemsize


@functools.lru_cache(maxsize=2)
def id_width(vocabulary: str = VOCABULARY) -> int:
    """``Encoder.width`` for the driver, which need not hold a tokenizer to know it."""
    import public_tokenizers

    path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        most = max(int(line.split()[1]) for line in lines)
    if os.path.exists(names := os.path.splitext(path)[0] + ".json"):
        with open(names, encoding="utf-8") as file:
            most = max([most, *(t["id"] for t in json.load(file)["added_tokens"])])
    return 2 if most < 1 << 16 else 4


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One per Python worker: its remembered words serve all tasks that the worker runs."""
    return Encoder(vocabulary)


def packed_ids(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """The ids of ``text`` as packed bytes."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(encoder(vocabulary).packed)

    return run(text)


def token_count(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """The number of ids of ``text``."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        own = encoder(vocabulary)
        return texts.map(lambda t: len(own.packed(t)) // own.width).astype("int64")

    return run(text)
