"""Fill-in-middle: texts cut into prefix, middle and suffix by rank, found through a learned rank index.

A rank is a number of units (code points, or lines); its boundary is a place in the UTF-8 bytes of the text. The
index of a text learns rank -> place: straight segments are fitted to all boundaries, each as long as one line
stays within ``error`` bytes of every boundary it covers, and per boundary the residual, what the line is off, is
kept in one byte. A cut is predicted by the segment of its rank and then corrected by its residual, which makes
it exact. Texts are indexed in blocks of ``BLOCK`` bytes, so that a very long one needs its residuals and little
more. Plain English is one segment per block with residuals of 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from postflock.llm.common import bound_batches, texts

ERROR = 120
BLOCK = 1 << 18
FIRST_STEP = 256
PLAIN_FROM = 90
SPM_BELOW = 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
UNITS = ("characters", "lines")


@dataclass
class RankIndex:
    """Segments (first rank, place, bytes per rank) and one residual per boundary, ranks 0 to ``units``."""

    ranks: np.ndarray
    places: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    @property
    def units(self) -> int:
        return self.residuals.size - 1

    def predicted(self, rank: int) -> int:
        at = int(np.searchsorted(self.ranks, rank, side="right")) - 1
        return int(np.rint(self.places[at] + self.slopes[at] * (rank - self.ranks[at])))

    def place(self, rank: int) -> int:
        """The exact byte place of the boundary of this rank."""
        return self.predicted(rank) + int(self.residuals[rank])


def _segment(places: np.ndarray, error: int) -> tuple[int, float]:
    """How many of the boundaries one line from the first of them keeps within ``error``, and its slope. The cone
    of possible slopes narrows with each boundary; it is looked at in steps that double while it stays open."""
    low, high, reached, step = -np.inf, np.inf, 1, FIRST_STEP
    while reached < places.size:
        ahead = np.arange(reached, min(places.size, reached + step))
        rise = (places[ahead] - places[0]).astype(np.float64)
        lows = np.maximum.accumulate(np.maximum((rise - error) / ahead, low))
        highs = np.minimum.accumulate(np.minimum((rise + error) / ahead, high))
        closed = np.flatnonzero(lows > highs)
        fit = int(closed[0]) if closed.size else ahead.size
        if fit:
            low, high, reached = lows[fit - 1], highs[fit - 1], reached + fit
        if closed.size:
            break
        step *= 2
    if reached == 1:
        return 1, 0.0
    whole = np.rint((low + high) / 2)
    return reached, float(whole if low <= whole <= high else (low + high) / 2)


def boundaries(raw: bytes, units: str) -> Iterator[np.ndarray]:
    """Byte places of all boundaries in blocks: where each unit begins, and at last the end."""
    for at in range(0, len(raw), BLOCK):
        block = np.frombuffer(raw, dtype=np.uint8, count=min(BLOCK, len(raw) - at), offset=at)
        if units == "characters":
            begins = np.flatnonzero((block & 0xC0) != 0x80)
        else:
            begins = np.flatnonzero(block == 10) + 1
            begins = begins[begins + at < len(raw)]
            begins = np.concatenate(([0], begins)) if at == 0 else begins
        if begins.size:
            yield begins + at
    yield np.array([len(raw)])


def fit(raw: bytes, units: str = "characters", error: int = ERROR) -> RankIndex:
    """The index of one text. ``error`` is at most 120, so that a residual, rounded, fits one byte."""
    if units not in UNITS or not 0 <= error <= ERROR:
        raise ValueError("units are characters or lines, error is 0 to 120")
    ranks, places, slopes, residuals, done = [], [], [], [], 0
    for block in boundaries(raw, units):
        at = 0
        while at < block.size:
            count, slope = _segment(block[at:], error)
            lines = np.rint(block[at] + slope * np.arange(count))
            ranks.append(done + at)
            places.append(block[at])
            slopes.append(slope)
            residuals.append((block[at:at + count] - lines).astype(np.int8))
            at += count
        done += block.size
    return RankIndex(np.array(ranks), np.array(places), np.array(slopes), np.concatenate(residuals))


def _draws(doc: str) -> list[int]:
    digest = hashlib.sha256(f"1:{doc}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def transform(doc: str, raw: bytes, units: str = "characters") -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, units of the prefix, units of the middle, output) of one text, drawn by its id."""
    index = fit(raw, units)
    n, draws = index.units, _draws(doc)
    if not raw or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= PLAIN_FROM:
        return n, "plain", None, None, raw
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = index.place(first), index.place(second)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if draws[3] % 100 < SPM_BELOW:
        return n, "spm", first, second - first, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", first, second - first, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def infill(docs: DataFrame, units: str = "characters") -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) per row of ``docs``.

    A null or empty text is plain with 0 units; a text that holds a mark, or that its id draws so, is plain. A null
    doc_id draws as an empty one; repeated rows come out equal, each; an empty table gives no rows; other columns
    are not read. Units are code points, or lines (each with its newline).
    """
    if units not in UNITS:
        raise ValueError("units are characters or lines")
    bound_batches(docs.sparkSession)

    @F.pandas_udf("n long, form string, prefix_units long, middle_units long, output binary")
    def run(ids: pd.Series, raws: pd.Series) -> pd.DataFrame:
        rows = [transform(doc, raw, units) for doc, raw in zip(ids, raws)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_units", "middle_units", "output"])
        return out.astype({"prefix_units": "Int64", "middle_units": "Int64"})

    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return texts(docs).select("doc_id", run(doc, F.col("text").cast("binary")).alias("r")).select(
        "doc_id", "r.n", "r.form", "r.prefix_units", "r.middle_units", F.col("r.output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. The marks stand in the output once each: a text that holds one is
    plain, and no mark can come up across a joint, as only its first character is ``<``."""
    p, s, m = (mark.decode() for mark in (PREFIX, SUFFIX, MIDDLE))
    middle = F.substring_index(output, m, -1)
    rest = F.substring_index(output, m, 1)
    psm = F.concat(F.substr(F.substring_index(rest, s, 1), F.lit(len(p) + 1)), middle, F.substring_index(rest, s, -1))
    spm = F.concat(F.substring_index(rest, p, -1), middle, F.substr(F.substring_index(rest, p, 1), F.lit(len(s) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    """The forms of all texts in code points, with the hashes of the outputs and of the texts rebuilt from them."""
    return infill(docs).select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: The forms by plain cutting, in DuckDB's SQL.
SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
numbers AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn),
forms AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (
  SELECT doc_id, n, form, t, a, b, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM forms)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""
