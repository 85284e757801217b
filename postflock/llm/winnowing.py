"""Document fingerprints by winnowing.

A text's k-grams of code points are hashed by rolling; of every ``window`` consecutive hashes the least is
chosen, the rightmost where several are equal, and kept with its position. Two texts that share a passage of
at least ``window + gram - 1`` characters share a chosen hash, at positions that belong together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from postflock.llm.common import bound_batches, texts
from postflock.llm.rolling import mixed, prefix_sums, window_hashes

GRAM = 32
WINDOW = 64

Marks = tuple[np.ndarray, np.ndarray]


def gram_hashes(text: str, gram: int = GRAM) -> np.ndarray:
    """64-bit hashes of all k-grams; of the whole text, if it is shorter than one; none for an empty text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if points.size == 0:
        return points
    k = min(gram, points.size)
    return mixed(window_hashes(prefix_sums(points + np.uint64(1)), k) + np.uint64(k))


def winnow(hashes: np.ndarray, window: int = WINDOW) -> Marks:
    """(hashes, positions) of the rightmost least hash of every window; one window if there are fewer.
    Minima over 1, 2, 4, ... neighbours are combined, the right one winning ties."""
    least, where = hashes, np.arange(hashes.size)
    width, window = 1, min(window, hashes.size)
    while width < window:
        step = min(width, window - width)
        right = least[step:] <= least[:-step]
        where = np.where(right, where[step:], where[:-step])
        least = np.where(right, least[step:], least[:-step])
        width += step
    if where.size > 1:
        where = where[np.concatenate(([True], where[1:] != where[:-1]))]
    return hashes[where], where


def fingerprint(text: str, gram: int = GRAM, window: int = WINDOW) -> Marks:
    return winnow(gram_hashes(text, gram), window)


def likeness(a: Marks, b: Marks) -> float:
    """Shared part of all different hashes of both; 1 for two empty fingerprints."""
    one, two = np.unique(a[0]), np.unique(b[0])
    if not one.size and not two.size:
        return 1.0
    shared = np.intersect1d(one, two, assume_unique=True).size
    return shared / (one.size + two.size - shared)


def packed(marks: Marks) -> str:
    """Base64 of 6 bytes per mark: the hash's upper 32 bits and the distance from the mark before."""
    hashes, positions = marks
    out = np.empty(hashes.size, dtype=[("hash", ">u4"), ("gap", ">u2")])
    out["hash"] = hashes >> np.uint64(32)
    out["gap"] = np.diff(positions, prepend=0)
    return base64.b64encode(out.tobytes()).decode()


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, hashes array<long>, positions array<int>): one row per row of ``docs``. Null and empty texts
    have no marks; a text shorter than a gram has one; the gram hashes are the signed view of 64 bits."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("hashes array<long>, positions array<int>")
    def run(batch: pd.Series) -> pd.DataFrame:
        marks = [fingerprint(t, gram, window) for t in batch]
        return pd.DataFrame({"hashes": [h.view(np.int64) for h, _ in marks],
                             "positions": [p.astype(np.int32) for _, p in marks]})

    return texts(docs).select("doc_id", run("text").alias("marks")).select("doc_id", "marks.*")


def _ranges(docs: DataFrame, parts: int) -> tuple[list[int], bool, int | None]:
    """Ids at which ranges 1, 2, ... begin, whether ids are null, the least id. Every range has a row."""
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found = docs.agg(
        F.percentile_approx("doc_id", shares, 10_000).alias("at"), F.min("doc_id").alias("least"),
        F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"),
    ).first()
    starts = sorted({x for x in found["at"] or [] if x > found["least"]}) if parts > 1 else []
    return starts, found["nulls"] > 0, found["least"]


def followed(docs: DataFrame) -> DataFrame:
    """Rows (part, ahead, doc_id as string, text), sorted by id inside Spark's partition ``part``. Each part ends with
    the rows (ahead true) of the id that begins the next part, or of the first id at the last part. Texts
    are shuffled once; only the few ids that begin a part go twice. Null ids come first; equal ids by text."""
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts, nulls, least = _ranges(rows.select("doc_id"), parts)
    edges = np.array(starts, dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(dtype=np.int64), side="right"))

    last = len(starts)
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(part_of(F.coalesce("doc_id", F.lit(0))))
    begins = F.array_contains(F.array(*map(F.lit, starts)), F.col("doc_id")) if starts else F.lit(False)
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least)

    def to(where: Column, ahead: bool) -> Column:
        return F.struct(where.cast("int").alias("part"), F.lit(ahead).alias("ahead"))

    return (
        rows.withColumn("_own", part)
        .withColumn("_to", F.explode(F.array_compact(F.array(
            to(F.col("_own"), False), F.when(begins, to(F.col("_own") - 1, True)),
            F.when(first, to(F.lit(last), True))))))
        .select("_to.part", "_to.ahead", "doc_id", "text")
        .repartitionById(last + 1, F.col("part"))
        .sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text")
        .withColumn("doc_id", F.col("doc_id").cast("string"))
    )


EDITED = ("doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _compare(gram: int, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in EDITED.split(", ")]
        own: tuple | None = None
        for rows in batches:
            out = []
            for ahead, doc, text in zip(rows.ahead, rows.doc_id, rows.text):
                if ahead and own is None:
                    continue
                marks = fingerprint(text, gram, window)
                if own is not None:
                    was, before, before_marks = own
                    cut = len(before) // 4
                    edited = before[:len(before) - cut] + text[:cut]
                    edited_marks = fingerprint(edited, gram, window)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((was, len(before), digest, packed(before_marks), packed(edited_marks),
                                likeness(before_marks, edited_marks), likeness(before_marks, marks)))
                own = None if ahead else (doc, text, marks)
            yield pd.DataFrame(out, columns=names)
    return run


def digest(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text (the last quarter gives way to the
    beginning of the next document by id, the first after the last), and how alike its fingerprint is to
    the edited text's and to the next document's. Null texts are empty; repeated rows follow each other."""
    bound_batches(docs.sparkSession)
    compared = followed(docs).mapInPandas(_compare(gram, window), EDITED)
    return compared.withColumn("doc_id", F.col("doc_id").cast("long"))
