"""Mixture-controlled packing: all documents into fixed-length sequences, sources mixed evenly.

Deficit round-robin serves one queue of documents per source. A window of ``window_tokens`` tokens gives each
source its share of them as credit; a source is served while it has credit, and what its last document takes
beyond the credit is carried on as a deficit to the next windows. After w windows a source has been given
``w * share * window_tokens`` tokens, so a document that stands behind ``before`` tokens of its queue is
served in window ``floor(before / (share * window_tokens))``, and inside the window the sources take turns in
the order of ``before / share``. Written so, the schedule needs running totals only: no task walks the queues,
and deficits pass partition borders by themselves.

The windows follow each other in one stream of tokens, which is cut every ``sequence_tokens``. Only the last
sequence can be shorter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from postflock.llm.common import bound_batches, running_total, stored, texts
from postflock.llm.tokens import VOCABULARY, encoder, id_width, packed_ids

SEQUENCE_TOKENS = 2048
WINDOW_TOKENS = 32 * SEQUENCE_TOKENS
WINDOWS_PER_RANGE = 4096
END_ID = 1

PIECES = ("doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, source string")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row_id, doc_id, source, tokens, ids), stored: ids packed, tokens with the end id. Row ids tell
    repeated rows apart; a null source is a queue of its own, named ''."""
    bound_batches(docs.sparkSession)
    rows = texts(docs, "source").select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        packed_ids("text", vocabulary).alias("ids"))
    tokens = F.floor(F.length("ids") / id_width(vocabulary)) + 1
    return stored(rows.withColumn("tokens", tokens), "packing-ids")


def schedule(
    queues: DataFrame, window_tokens: int = WINDOW_TOKENS, shares: DataFrame | None = None
) -> DataFrame:
    """Adds ``mix_window`` and ``position`` (in the stream of all tokens) to rows (row_id, source, tokens).

    ``shares(source, share)`` are the target proportions; by default each source's part of all tokens, with
    which all queues last to the end. With other shares a queue that runs dry leaves its credit unused, and
    later windows hold what the others are due. Sources without a share come last, one after the other.
    """
    part = F.shiftright("row_id", 33)
    rows = running_total(queues, ["source"], part, ["row_id"], "tokens", "before")
    if shares is None:
        sums = queues.groupBy("source").agg(F.sum("tokens").alias("_tokens"))
        total = sums.agg(F.sum("_tokens").alias("_total"))
        shares = sums.crossJoin(F.broadcast(total)).select("source", (F.col("_tokens") / F.col("_total")).alias("share"))
    rows = rows.join(shares.filter("share > 0").select("source", "share"), "source", "left")
    rows = rows.withColumn("turn", F.col("before") / F.col("share"))
    rows = rows.withColumn("mix_window", F.coalesce(F.floor(F.col("turn") / window_tokens), F.lit((1 << 62) - 1)))
    sums = rows.groupBy("mix_window").agg(F.sum("tokens").alias("_tokens"))
    starts = running_total(sums, [], F.floor(F.col("mix_window") / WINDOWS_PER_RANGE), ["mix_window"], "_tokens", "_start")
    inside = Window.partitionBy("mix_window").orderBy(F.col("turn").asc_nulls_last(), "source", "row_id")
    return (
        rows.withColumn("_inside", F.coalesce(
            F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(starts.select("mix_window", "_start"), "mix_window")
        .withColumn("position", F.col("_start") + F.col("_inside"))
        .select(*queues.columns, "mix_window", "position")
    )


def _cutter(vocabulary: str, sequence_tokens: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(vocabulary)
        end = END_ID.to_bytes(4, "little")
        for rows in batches:
            out = []
            for doc, source, tokens, packed, at in zip(rows.doc_id, rows.source, rows.tokens, rows.ids, rows.position):
                ids = memoryview(own.ids(packed).tobytes() + end)
                start = 0
                while start < tokens:
                    sequence, offset = divmod(at + start, sequence_tokens)
                    length = min(tokens - start, sequence_tokens - offset)
                    crc = zlib.crc32(ids[4 * start:4 * (start + length)])
                    out.append((doc, start, length, crc, tokens, sequence, offset, source))
                    start += length
            names = [field.split()[0] for field in PIECES.split(", ")]
            yield pd.DataFrame(out, columns=names)
    return cut


def pack(
    docs: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, window_tokens: int = WINDOW_TOKENS,
    shares: DataFrame | None = None, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """One row per piece. A null or empty text is its end id alone; repeated rows are packed each; a null
    doc_id stays null; an empty table gives no pieces."""
    coded = encode(docs, vocabulary)
    placed = schedule(coded.select("row_id", "source", "tokens"), window_tokens, shares)
    rows = coded.join(placed.select("row_id", "position"), "row_id").select(
        F.col("doc_id").cast("string").alias("doc_id"), "source", "tokens", "ids", "position")
    pieces = rows.mapInPandas(_cutter(vocabulary, sequence_tokens), PIECES)
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))
