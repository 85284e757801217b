"""Exact length histogram: documents by their number of tokens, and what its suffix sums answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postflock.llm.common import bound_batches, running_total, stored, texts
from postflock.llm.tokens import VOCABULARY, token_count

BUCKET = 1024


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, documents): how many texts have so many tokens. Null texts count as empty, with 0 tokens;
    repeated rows count each; an empty table gives no rows. Texts are summed up where they are read: only
    (length, count) pairs are shuffled, at most one per length and task."""
    bound_batches(docs.sparkSession)
    counted = texts(docs).select(token_count("text", vocabulary).alias("length"))
    return counted.groupBy("length").agg(F.count("*").alias("documents"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit: documents, ``reaching`` (documents at least so
    long), ``longer``, ``tokens`` (all tokens of the documents at least so long), ``kept_tokens`` (total
    tokens if every document is cut at this limit), ``lost_tokens``, ``quantile`` (share of the documents of
    at most this length) and ``total_documents``. Sums run from the longest down, within ranges of
    ``BUCKET`` lengths and then over the ranges. The histogram is stored first: several branches of the plan
    read it, and none of them shall encode the texts again."""
    lengths = stored(lengths, "lengths-histogram")
    sums = lengths.withColumn("tokens_here", F.col("length") * F.col("documents"))
    order, bucket = [F.col("length").desc()], -F.floor(F.col("length") / BUCKET)
    for value, out in (("documents", "longer"), ("tokens_here", "tokens_longer")):
        sums = running_total(sums, [], bucket, order, value, out)
    total = lengths.agg(F.sum("documents").alias("total_documents"),
                        F.sum(F.col("length") * F.col("documents")).alias("total_tokens"))
    lost = F.col("tokens_longer") - F.col("length") * F.col("longer")
    return sums.crossJoin(F.broadcast(total)).select(
        "length", "documents",
        (F.col("documents") + F.col("longer")).alias("reaching"), "longer",
        (F.col("tokens_here") + F.col("tokens_longer")).alias("tokens"),
        (F.col("total_tokens") - lost).alias("kept_tokens"), lost.alias("lost_tokens"),
        (1 - F.col("longer") / F.col("total_documents")).alias("quantile"), "total_documents",
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, longer, kept_tokens, lost_tokens) for any limits, from the sums of the next longer
    length: documents that are longer than the limit are those that reach that length."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    all_tokens = sums.agg(F.max("tokens").alias("all_tokens"))
    above = asked.join(sums, F.col("length") > F.col("context_limit"), "left").groupBy("context_limit").agg(
        F.coalesce(F.max("reaching"), F.lit(0)).alias("longer"),
        F.coalesce(F.max("tokens"), F.lit(0)).alias("tokens"))
    lost = F.col("tokens") - F.col("context_limit") * F.col("longer")
    return above.crossJoin(F.broadcast(all_tokens)).select(
        "context_limit", "longer",
        (F.coalesce("all_tokens", F.lit(0)) - lost).alias("kept_tokens"), lost.alias("lost_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least this share of the documents does not exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return asked.join(sums, F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
