"""Ranks and picks per group that stay safe when one group holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from postflock.session import cut_lineage

# Spark cuts each task to k rows per group before the shuffle only up to this k
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
SALTS = 64


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per group with their rank.

    For a small k Spark cuts every task to k rows per group before the shuffle, so a hot group
    moves k rows per task. Beyond that limit a salted first pass does the same cut.
    """
    if k > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        spread = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt).withColumn("_pre", F.row_number().over(spread))
            .filter(F.col("_pre") <= k).drop("_salt", "_pre")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window))
    return ranked.filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def first_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the least ``order`` per key. A partial aggregate, so hot keys shrink early."""
    rest = [c for c in df.columns if c not in keys and c != order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_first"))
    return picked.select(*keys, "_first.*").select(*df.columns)


def in_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` cut into ranges of ``order``, numbered in ``_range``: Spark draws the splitters from a sample of each
    task, so that ranges are about even whatever the data. Stored, as the numbers must not change."""
    return cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def bucketed_rank(
    df: DataFrame, group: Sequence[str], item: str, lead: Sequence[str] = (), rank: str = "rank"
) -> DataFrame:
    """Exact rank in each group by (``lead`` descending, ``item`` ascending).

    A plain window would sort a whole group in one task. Here all rows are cut into ranges of the order, a range is
    ranked alone, and the rows before it come from a running sum over the counts of a group's ranges: at most one row
    per range. ``item`` must be unique within (group, lead).
    """
    inner = [*[F.desc(c) for c in lead], F.col(item)]
    cells = [*group, "_range"]
    marked = in_ranges(df, [*[F.col(c) for c in group], *inner])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        marked.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*cells).orderBy(*inner))
    return (
        marked.withColumn("_inside", inside).join(starts, cells)
        .withColumn(rank, F.col("_start") + F.col("_inside"))
        .drop("_range", "_start", "_inside")
    )


def first_unexcluded(
    requests: DataFrame, ranked: DataFrame, exclusions: DataFrame, k: int
) -> DataFrame:
    """For each request the first ``k`` items of its group that it does not exclude.

    ``requests(me, grp)``, ``ranked(grp, item, rank)`` with ranks 1, 2, ... and
    ``exclusions(me, item)``, distinct. Someone with e exclusions in the group needs ranks up to
    k + e only, so the rows made grow with requests and exclusions, never with group size squared.
    """
    base = k + 1
    spent = (
        requests.join(exclusions, "me").join(ranked, ["grp", "item"])
        .groupBy("me", "grp").agg(F.count(F.lit(1)).alias("_spent"))
    )
    heads = (
        ranked.filter(F.col("rank") <= base).groupBy("grp")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("_head"))
    )
    near = requests.join(heads, "grp").select("me", F.inline("_head"))
    far = (
        spent.filter(F.col("_spent") + k > base)
        .select("me", "grp", F.explode(F.sequence(F.lit(base + 1), F.col("_spent") + k)).alias("rank"))
        .join(ranked, ["grp", "rank"]).select("me", "rank", "item")
    )
    offered = near.unionByName(far).join(exclusions, ["me", "item"], "left_anti")
    return top_k(offered.withColumnRenamed("rank", "_place"), ["me"], [F.col("_place")], k).drop("_place")


def dense_ids(df: DataFrame, value: str, name: str, buckets: int = 4096) -> DataFrame:
    """Distinct values with ids 1..n. Values are ranked inside hash buckets and shifted by the
    running count of buckets, so no task sees more than its share."""
    spread = (
        df.select(value).distinct()
        .withColumn("_bucket", F.pmod(F.xxhash64(value), F.lit(buckets)))
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        spread.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(value))
    return (
        spread.withColumn("_inside", inside).join(starts, "_bucket")
        .select(value, (F.col("_start") + F.col("_inside")).alias(name))
    )


def priority_union(sources: Sequence[DataFrame], k: int) -> DataFrame:
    """Merge ranked lists ``(me, item, rank)`` given in order of priority. An item keeps its best
    source; the first ``k`` per person remain, with a new rank and the source's number."""
    merged = None
    for number, source in enumerate(sources):
        part = source.select(
            "me", "item", F.struct(F.lit(number).cast("long").alias("source"), F.col("rank").cast("long").alias("place")).alias("_at")
        )
        merged = part if merged is None else merged.unionByName(part)
    best = merged.groupBy("me", "item").agg(F.min("_at").alias("_at")).select("me", "item", "_at.*")
    order = [F.col("source"), F.col("place"), F.col("item")]
    return top_k(best, ["me"], order, k).drop("place")
