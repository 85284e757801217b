"""Tags that stand in one post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postflock.functions import text as tx


def pairs_in_post(posts: DataFrame, text: Column | None = None) -> DataFrame:
    """(post_id, tag, other), both directions. Made from the row's own tag array, so the self-join
    of the link table is never run. A post of at most 280 characters holds few tags."""
    found = posts.select("post_id", tx.tag_set(F.col("text") if text is None else text).alias("tags"))
    # The outer form keeps Spark from adding a filter on the array below, which would match the
    # pattern a second time for every text. Empty rows fall to the comparison.
    one = found.select("post_id", "tags", F.explode_outer("tags").alias("tag"))
    both = one.select("post_id", "tag", F.explode_outer("tags").alias("other"))
    return both.filter(F.col("tag") != F.col("other"))


def cooccurrence(posts: DataFrame) -> DataFrame:
    """(tag, other, n) over all posts, both directions. Half of the pairs are counted, with a
    map-side combine, and mirrored afterwards."""
    half = (
        pairs_in_post(posts).filter(F.col("tag") < F.col("other"))
        .groupBy("tag", "other").agg(F.count(F.lit(1)).alias("n"))
    )
    a, b, n = F.col("tag"), F.col("other"), F.col("n")
    return half.select(F.inline(F.array(
        F.struct(a.alias("tag"), b.alias("other"), n), F.struct(b.alias("tag"), a.alias("other"), n)
    )))
