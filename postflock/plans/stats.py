"""Counts, sentiment statistics, trends over time and user profiles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from postflock.functions import text as tx, time as tm
from postflock.operators.ranking import top_k

# Order and colours of the sentiment chart.
CHART = (("Positive", "#28a745"), ("Neutral", "#6c757d"), ("Negative", "#dc3545"))
LABELS = ("positive", "neutral", "negative")
TEXT_CHUNK = 10_000


def label_counts() -> list:
    return [F.count_if(F.col("sentiment_label") == name).alias(name) for name in LABELS]


def totals(users: DataFrame, posts: DataFrame) -> DataFrame:
    by_name = [
        users.agg(F.count(F.lit(1)).alias("total")).select(F.lit("users").alias("name"), "total"),
        posts.agg(F.count(F.lit(1)).alias("total")).select(F.lit("posts").alias("name"), "total"),
    ]
    return by_name[0].unionByName(by_name[1])


def posts_per_user(posts: DataFrame) -> DataFrame:
    return posts.groupBy("user_id").agg(F.count(F.lit(1)).alias("posts"))


def top_posters(posts: DataFrame, users: DataFrame, limit: int = 5) -> DataFrame:
    """Counted before the join, so the join sees ``limit`` rows."""
    best = posts_per_user(posts).orderBy(F.desc("posts"), "user_id").limit(limit)
    return best.join(users.select("user_id", "username"), "user_id")


def sample_posts(posts: DataFrame) -> DataFrame:
    """First post of each user with a short view of it."""
    first = posts.groupBy("user_id").agg(F.min(F.struct("post_id", "text")).alias("f"))
    return first.select("user_id", F.col("f.post_id").alias("post_id"), tx.preview(F.col("f.text")).alias("sample"))


def sentiment_stats(posts: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Counts, shares in percent and mean score per user. With ``users`` those without posts are
    listed too, with zeros and a NULL mean."""
    total = F.count(F.lit(1)).alias("total")
    stats = posts.groupBy("user_id").agg(*label_counts(), total, F.avg("sentiment_score").alias("average_score"))
    if users is not None:
        stats = users.select("user_id").join(stats, "user_id", "left").na.fill(0, [*LABELS, "total"])
    shares = [
        F.when(F.col("total") > 0, F.col(n) / F.col("total") * 100).otherwise(0.0).alias(f"{n}_percent")
        for n in LABELS
    ]
    return stats.select("*", *shares)


def chart_data(stats: DataFrame) -> DataFrame:
    """Chart arrays, Positive, Neutral, Negative."""
    names = F.array(*[F.lit(n) for n, _ in CHART])
    colours = F.array(*[F.lit(c) for _, c in CHART])
    counts = F.array(*[F.col(n.lower()) for n, _ in CHART])
    return stats.withColumn(
        "chart_data", F.struct(names.alias("labels"), counts.alias("data"), colours.alias("colours"))
    )


def sentiment_trend(posts: DataFrame, timeframe: str = "weekly") -> DataFrame:
    scored = posts.filter(F.col("sentiment_score").isNotNull() & F.col("sentiment_label").isNotNull())
    period = tm.period_start(F.col("ts"), timeframe).alias("period")
    return scored.groupBy(period).agg(*label_counts(), F.avg("sentiment_score").alias("average_score"))


def trend_arrays(trend: DataFrame) -> DataFrame:
    """The trend as one row of parallel arrays in date order. The input has one row per period, so
    its size is set by the calendar."""
    columns = ["period", *LABELS, "average_score"]
    ordered = F.array_sort(F.collect_list(F.struct(*columns)))
    one = trend.agg(ordered.alias("r"))
    return one.select(*[F.col("r")[c].alias(c) for c in columns])


def profiles(posts: DataFrame) -> DataFrame:
    """Mean score (0 for none), label counts and post count per user."""
    return posts.groupBy("user_id").agg(
        F.coalesce(F.avg("sentiment_score"), F.lit(0.0)).alias("avg_sentiment"),
        *label_counts(), F.count(F.lit(1)).alias("posts"),
    )


def profile_texts(
    posts: DataFrame, text, chunk: int = TEXT_CHUNK, order: str = "post_id", counts: DataFrame | None = None
) -> DataFrame:
    """Texts joined by a blank in post order, (user_id, chunk, text). ``counts(user_id, posts)`` spares the counting
    where it is known.

    Users with at most ``chunk`` posts have one row. For heavier users the id range is cut into
    parts of ``chunk`` ids, so no task ever holds more than ``chunk`` texts of one user; reading
    the parts in order gives the whole text.
    """
    counts = posts_per_user(posts) if counts is None else counts
    # At most one row per ``chunk`` posts, so the posts are moved once, by user and part.
    heavy = F.broadcast(counts.filter(F.col("posts") > chunk).select("user_id", F.lit(True).alias("_heavy")))
    number = F.when(F.col("_heavy"), F.floor(F.col(order) / chunk)).otherwise(F.lit(0))
    rows = posts.join(heavy, "user_id", "left").select(
        "user_id", number.alias("chunk"), F.col(order).alias("_o"), text.alias("_t")
    )
    pieces = F.array_sort(F.collect_list(F.struct("_o", "_t")))
    return rows.groupBy("user_id", "chunk").agg(
        F.array_join(F.transform(pieces, lambda p: p["_t"]), " ").alias("text")
    )


def recent_posts(posts: DataFrame, limit: int = 10) -> DataFrame:
    return top_k(posts, ["user_id"], [F.desc("ts"), F.desc("post_id")], limit)


def newest(posts: DataFrame, limit: int) -> DataFrame:
    return posts.orderBy(F.desc("ts"), F.desc("post_id")).limit(limit)


def schema_report(tables: Mapping[str, DataFrame], keys: Mapping[str, str]) -> DataFrame:
    """(table_name, column_name, data_type, row_count, sample): one row per column, the sample
    being taken from the row with the least key. One aggregate per table."""
    report = None
    for name, frame in tables.items():
        texts = [F.col(c).cast("string").alias(c) for c in frame.columns]
        facts = frame.agg(
            F.count(F.lit(1)).alias("row_count"), F.min_by(F.struct(*texts), keys[name]).alias("s")
        )
        columns = F.array(*[
            F.struct(
                F.lit(c).alias("column_name"), F.lit(t).alias("data_type"),
                F.coalesce(F.col("s")[c], F.lit("")).alias("sample"),
            ) for c, t in frame.dtypes
        ])
        part = facts.select(F.lit(name).alias("table_name"), "row_count", F.inline(columns))
        report = part if report is None else report.unionByName(part)
    return report
