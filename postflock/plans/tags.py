"""Tag usage, trends, related and recommended tags."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from postflock.functions import time as tm, trend as tr
from postflock.operators.cooccur import cooccurrence, pairs_in_post
from postflock.operators.overlap import PLAIN_ROWS, top_by_sum
from postflock.operators.quantile import at_least, exact_quantile
from postflock.operators.ranking import top_k
from postflock.session import cut_lineage

TREND_QUANTILE = 0.8
FEATURES = ("posts", "recency", "trend_score")


def tag_usage(post_tags: DataFrame) -> DataFrame:
    return post_tags.groupBy("tag").agg(F.count(F.lit(1)).alias("posts"))


def last_hours(rows: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return rows.filter(F.col("ts") >= tm.hours_before(as_of, hours))


def trending(post_tags: DataFrame, as_of: Column, hours: int = 24, limit: int = 10) -> DataFrame:
    """Most used tags of the last hours."""
    counts = tag_usage(last_hours(post_tags, as_of, hours)).withColumnRenamed("posts", "count")
    return counts.orderBy(F.desc("count"), "tag").limit(limit)


def tag_features(post_tags: DataFrame, as_of: Column, decay: bool = False) -> DataFrame:
    """Posts, last use, age, recency and damped score per tag."""
    base = post_tags.groupBy("tag").agg(
        F.count(F.lit(1)).alias("posts"), F.max("ts").alias("last_updated")
    )
    aged = base.withColumn("hours", tm.hours_since(as_of, F.col("last_updated")))
    fresh = aged.withColumn("recency", tm.recency(F.col("hours"), decay))
    score = tr.damped_score(F.col("posts"), F.col("recency"), F.col("last_updated"))
    return fresh.withColumn("trend_score", score)


def trending_by_score(features: DataFrame, limit: int = 10) -> DataFrame:
    score = tr.product_score(*[F.col(c) for c in FEATURES])
    return features.select("tag", score.alias("score")).orderBy(F.desc("score"), "tag").limit(limit)


def trend_threshold(features: DataFrame) -> DataFrame:
    return exact_quantile(features, "trend_score", TREND_QUANTILE)


def standardised(features: DataFrame, columns=FEATURES) -> DataFrame:
    """Columns with mean 0 and population deviation 1; a constant column becomes 0. The moments
    are one aggregate row, used as scalar subqueries."""
    moments = features.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    )
    for c in columns:
        mean, deviation = moments.select(f"m_{c}").scalar(), moments.select(f"s_{c}").scalar()
        scaled = F.when(deviation > 0, (F.col(c) - mean) / deviation).otherwise(0.0)
        features = features.withColumn(f"z_{c}", scaled)
    return features


def trend_probability(features: DataFrame) -> DataFrame:
    """(tag, probability) of a logistic model for "score in the top fifth". With one class only
    the scaled trend score stands in. L2 strength 1/n equals the usual C = 1."""
    scaled = standardised(at_least(features, "trend_score", trend_threshold(features), "hot"))
    data = scaled.select(
        "tag", F.col("hot").cast("double").alias("label"), "z_trend_score",
        array_to_vector(F.array(*[f"z_{c}" for c in FEATURES])).alias("features"),
    ).persist()
    n, hot = data.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or hot in (0, n):
        return data.select("tag", F.col("z_trend_score").alias("probability"))
    model = LogisticRegression(regParam=1.0 / n, standardization=False, maxIter=1000).fit(data)
    ranked = cut_lineage(
        model.transform(data).select("tag", vector_to_array("probability")[1].alias("probability"))
    )
    data.unpersist()
    return ranked


def trending_by_model(features: DataFrame, limit: int = 10) -> DataFrame:
    return trend_probability(features).orderBy(F.desc("probability"), "tag").limit(limit)


def sharing_tags(posts: DataFrame) -> DataFrame:
    """Distinct (tag, other) with a post in common."""
    return pairs_in_post(posts).select("tag", "other").distinct()


def related(posts: DataFrame, post_tags: DataFrame, limit: int = 5) -> DataFrame:
    """Tags sharing a post with each tag, ranked by their total usage ``count``; ``co_count`` is
    the number of posts in common."""
    usage = tag_usage(post_tags).select(F.col("tag").alias("other"), F.col("posts").alias("count"))
    pairs = cooccurrence(posts).withColumnRenamed("n", "co_count").join(usage, "other")
    return top_k(pairs, ["tag"], [F.desc("count"), F.col("other")], limit)


def recent_tags(post_tags: DataFrame, posts: DataFrame, window: int = 20) -> DataFrame:
    """Distinct (user_id, tag) of each user's latest posts."""
    latest = top_k(posts.select("post_id", "user_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("post_id")], window)
    return latest.select("post_id", "user_id").join(post_tags.select("post_id", "tag"), "post_id").select("user_id", "tag").distinct()


def merged_scores(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(tag, score)`` lists added up, a missing side being 0."""
    both = first.join(second.withColumnRenamed("score", "_other"), "tag", "full_outer")
    zero = F.lit(0)
    return both.select("tag", (F.coalesce("score", zero) + F.coalesce("_other", zero)).alias("score"))


def recommended_tags(
    users: DataFrame, posts: DataFrame, post_tags: DataFrame, as_of: Column, limit: int = 10,
    trend_limit: int = 10, plain_rows: int = PLAIN_ROWS,
) -> DataFrame:
    """(user_id, tag, score, rank): twice the co-occurrence with the user's recent tags, those left
    out, plus the 24 h count of trending tags. Users without posts get the trending tags."""
    recent = recent_tags(post_tags, posts)
    wants = recent.select(F.col("user_id").alias("me"), F.col("tag").alias("key"))
    together = cooccurrence(posts).select(
        F.col("tag").alias("key"), F.col("other").alias("item"), (F.col("n") * 2).alias("v")
    )
    own = wants.select("me", F.col("key").alias("item"))
    hot = trending(post_tags, as_of, limit=trend_limit).select(F.col("tag").alias("item"), "count")
    # Only a trending tag can gain from the second term. The best `limit` others therefore stand
    # among the best `limit + trend_limit` of the first; trending tags are scored in full.
    first = top_by_sum(wants, together, limit + trend_limit, exclude=own, skip_self=False, plain_rows=plain_rows)
    others = first.join(hot, "item", "left_anti").select("me", "item", "score")
    to_hot = wants.join(together.join(hot.select("item"), "item", "left_semi"), "key")
    hot_sum = (
        to_hot.groupBy("me", "item").agg(F.sum("v").alias("_sum")).join(own, ["me", "item"], "left_anti")
    )
    # At most `trend_limit` trending tags, so they travel as one array per user.
    offer = hot.agg(F.collect_list(F.struct("item", "count"))).scalar()
    every = users.select(F.col("user_id").alias("me")).select("me", F.inline(offer))
    scored = every.join(hot_sum, ["me", "item"], "left").select(
        "me", "item", (F.col("count") + F.coalesce("_sum", F.lit(0))).alias("score")
    )
    best = top_k(others.unionByName(scored), ["me"], [F.desc("score"), F.col("item")], limit)
    return best.select(F.col("me").alias("user_id"), F.col("item").alias("tag"), "score", "rank")


def tag_page(posts: DataFrame, post_tags: DataFrame) -> DataFrame:
    """Posts of every tag, newest first within the tag, with the tag's usage."""
    rows = post_tags.select("post_id", "tag").join(posts.select("post_id", "user_id", "ts", "text"), "post_id")
    return rows.join(tag_usage(post_tags), "tag").orderBy("tag", F.desc("ts"), F.desc("post_id"))
