"""Follow and reaction graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postflock.operators.overlap import PLAIN_ROWS, top_by_sum
from postflock.operators.ranking import top_k


def followed_feed(follows: DataFrame, posts: DataFrame) -> DataFrame:
    """(follower_id, post columns): posts of everyone each user follows."""
    return follows.select("follower_id", F.col("followee_id").alias("user_id")).join(posts, "user_id")


def newest_feed(follows: DataFrame, posts: DataFrame, limit: int = 10) -> DataFrame:
    """Newest posts of each user's feed. Every author is cut to ``limit`` posts before the join:
    no feed can show more of one author, so a busy author adds ``limit`` rows per follower."""
    order = [F.desc("ts"), F.desc("post_id")]
    latest = top_k(posts, ["user_id"], order, limit).drop("rank")
    return top_k(followed_feed(follows, latest), ["follower_id"], order, limit)


def follow_counts(users: DataFrame, follows: DataFrame) -> DataFrame:
    def counted(end: str, name: str) -> DataFrame:
        return follows.groupBy(F.col(end).alias("user_id")).agg(F.count(F.lit(1)).alias(name))

    return (
        users.select("user_id")
        .join(counted("followee_id", "followers"), "user_id", "left")
        .join(counted("follower_id", "following"), "user_id", "left")
        .na.fill(0, ["followers", "following"])
    )


def follow_lists(follows: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, side, other_id, other_name): both lists of each user in long form."""
    names = users.select(F.col("user_id").alias("other_id"), F.col("username").alias("other_name"))
    a, b = F.col("follower_id"), F.col("followee_id")
    ends = follows.select(F.inline(F.array(
        F.struct(b.alias("user_id"), F.lit("follower").alias("side"), a.alias("other_id")),
        F.struct(a.alias("user_id"), F.lit("following").alias("side"), b.alias("other_id")),
    )))
    return ends.join(names, "other_id").select("user_id", "side", "other_id", "other_name")


def relations(pairs: DataFrame, follows: DataFrame) -> DataFrame:
    """``pairs(user_id, other_id)`` with flags for both directions of following."""
    out = follows.select(
        F.col("follower_id").alias("user_id"), F.col("followee_id").alias("other_id"), F.lit(True).alias("_out")
    )
    back = out.select(
        F.col("other_id").alias("user_id"), F.col("user_id").alias("other_id"), F.col("_out").alias("_back")
    )
    keys = ["user_id", "other_id"]
    return pairs.join(out, keys, "left").join(back, keys, "left").select(
        *keys, F.col("_out").isNotNull().alias("is_following"), F.col("_back").isNotNull().alias("is_followed_by")
    )


def friends_of_friends(
    follows: DataFrame, limit: int = 10, plain_rows: int = PLAIN_ROWS
) -> DataFrame:
    """(user_id, other_id, paths, rank): the people most followed by those one follows, without
    oneself and those already followed."""
    edges = follows.select("follower_id", "followee_id")
    best = top_by_sum(
        edges.toDF("me", "key"),
        edges.toDF("key", "item").withColumn("v", F.lit(1).cast("long")),
        limit, exclude=edges.toDF("me", "item"), plain_rows=plain_rows,
    )
    return best.select(
        F.col("me").alias("user_id"), F.col("item").alias("other_id"), F.col("score").alias("paths"), "rank"
    )


def reaction_edges(reactions: DataFrame, posts: DataFrame) -> DataFrame:
    """(source, target, type): reader to author of the post."""
    authors = posts.select("post_id", F.col("user_id").alias("target"))
    return reactions.join(authors, "post_id").select(
        F.col("user_id").alias("source"), "target", F.col("kind").alias("type")
    )


def links(follows: DataFrame, reactions: DataFrame, posts: DataFrame) -> DataFrame:
    """All typed links of the interaction network."""
    followed = follows.select(
        F.col("follower_id").alias("source"), F.col("followee_id").alias("target"), F.lit("follow").alias("type")
    )
    return followed.unionByName(reaction_edges(reactions, posts))


def network(users: DataFrame, all_links: DataFrame) -> DataFrame:
    """Nodes with their links counted by type and direction; users without links stay."""
    kinds = ("follow", "retweet", "like")

    def side(column: str, suffix: str) -> DataFrame:
        return all_links.groupBy(F.col(column).alias("user_id")).agg(
            *[F.count_if(F.col("type") == k).alias(f"{k}_{suffix}") for k in kinds]
        )

    names = [f"{k}_{s}" for s in ("out", "in") for k in kinds]
    return (
        users.select("user_id", "username").join(side("source", "out"), "user_id", "left")
        .join(side("target", "in"), "user_id", "left").na.fill(0, names)
    )
