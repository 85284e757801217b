"""Saved clustering results: one JSON document and one CSV data set per run, and their catalogue."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from postflock.plans.cluster import Behaviour, members
from postflock.plans.stats import profile_texts
from postflock.schema import ANALYSIS

# Name parts of saved runs.
PREFIX = "user_clustering"
STAMP = "%Y%m%d_%H%M%S"
NAME = PREFIX + r"_([a-z]+)_(\d{8}_\d{6})\.json"
# Members stand in a data set beside the document, and up to this many users inside it as well.
INLINE_MEMBERS = 100_000


def result_document(
    run: Behaviour, summary: DataFrame, users: DataFrame, quality: float | None, stamp: str,
    inline_members: int = INLINE_MEMBERS,
) -> DataFrame:
    """One row in the ANALYSIS schema. Member lists are filled only while the user count is within
    ``inline_members``; ``saved_members`` has them whole, whatever their number."""
    joined = summary
    if run.user_count <= inline_members:
        people = F.array_sort(F.collect_list(F.struct("user_id", "username")))
        named = members(run.assigned, users).groupBy("cluster").agg(people.alias("_p"))
        joined = summary.join(named, "cluster").select(
            "*", F.transform("_p", lambda p: p["username"]).alias("usernames"),
            F.transform("_p", lambda p: p["user_id"]).alias("user_ids"),
        )
    else:
        joined = summary.withColumn("usernames", F.lit(None).cast("array<string>")).withColumn(
            "user_ids", F.lit(None).cast("array<bigint>")
        )
    entry = F.struct("size", "usernames", "avg_sentiment", "top_keywords", "top_hashtags", "user_ids")
    pairs = F.array_sort(F.collect_list(F.struct(F.col("cluster").cast("string").alias("key"), entry.alias("value"))))
    metric = "not available" if quality is None else f"Silhouette Score: {quality:.3f}"
    return joined.agg(F.map_from_entries(pairs).alias("cluster_analysis")).select(
        F.lit(run.method).alias("method"), F.lit(run.n_clusters).cast("long").alias("n_clusters"),
        F.lit(metric).alias("quality_metric"), F.lit(None).cast("string").alias("visualization_path"),
        F.lit(run.user_count).cast("long").alias("user_count"), F.lit(stamp).alias("timestamp"), "cluster_analysis",
    )


def feature_rows(run: Behaviour, posts: DataFrame, post_tags: DataFrame, users: DataFrame, means: DataFrame) -> DataFrame:
    """Per-user rows of the CSV dump. Texts come in parts for users with very many posts; their tags, by post and then by
    name, in the same parts."""
    counts = means.select("user_id", "posts")
    texts = profile_texts(posts, F.col("text"), counts=counts).withColumnRenamed("text", "tweet_text")
    marks = profile_texts(post_tags, F.col("tag"), counts=counts).withColumnRenamed("text", "hashtag_text")
    return (
        run.assigned.join(users.select("user_id", "username"), "user_id").join(means, "user_id")
        .join(texts, "user_id").join(marks, ["user_id", "chunk"], "left")
        .select(
            "user_id", "username", "chunk", "tweet_text",
            F.coalesce("hashtag_text", F.lit("")).alias("hashtag_text"), "avg_sentiment",
            F.col("posts").alias("tweet_count"), "x", "y", "cluster",
        )
    )


def save_analysis(
    run: Behaviour, document: DataFrame, rows: DataFrame, users: DataFrame, root: str,
    stamp: str | None = None, inline_members: int = INLINE_MEMBERS,
) -> str:
    """Write document, rows and members; returns the document's path. Only the document, whose size is bounded,
    goes through one task. Members are written whatever their number; ``inline_members`` only tells, for callers that
    also pass it to ``result_document``, up to which size the document names them too."""
    stamp = stamp or datetime.now().strftime(STAMP)
    path = f"{root}/{PREFIX}_{run.method}_{stamp}.json"
    document.coalesce(1).write.mode("overwrite").json(path)
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(
        f"{root}/{PREFIX}_data_{stamp}.csv"
    )
    members(run.assigned, users).write.mode("overwrite").json(f"{root}/{PREFIX}_members_{stamp}.jsonl")
    return path


def saved_members(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, user_id, username) of the run whose document is at ``path``: all members, at every size. Documents
    that other tools saved have no data set beside them and are read themselves."""
    root, name = path.rstrip("/").rsplit("/", 1)
    beside = f"{root}/{PREFIX}_members_{name.removesuffix('.json')[-15:]}.jsonl"
    try:
        return spark.read.schema("cluster long, user_id long, username string").json(beside)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    entries = by_cluster(read_analysis(spark, path))
    return entries.select(F.col("cluster").cast("long").alias("cluster"), F.inline(F.arrays_zip("user_ids", "usernames"))).toDF(
        "cluster", "user_id", "username")


def read_analysis(spark: SparkSession, path: str) -> DataFrame:
    """A saved document; single pretty-printed files are read too."""
    return spark.read.schema(ANALYSIS).option("multiLine", True).json(path)


def by_cluster(document: DataFrame) -> DataFrame:
    """(cluster, size, avg_sentiment, top_keywords, top_hashtags, ...) from a document."""
    entry = document.select(F.explode("cluster_analysis").alias("cluster", "e"))
    return entry.select("cluster", "e.*")


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """(filepath, method, timestamp, n_clusters, user_count), newest first. The stamp has a date
    and a time part and both are read."""
    docs = (
        spark.read.schema(ANALYSIS).option("multiLine", True).option("recursiveFileLookup", True)
        .json(f"{root}/{PREFIX}_*.json")
    )
    path = F.regexp_extract(F.col("_metadata.file_path"), rf"^(.*{NAME})", 1)
    method, stamp = (F.regexp_extract(F.col("_metadata.file_path"), NAME, i) for i in (1, 2))
    time = F.date_format(F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss")), "yyyy-MM-dd HH:mm:ss")
    listed = docs.select(
        path.alias("filepath"), method.alias("method"), time.alias("timestamp"), "n_clusters", "user_count"
    )
    return listed.filter(F.col("method") != "").orderBy(F.desc("timestamp"), "filepath")
