"""The social model over a folder of parquet tables (see FIXTURES.md for the derivations)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from postflock.functions import text as tx


#: Bytes of text that one task takes apart.
TEXT_BYTES = 16_000_000


class SocialTables:
    """Lazy frames of the social model. Nothing runs until a frame is used in an action, but for the size of all texts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        name = F.col("c_name")
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"),
            name.alias("username"),
            tx.synthetic_email(F.lower(F.regexp_replace(name, "#", ""))).alias("email"),
            F.col("c_mktsegment").alias("bio"),
        )

    @cached_property
    def posts(self) -> DataFrame:
        text = F.concat(
            F.lit("#"), F.upper("event_type"),
            F.lit(" #k"), F.get_json_object("props", "$.k"),
            F.lit(" #v"), F.floor(F.col("value") / 10).cast("string"),
        )
        score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 50))
        return self.table("events").select(
            F.col("event_id").alias("post_id"), "user_id",
            F.col("ts").cast("timestamp").alias("ts"), text.alias("text"),
            score.alias("sentiment_score"), tx.polarity_label(score).alias("sentiment_label"),
        )

    @cached_property
    def post_tags(self) -> DataFrame:
        """One row per post and distinct tag; made inside each row, so without a shuffle."""
        return self.posts.select(
            "post_id", "user_id", "ts", F.explode(tx.tag_set(F.col("text"))).alias("tag")
        )

    @cached_property
    def as_of(self):
        """Newest post time as a scalar subquery."""
        return self.posts.agg(F.max("ts")).scalar()

    @cached_property
    def follows(self) -> DataFrame:
        people = self.table("events").agg(F.max("user_id") + 1).scalar()
        urgent = self.table("orders").filter(
            (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
        )
        edges = urgent.select(
            (F.col("o_custkey") % people).alias("follower_id"),
            (F.col("o_orderkey") * 31 % people).alias("followee_id"),
        )
        return edges.filter(F.col("follower_id") != F.col("followee_id")).distinct()

    @cached_property
    def reactions(self) -> DataFrame:
        posts = self.table("events").agg(F.count(F.lit(1))).scalar()
        first = self.table("lineitem").filter(
            (F.col("l_linenumber") == 1) & F.col("l_returnflag").isin("R", "A")
        )
        return first.select(
            F.col("l_suppkey").alias("user_id"),
            (F.col("l_orderkey") % posts).alias("post_id"),
            F.when(F.col("l_returnflag") == "R", "retweet").otherwise("like").alias("kind"),
        )

    @cached_property
    def text_posts(self) -> DataFrame:
        docs = self.table("documents").select(
            F.col("doc_id").alias("post_id"),
            F.concat_ws("_", "source", "lang").alias("author"), "text",
        )
        times = self.table("events").select(
            F.col("event_id").alias("post_id"), F.col("ts").cast("timestamp").alias("ts")
        )
        # Spread by the join key before the join: the texts would be shuffled by it anyway, and a
        # small or badly split file is worked on by all tasks.
        return self._spread(docs).join(times, "post_id")

    def _spread(self, docs: DataFrame) -> DataFrame:
        """Texts dealt by post. Their words take many times the room of the compressed texts, by which Spark merges
        partitions; so where there is much text its measured size sets the number of tasks."""
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        tasks = size // TEXT_BYTES
        if tasks <= self.spark.sparkContext.defaultParallelism:
            return docs.repartition("post_id")
        return docs.repartition(max(tasks, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "post_id")

    @cached_property
    def scored_text_posts(self) -> DataFrame:
        """Text posts with a score where the label table has one, else NULL."""
        marks = self.table("labels").select(
            F.col("doc_id").alias("post_id"),
            (F.col("quality") - F.col("toxic")).cast("double").alias("sentiment_score"),
        )
        label = F.when(
            F.col("sentiment_score").isNotNull(), tx.sign_label(F.col("sentiment_score"))
        )
        return self.text_posts.join(marks, "post_id", "left").withColumn("sentiment_label", label)

    @cached_property
    def raw_rows(self) -> DataFrame:
        """Rows in the raw file form: every field a text, words and lines as they come."""
        scored = self.scored_text_posts
        return scored.select(
            F.col("post_id").alias("row_no"),
            F.coalesce(F.col("sentiment_score").cast("long").cast("string"), F.lit("n/a")).alias("sentiment"),
            F.col("post_id").cast("string").alias("raw_id"),
            F.date_format("ts", "EEE MMM dd HH:mm:ss 'PDT' yyyy").alias("time_text"),
            F.lit("NO_QUERY").alias("flag"),
            F.col("author").alias("username"), "text",
        )
