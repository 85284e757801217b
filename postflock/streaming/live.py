"""Continuous intake of posts, a rolling tag count and a tag ranking that is kept current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from postflock.functions import text as tx
from postflock.operators.lexicon import score_texts
from postflock.operators.ranking import top_k
from postflock.plans.ingest import link_tags, post_validity
from postflock.session import cut_lineage
from postflock.streaming.stored import Changes, SeenKeys


def read_posts(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def post_key():
    """The key by which two posts are the same one: user and text."""
    user = F.coalesce(F.col("user_id").cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat_ws(":", F.length(user), user, "text"), 256))


def accepted(posts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Valid posts, repeats of (user, text) dropped while the first is within the watermark."""
    valid = post_validity(posts).filter(F.col("reason") == "ok").drop("reason")
    return valid.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "text"])


def new_in_batch(batch: DataFrame, number: int, seen: SeenKeys) -> DataFrame:
    """Valid posts of a micro-batch whose (user, text) no earlier batch has taken, each once: the earliest, ties by
    a hash of the whole row. They are taken now. Running a batch again gives the same rows."""
    valid = post_validity(batch).filter(F.col("reason") == "ok").drop("reason")
    order = Window.partitionBy("_key").orderBy("ts", F.xxhash64(F.struct(*batch.columns)))
    first = valid.withColumn("_key", post_key()).withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")
    first = cut_lineage(first)
    known = seen.known(first.select(F.col("_key").alias("key")), number).withColumnRenamed("key", "_key")
    new = cut_lineage(first.join(known, "_key", "left_anti"))
    seen.take(new.select(F.col("_key").alias("key")), number)
    return new.drop("_key")


def intake_batch(target: str, lexicon: DataFrame):
    """What a micro-batch does: score new posts, store them and their tag links. Each batch writes into folders of its
    own number and reads only what lower numbers left, so a batch run again after a failure replaces its own files."""

    def store(batch: DataFrame, number: int) -> None:
        kept = new_in_batch(batch, number, SeenKeys(batch.sparkSession, f"{target}/seen"))
        score_texts(kept, lexicon).write.mode("overwrite").parquet(f"{target}/posts/batch={number}")
        link_tags(kept).write.mode("overwrite").parquet(f"{target}/post_tags/batch={number}")

    return store


def start_intake(posts: DataFrame, lexicon: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Score new posts and append posts and tag links. A (user, text) is taken once for ever: what has been taken lies
    in a key table under ``target``, so a repeat is dropped however late it comes, without state that grows in memory."""
    query = posts.writeStream.foreachBatch(intake_batch(target, lexicon)).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def rolling_counts(posts: DataFrame, span: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, end, tag, count) per sliding window."""
    tagged = posts.withWatermark("ts", late).select("ts", F.explode(tx.tag_set(F.col("text"))).alias("tag"))
    window = F.window("ts", span, slide)
    counted = tagged.groupBy(window.alias("w"), "tag").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tag", "count")


def start_trending(posts: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append closed windows; ``latest_ranking`` reads the newest one."""
    query = (
        rolling_counts(posts).writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
    )
    return query.trigger(**(trigger or {"availableNow": True})).start()


def latest_ranking(windows: DataFrame, limit: int = 10) -> DataFrame:
    newest = windows.agg(F.max("end")).scalar()
    return windows.filter(F.col("end") == newest).orderBy(F.desc("count"), "tag").limit(limit)


SPAN_HOURS = 24
SHOWN = 10
COUNTS = StructType().add("hour", "timestamp").add("tag", "string").add("count", "long").add("changed", "long")


def hourly_counts(posts: DataFrame) -> DataFrame:
    """(hour, tag, count) in whole hours, each post once by its id. State is kept for one hour more than the ranking
    reaches back: what comes later than that can neither be ranked any more nor be a repeat of something ranked."""
    late = f"{SPAN_HOURS + 1} hours"
    once = posts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["post_id"])
    tagged = once.select("ts", F.explode(tx.tag_set(F.col("text"))).alias("tag"))
    counted = tagged.groupBy(F.window("ts", "1 hour").alias("w"), "tag").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("w.start").alias("hour"), "tag", "count")


def newest_counts(rows: DataFrame) -> DataFrame:
    """Of each (hour, tag) the count that the latest batch gave, as far as the ranking reaches back."""
    span = rows.agg(F.max("hour") - F.expr(f"INTERVAL {SPAN_HOURS} HOURS")).scalar()
    return rows.filter(F.col("hour") > span).groupBy("hour", "tag").agg(
        F.max_by("count", "changed").alias("count"), F.max("changed").alias("changed"))


def ranked(counts: DataFrame, limit: int = SHOWN) -> DataFrame:
    """(rank, tag, count, as_of): the tags of the last 24 hours up to the newest hour."""
    newest = counts.agg(F.max("hour").alias("as_of"))
    sums = counts.groupBy("tag").agg(F.sum("count").alias("count"))
    first = top_k(sums.withColumn("_all", F.lit(0)), ["_all"], [F.desc("count"), F.col("tag")], limit).drop("_all")
    return first.crossJoin(F.broadcast(newest)).select(F.col("rank").cast("long").alias("rank"), "tag", "count", "as_of")


def ranking_batch(target: str, limit: int = SHOWN):
    """What a micro-batch of changed counts does: it puts them in place of the former ones and ranks the tags anew,
    under ``target/ranking/batch=n``. The counts are whole, not additions, so writing them again changes nothing."""

    def store(batch: DataFrame, number: int) -> None:
        changed = batch.withColumn("changed", F.lit(number).cast("long")).persist()
        if not changed.isEmpty():
            counts = Changes(batch.sparkSession, f"{target}/counts", COUNTS, newest_counts)
            counts.write(changed, number)
            ranked(counts.before(number + 1), limit).write.mode("overwrite").parquet(f"{target}/ranking/batch={number}")
        changed.unpersist()

    return store


def start_ranking(posts: DataFrame, target: str, checkpoint: str, limit: int = SHOWN, **trigger) -> StreamingQuery:
    """Keep the ranking of tags current: after every micro-batch with tags there is a new one."""
    query = (
        hourly_counts(posts).writeStream.outputMode("update").foreachBatch(ranking_batch(target, limit))
        .option("checkpointLocation", checkpoint)
    )
    return query.trigger(**(trigger or {"availableNow": True})).start()


def current_ranking(spark: SparkSession, target: str) -> DataFrame:
    """The newest ranking."""
    every = spark.read.parquet(f"{target}/ranking")
    return every.filter(F.col("batch") == every.agg(F.max("batch")).scalar()).drop("batch")
