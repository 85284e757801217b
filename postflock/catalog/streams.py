"""Streaming jobs run once over the tables as files, then read back."""

from pyspark.sql import functions as F

from postflock.catalog.registry import entry, qstamp, stamp
from postflock.operators.lexicon import default_lexicon
from postflock.session import work_dir
from postflock.streaming import live


def _stream(t, frame):
    """The frame as a folder of files, and a stream over it."""
    root = work_dir(t.spark, "stream")
    frame.write.parquet(f"{root}/in")
    return root, live.read_posts(t.spark, f"{root}/in", frame.schema)


@entry("st1_intake", """
SELECT DISTINCT user_id, text FROM (SELECT author AS user_id, text FROM text_posts WHERE length(text) BETWEEN 1 AND 280)""")
def intake(t):
    posts = t.text_posts.withColumnRenamed("author", "user_id")
    root, stream = _stream(t, posts)
    live.start_intake(stream, default_lexicon(t.spark), f"{root}/out", f"{root}/state").awaitTermination()
    return t.spark.read.parquet(f"{root}/out/posts").select("user_id", "text")


FILES = 5
#: Rows that one task writes of an arrival, at least.
FILE_ROWS = 200_000


def _arrivals(t, posts, file_rows=FILE_ROWS):
    """The posts as five arrivals in order of time, one post in ten twelve hours late, and one in seven once more in the
    next arrival: rows as a source may deliver them. Each arrival lies in equally many files, written side by side, and
    makes one micro-batch."""
    seconds = F.col("ts").cast("double")
    ends = posts.agg(F.min(seconds).alias("low"), F.max(seconds).alias("high"))
    late = F.when(F.col("post_id") % 10 == 0, 43_200).otherwise(0)
    place = F.least(F.floor((seconds + late - F.col("low")) * FILES / (F.col("high") - F.col("low") + 1)), F.lit(FILES - 1))
    rows = posts.crossJoin(F.broadcast(ends)).withColumn("_file", place)
    both = F.array("_file", F.least(F.col("_file") + 1, F.lit(FILES - 1)))
    copies = F.when(F.col("post_id") % 7 == 0, both).otherwise(F.array("_file"))
    rows = rows.withColumn("_file", F.explode(copies)).persist()
    found = [r[1] for r in rows.groupBy("_file").count().collect()]
    # Dealt in turn, with far more rows to a file than there are tasks: no file stays empty, so none is missing.
    parts = max(1, min(found) // file_rows) if len(found) == FILES else 1
    root = work_dir(t.spark, "stream")
    for i in range(FILES):
        one = rows.filter(F.col("_file") == i).select(*posts.columns)
        (one.coalesce(1) if parts == 1 else one.repartition(parts)).write.mode("append").parquet(f"{root}/in")
    rows.unpersist()
    return root, live.read_posts(t.spark, f"{root}/in", posts.schema, parts)


@entry("st2_trending", f"""
WITH e AS (SELECT min(epoch(ts)) AS low, max(epoch(ts)) AS high FROM posts),
a AS (SELECT post_id, ts, date_trunc('hour', ts) AS hour, CAST(least({FILES - 1}, floor(
  (epoch(ts) + CASE WHEN post_id % 10 = 0 THEN 43200 ELSE 0 END - low) * {FILES} / (high - low + 1))) AS BIGINT) AS file FROM posts, e),
b AS (SELECT batch, max(hour) AS as_of FROM a, range({FILES}) r(batch) WHERE file <= batch GROUP BY batch),
c AS (SELECT b.batch, as_of, tag, count(*) AS n FROM b JOIN a ON file <= b.batch AND hour > as_of - INTERVAL 24 HOUR
  JOIN post_tags USING (post_id) GROUP BY 1, 2, 3)
SELECT batch, {qstamp('as_of')} AS as_of, rank, tag, n AS "count" FROM (
  SELECT *, row_number() OVER (PARTITION BY batch ORDER BY n DESC, tag) AS rank FROM c) WHERE rank <= 10""")
def trending(t):
    """The ranking after each micro-batch."""
    root, stream = _arrivals(t, t.posts)
    live.start_ranking(stream, f"{root}/out", f"{root}/state").awaitTermination()
    found = t.spark.read.parquet(f"{root}/out/ranking")
    return found.select(F.col("batch").cast("long").alias("batch"), stamp("as_of", "as_of"), "rank", "tag", "count")


@entry("st2_windows", f"""
WITH h AS (SELECT post_id, tag, ts, date_trunc('hour', ts) AS hour FROM post_tags),
w AS (SELECT tag, hour - to_hours(CAST(k AS BIGINT)) AS start FROM h, range(24) r(k)),
late AS (SELECT t - INTERVAL 1 HOUR AS mark FROM latest)
SELECT {qstamp('start')} AS start, tag, count(*) AS "count" FROM w, late
WHERE start + INTERVAL 24 HOUR <= mark GROUP BY start, tag""")
def windows(t):
    root, stream = _stream(t, t.posts)
    live.start_trending(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select(stamp("start", "start"), "tag", "count")
