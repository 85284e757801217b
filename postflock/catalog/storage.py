"""Reading and writing: each query writes into a fresh folder and returns what it reads back."""

from pyspark.sql import functions as F

import uuid

from postflock.catalog.filters import _REQUESTS, follow_requests, profile_updates
from postflock.catalog.registry import SQL, entry, joined, q6, qstamp, r6, stamp
from postflock.operators.lexicon import default_lexicon
from postflock.plans import ingest as ig, report as rp, tags as tg
from postflock.session import work_dir
from postflock.sources import analyses, partitioned as pt, raw_csv, tables


@entry("s1_read_raw_csv", """
SELECT row_no AS raw_id, username, length(text) AS chars, sentiment_score FROM raw_clean WHERE filled""")
def read_raw(t):
    path = work_dir(t.spark, "raw")
    plain = F.regexp_replace("text", r"[^\x{0}-\x{ff}]", "?")
    raw_csv.write_raw_posts(t.raw_rows.withColumn("text", plain), path)
    rows = raw_csv.read_raw_posts(t.spark, path)
    good = rows.filter(~F.col("short"))
    prepared = ig.prepare(good, t.as_of).filter(F.col("status") == "ok")
    return prepared.join(good.select("row_no", "raw_id"), "row_no").select(
        F.col("raw_id").cast("long").alias("raw_id"), "username", F.length("text").cast("long").alias("chars"), "sentiment_score"
    )


@entry("s3_store_ingest", """
WITH good AS (SELECT *, row_number() OVER (PARTITION BY username, text ORDER BY row_no) AS rn FROM raw_clean WHERE filled)
SELECT 'users' AS name, count(DISTINCT username) AS stored FROM good
UNION ALL SELECT 'posts', count(*) FROM good WHERE rn = 1
UNION ALL SELECT 'rejects', (SELECT count(*) FROM raw_clean) - (SELECT count(*) FROM good WHERE rn = 1)""")
def store_ingest(t):
    loaded, root = ig.ingest(t.raw_rows, t.as_of), work_dir(t.spark, "ingest")
    names = ("users", "posts", "rejects")
    tables.append_tables({n: getattr(loaded, n) for n in names}, root)
    parts = [
        tables.read_table(t.spark, f"{root}/{n}").agg(F.count(F.lit(1)).alias("stored")).select(F.lit(n).alias("name"), "stored")
        for n in names
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _saved(t, stamp_text="20240131_120000"):
    root = work_dir(t.spark, "analysis")
    done = rp.clustering_analysis(t.users, t.posts, t.post_tags, root, n_clusters=3, restarts=1, stamp=stamp_text)
    return root, done


@entry("s4_save_analysis", "SELECT 'kmeans' AS method, count(DISTINCT user_id) AS user_count, '20240131_120000' AS timestamp FROM posts")
def save_analysis(t):
    _, done = _saved(t)
    return analyses.read_analysis(t.spark, done.path).select("method", "user_count", "timestamp")


@entry("s5_save_rows", f"""
SELECT user_id, username, string_agg(text, ' ' ORDER BY post_id) AS tweet_text, {q6('avg(sentiment_score)')} AS avg_sentiment,
  count(*) AS tweet_count FROM posts JOIN users USING (user_id) GROUP BY 1, 2""")
def save_rows(t):
    root, _ = _saved(t)
    rows = (
        t.spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .schema("user_id long, username string, chunk long, tweet_text string, hashtag_text string, "
                "avg_sentiment double, tweet_count long, x double, y double, cluster long")
        .csv(f"{root}/user_clustering_data_20240131_120000.csv")
    )
    return rows.select("user_id", "username", "tweet_text", r6("avg_sentiment", "avg_sentiment"), "tweet_count")


@entry("s6_read_analysis", "SELECT DISTINCT user_id, username FROM posts JOIN users USING (user_id)")
def read_analysis(t):
    _, done = _saved(t)
    return analyses.saved_members(t.spark, done.path).select("user_id", "username")


@entry("s7_catalogue", """
SELECT 'kmeans' AS method, '2024-01-31 12:00:00' AS timestamp, count(DISTINCT user_id) AS user_count FROM posts""")
def catalogue(t):
    root, _ = _saved(t)
    return analyses.catalogue(t.spark, root).select("method", "timestamp", "user_count")


@entry("s9_new_posts", """
SELECT post_id, length(text) AS chars FROM text_posts WHERE length(text) BETWEEN 1 AND 280""")
def new_posts(t):
    root = work_dir(t.spark, "new")
    valid, links, _ = ig.new_posts(t.text_posts, default_lexicon(t.spark))
    tables.append_tables({"posts": valid, "post_tags": links}, root)
    return tables.read_table(t.spark, f"{root}/posts").select("post_id", F.length("text").cast("long").alias("chars"))


@entry("r18_analysis")
def analysis(t):
    _, done = _saved(t)
    return done.summary.select(
        "cluster", "size", r6("avg_sentiment", "avg_sentiment"), joined("top_keywords", "top_keywords"),
        joined("top_hashtags", "top_hashtags"),
    )


def _posts_by_day(t, frame):
    return pt.posts_by_day(t.spark, work_dir(t.spark, "posts"), frame.schema).create(frame)


@entry("p2_stored_by_day", f"""
SELECT post_id, user_id, {qstamp('ts')} AS ts FROM posts, latest WHERE ts >= t - INTERVAL 24 HOUR""")
def stored_last_day(t):
    """P2 on posts stored by day: days before are not read."""
    return pt.last_hours(_posts_by_day(t, t.posts), t.as_of).select("post_id", "user_id", stamp("ts", "ts"))


@entry("r10_stored_by_day", """
SELECT tag, count(*) AS "count" FROM post_tags, latest WHERE ts >= t - INTERVAL 24 HOUR
GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 10""")
def stored_trending(t):
    """R10 on tag links stored by day."""
    recent = pt.last_hours(_posts_by_day(t, t.post_tags), t.as_of)
    return tg.trending(recent, t.as_of)


@entry("s3_bucketed_links", """
SELECT tag, sentiment_label, count(*) AS posts FROM posts JOIN post_tags USING (post_id) GROUP BY 1, 2""")
def bucketed_links(t):
    """Posts and their links from tables in buckets of post_id, joined without a shuffle."""
    mark, root = uuid.uuid4().hex, work_dir(t.spark, "bucketed")
    posts = pt.store_bucketed(t.posts, f"posts_{mark}", f"{root}/posts")
    links = pt.store_bucketed(t.post_tags.select("post_id", "tag"), f"links_{mark}", f"{root}/links")
    return links.join(posts, "post_id").groupBy("tag", "sentiment_label").agg(F.count(F.lit(1)).alias("posts"))


@entry("s9_stored_posts", """
SELECT post_id, length(text) AS chars FROM text_posts WHERE length(text) BETWEEN 1 AND 280""")
def stored_new_posts(t):
    """New posts put into a table that holds a part of them already, twice."""
    valid, _, _ = ig.new_posts(t.text_posts, default_lexicon(t.spark))
    table = _posts_by_day(t, valid.filter(F.col("post_id") % 3 == 0))
    for _ in range(2):
        pt.add_posts(table, valid)
    return table.rows().select("post_id", F.length("text").cast("long").alias("chars"))


@entry("s10_stored_deletes", """
SELECT post_id, user_id FROM posts p
WHERE NOT EXISTS (SELECT 1 FROM reactions r WHERE r.post_id = p.post_id AND r.user_id = p.user_id)""")
def stored_deletes(t):
    table = _posts_by_day(t, t.posts)
    for _ in range(2):
        pt.remove_posts(table, t.reactions)
    return table.rows().select("post_id", "user_id")


@entry("s11_stored_follows", f"""
SELECT * FROM (SELECT * FROM follows
UNION
SELECT q.* FROM {_REQUESTS} q WHERE follower_id <> followee_id
 AND follower_id IN (SELECT user_id FROM users) AND followee_id IN (SELECT user_id FROM users))
WHERE (follower_id, followee_id) NOT IN (SELECT (follower_id, followee_id) FROM {_REQUESTS} WHERE followee_id % 2 = 0)""")
def stored_follows(t):
    """All requests followed, then those to even users unfollowed, on a stored table."""
    table = pt.by_shard(t.spark, work_dir(t.spark, "follows"), t.follows.schema, "follower_id").create(t.follows)
    requests = follow_requests(t)
    pt.add_follows(table, requests, t.users)
    pt.remove_follows(table, requests.filter(F.col("followee_id") % 2 == 0))
    return table.rows()


@entry("p9_stored_profiles")
def stored_profiles(t):
    """P9 on users stored in shards."""
    table = pt.by_shard(t.spark, work_dir(t.spark, "users"), t.users.schema, "user_id").create(t.users)
    pt.update_profiles(table, profile_updates(t))
    return table.rows()


SQL["p9_stored_profiles"] = SQL["p9_profile_update"]
