"""Scalar functions, each over a whole table."""

from pyspark.sql import functions as F

from postflock.catalog.aggregates import FEATURES
from postflock.catalog.registry import WORD, clean_sql, entry, joined, q6, qstamp, r6, stamp
from postflock.functions import text as tx, time as tm, trend as tr
from postflock.plans import ingest as ig, stats as st, tags as tg

_TAGS = f"regexp_extract_all(text, '#({WORD}+)', 1)"


@entry("f01_clean_text", f"SELECT post_id, {clean_sql('text')} AS clean FROM text_posts")
def clean_text(t):
    return t.text_posts.select("post_id", tx.clean_text(F.col("text")).alias("clean"))


@entry("f02_raw_tags", f"SELECT post_id, array_to_string({_TAGS}, ' ') AS tags FROM posts")
def raw_tags(t):
    return t.posts.select("post_id", joined(tx.raw_tags(F.col("text")), "tags"))


@entry("f03_tags", f"SELECT post_id, lower(array_to_string({_TAGS}, ' ')) AS tags FROM posts")
def tags(t):
    return t.posts.select("post_id", joined(tx.tags(F.col("text")), "tags"))


@entry("f04_normalise", "SELECT post_id, lower(text) AS text FROM text_posts")
def normalise(t):
    return t.text_posts.select("post_id", tx.normalise_tag(F.col("text")).alias("text"))


@entry("f05_has_tag", """
SELECT post_id, count(*) FILTER (tag = 'click') > 0 AS has_click,
  count(*) + 1 - count(*) FILTER (tag = 'click') AS after_add FROM post_tags GROUP BY post_id""")
def has_tag(t):
    found = t.posts.select("post_id", tx.tag_set(F.col("text")).alias("s"))
    return found.select(
        "post_id", tx.has_tag(F.col("s"), "click").alias("has_click"),
        F.size(tx.add_tag(F.col("s"), F.lit("click"))).cast("long").alias("after_add"),
    )


@entry("f06_parse_time", f"SELECT row_no, {qstamp('ts')} AS ts FROM raw_clean")
def parse_time(t):
    return ig.prepare(t.raw_rows, t.as_of).select("row_no", stamp("ts", "ts"))


@entry("f07_safe_float", "SELECT row_no, sentiment_score FROM raw_clean")
def safe_float(t):
    return ig.prepare(t.raw_rows, t.as_of).select("row_no", "sentiment_score")


@entry("f08_sign_label", "SELECT row_no, sentiment_label FROM raw_clean")
def sign_label(t):
    return ig.prepare(t.raw_rows, t.as_of).select("row_no", "sentiment_label")


@entry("f09_polarity_label", "SELECT post_id, sentiment_label FROM posts")
def polarity_label(t):
    return t.posts.select("post_id", tx.polarity_label(F.col("sentiment_score")).alias("sentiment_label"))


@entry("f10_mood_label", """
SELECT user_id, CASE WHEN avg(sentiment_score) > 0.1 THEN 'positive' WHEN avg(sentiment_score) < -0.1 THEN 'negative'
  ELSE 'neutral' END AS mood FROM posts GROUP BY user_id""")
def mood_label(t):
    return st.profiles(t.posts).select("user_id", tx.mood_label(F.col("avg_sentiment")).alias("mood"))


@entry("f11_hours_since", f"""
SELECT post_id, {q6("(epoch_us(t) - epoch_us(ts)) / 3.6e9")} AS hours FROM posts, latest""")
def hours_since(t):
    return t.posts.select("post_id", r6(tm.hours_since(t.as_of, F.col("ts")), "hours"))


def _feature(name: str):
    def run(t):
        return tg.tag_features(t.post_tags, t.as_of).select("tag", r6(name, name))
    return run


entry("f12_recency", f"SELECT tag, {q6('recency')} AS recency FROM ({FEATURES})")(_feature("recency"))
entry("f13_damped_score", f"SELECT tag, {q6('trend_score')} AS trend_score FROM ({FEATURES})")(_feature("trend_score"))


@entry("f14_trend_product", f"SELECT tag, {q6('posts * recency * trend_score')} AS score FROM ({FEATURES})")
def trend_product(t):
    features = tg.tag_features(t.post_tags, t.as_of)
    score = tr.product_score(F.col("posts"), F.col("recency"), F.col("trend_score"))
    return features.select("tag", r6(score, "score"))


@entry("f15_period_start", """
SELECT post_id, CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS day,
  CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month
FROM posts""")
def period_start(t):
    frames = (("day", "daily"), ("week", "weekly"), ("month", "monthly"))
    return t.posts.select(
        "post_id", *[tm.period_start(F.col("ts"), f).cast("string").alias(n) for n, f in frames]
    )


@entry("f16_format_time", """
SELECT post_id, strftime(ts, '%B %d, %Y, %H:%M') AS long_stamp, strftime(ts, '%B %d, %Y') AS long_date,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM posts""")
def format_time(t):
    moment = F.col("ts")
    return t.posts.select(
        "post_id", tm.long_stamp(moment).alias("long_stamp"), tm.long_date(moment).alias("long_date"),
        tm.iso_stamp(moment).alias("iso"),
    )


@entry("f17_capitalize", "SELECT post_id, upper(sentiment_label[1]) || sentiment_label[2:] AS label FROM posts")
def capitalise(t):
    return t.posts.select("post_id", tx.capitalise(F.col("sentiment_label")).alias("label"))


@entry("f18_email", "SELECT user_id, username || '@example.com' AS email FROM users")
def email(t):
    return t.users.select("user_id", tx.synthetic_email(F.col("username")).alias("email"))


@entry("f19_filename_parts", """
SELECT user_id, 'dbscan' AS method, strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') AS timestamp
FROM posts GROUP BY user_id""")
def filename_parts(t):
    from postflock.sources.analyses import NAME

    stamped = F.concat(F.lit("user_clustering_dbscan_"), F.date_format(F.max("ts"), "yyyyMMdd_HHmmss"), F.lit(".json"))
    names = t.posts.groupBy("user_id").agg(stamped.alias("name"))
    time = F.try_to_timestamp(F.regexp_extract("name", NAME, 2), F.lit("yyyyMMdd_HHmmss"))
    return names.select(
        "user_id", F.regexp_extract("name", NAME, 1).alias("method"),
        F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    )


@entry("f20_label_share", f"""
SELECT user_id, {q6("count(*) FILTER (sentiment_label = 'positive') / greatest(count(*), 1)")} AS share
FROM posts GROUP BY user_id""")
def label_share(t):
    return st.profiles(t.posts).select("user_id", r6(tr.label_share(F.col("positive"), F.col("posts")), "share"))
