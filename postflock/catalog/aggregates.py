"""Aggregates and cluster reports. Clusters stand in as ``user_id % 3`` here, so that the reports
can be checked in SQL; fitted clusters are in ``learned``."""

from pyspark.sql import functions as F

from postflock.catalog.registry import entry, joined, q6, r6
from postflock.catalog.weights import tfidf_sql
from postflock.operators.cooccur import cooccurrence
from postflock.plans import cluster as cl, ingest as ig, recommend as rc, stats as st, tags as tg

LABELS = ", ".join(f"count(*) FILTER (sentiment_label = '{n}') AS {n}" for n in st.LABELS)


def fixed_clusters(t):
    return t.posts.select("user_id").distinct().withColumn("cluster", F.col("user_id") % 3)


@entry("a1_totals", "SELECT 'users' AS name, count(*) AS total FROM users UNION ALL SELECT 'posts', count(*) FROM posts")
def totals(t):
    return st.totals(t.users, t.posts)


@entry("a2_distinct_posters", "SELECT count(DISTINCT user_id) AS posters FROM posts")
def distinct_posters(t):
    return t.posts.agg(F.count_distinct("user_id").alias("posters"))


@entry("a3_top_posters", """
SELECT user_id, username, count(*) AS posts FROM posts JOIN users USING (user_id)
GROUP BY 1, 2 HAVING count(*) > 0 ORDER BY posts DESC, user_id LIMIT 5""")
def top_posters(t):
    return st.top_posters(t.posts, t.users)


@entry("a4_tag_usage", "SELECT * FROM usage")
def tag_usage(t):
    return tg.tag_usage(t.post_tags)


@entry("a6_sentiment_stats", f"""
SELECT user_id, {LABELS}, count(*) AS total, {q6('avg(sentiment_score)')} AS average_score,
 {", ".join(q6(f"count(*) FILTER (sentiment_label = '{n}') / count(*) * 100") + f" AS {n}_percent" for n in st.LABELS)}
FROM posts GROUP BY user_id""")
def sentiment_stats(t):
    stats = st.sentiment_stats(t.posts)
    numbers = [r6(c, c) for c in ("average_score", *[f"{n}_percent" for n in st.LABELS])]
    return stats.select("user_id", *st.LABELS, "total", *numbers)


def _trend(unit: str) -> str:
    return f"""SELECT CAST(CAST(date_trunc('{unit}', ts) AS DATE) AS VARCHAR) AS period, {LABELS},
 {q6('avg(sentiment_score)')} AS average_score FROM posts GROUP BY 1"""


def _trend_query(timeframe):
    def run(t):
        trend = st.sentiment_trend(t.posts, timeframe)
        return trend.select(F.col("period").cast("string").alias("period"), *st.LABELS, r6("average_score", "average_score"))
    return run


for _name, _frame, _unit in (("day", "daily", "day"), ("week", "weekly", "week"), ("month", "monthly", "month")):
    entry(f"a7_trend_{_name}", _trend(_unit))(_trend_query(_frame))


@entry("a8_profiles", f"""
SELECT user_id, {q6('avg(sentiment_score)')} AS avg_sentiment, {LABELS}, count(*) AS posts,
  string_agg(text, ' ' ORDER BY post_id) AS text, 0 AS chunk FROM posts GROUP BY user_id""")
def profiles(t):
    texts = st.profile_texts(t.posts, F.col("text"))
    facts = st.profiles(t.posts).withColumn("avg_sentiment", r6("avg_sentiment", "x"))
    return facts.join(texts, "user_id")


@entry("a9_cooccurrence_map", "SELECT tag, other, n FROM cooc")
def cooccurrence_map(t):
    return cooccurrence(t.posts)


FEATURES = """
SELECT tag, posts, last, hours, 1 + least(1.0, hours / 24) AS recency,
  ln(posts + 1) * (1 + least(1.0, hours / 24)) AS trend_score
FROM (SELECT tag, count(*) AS posts, max(ts) AS last,
  (epoch_us(any_value(t)) - epoch_us(max(ts))) / 3.6e9 AS hours FROM post_tags, latest GROUP BY tag)"""


@entry("a11_trend_threshold", f"SELECT {q6('quantile_cont(trend_score, 0.8)')} AS threshold FROM ({FEATURES})")
def trend_threshold(t):
    return tg.trend_threshold(tg.tag_features(t.post_tags, t.as_of)).select(r6("threshold", "threshold"))


_CLUSTERS = "(SELECT DISTINCT user_id, user_id % 3 AS cluster FROM posts)"
_TEXT = "SELECT user_id AS doc, text FROM posts"
_SUMMARY = f"""
WITH c AS {_CLUSTERS}, w AS ({tfidf_sql(_TEXT, max_features=100)}),
means AS (SELECT user_id, avg(sentiment_score) AS m FROM posts GROUP BY 1),
size AS (SELECT cluster, count(*) AS size, avg(m) AS avg_sentiment FROM c JOIN means USING (user_id) GROUP BY 1),
words AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY round(sum(w) / any_value(size), 9) DESC, term) AS rn
  FROM w JOIN c ON c.user_id = w.doc JOIN size USING (cluster) GROUP BY 1, 2),
marks AS (SELECT cluster, tag, row_number() OVER (PARTITION BY cluster ORDER BY sum(n) DESC, tag) AS rn
  FROM user_tags JOIN c USING (user_id) GROUP BY 1, 2),
full_summary AS (SELECT cluster, size, avg_sentiment,
  (SELECT string_agg(term, ' ' ORDER BY term) FROM words x WHERE x.cluster = s.cluster AND rn <= 10) AS top_keywords,
  (SELECT string_agg(tag, ' ' ORDER BY rn) FROM marks x WHERE x.cluster = s.cluster AND rn <= 10) AS top_hashtags,
  (SELECT string_agg(term, ' ' ORDER BY term) FROM (SELECT term FROM words x WHERE x.cluster = s.cluster AND rn <= 10 ORDER BY term LIMIT 3)) AS first_keywords,
  (SELECT string_agg(tag, ' ' ORDER BY rn) FROM marks x WHERE x.cluster = s.cluster AND rn <= 3) AS first_hashtags
  FROM size s)
"""


def _summary(t):
    return cl.summary(fixed_clusters(t), t.posts, t.post_tags, cl.text_weights(t.posts))


@entry("a12_cluster_summary", f"""{_SUMMARY}
SELECT cluster, size, {q6('avg_sentiment')} AS avg_sentiment, top_keywords, top_hashtags FROM full_summary""")
def cluster_summary(t):
    return _summary(t).select(
        "cluster", "size", r6("avg_sentiment", "avg_sentiment"), joined("top_keywords", "top_keywords"),
        joined("top_hashtags", "top_hashtags"),
    )


@entry("a12_cluster_members", f"SELECT cluster, user_id, username FROM {_CLUSTERS} JOIN users USING (user_id)")
def cluster_members(t):
    return cl.members(fixed_clusters(t), t.users).select("cluster", "user_id", "username")


@entry("a13_cluster_short", f"""{_SUMMARY}
SELECT cluster, size, {q6('avg_sentiment')} AS avg_sentiment, first_keywords AS top_keywords, first_hashtags AS top_hashtags
FROM full_summary""")
def cluster_short(t):
    return cl.short_summary(_summary(t)).select(
        "cluster", "size", r6("avg_sentiment", "avg_sentiment"), joined("top_keywords", "top_keywords"),
        joined("top_hashtags", "top_hashtags"),
    )


@entry("a15_cluster_mood", f"""{_SUMMARY}
SELECT cluster, size, {q6('avg_sentiment')} AS avg_sentiment,
  CASE WHEN avg_sentiment > 0.1 THEN 'positive' WHEN avg_sentiment < -0.1 THEN 'negative' ELSE 'neutral' END AS label
FROM full_summary""")
def cluster_mood(t):
    return cl.mood(_summary(t)).select("cluster", "size", r6("avg_sentiment", "avg_sentiment"), "label")


@entry("a16_cluster_keywords", f"{_SUMMARY} SELECT cluster, size, top_keywords FROM full_summary")
def cluster_keywords(t):
    return cl.keywords(_summary(t)).select("cluster", "size", joined("top_keywords", "top_keywords"))


@entry("a17_cluster_tags", f"{_SUMMARY} SELECT cluster, size, top_hashtags FROM full_summary")
def cluster_tags(t):
    return cl.hashtags(_summary(t)).select("cluster", "size", joined("top_hashtags", "top_hashtags"))


@entry("m18_cluster_terms", f"""{_SUMMARY}
SELECT cluster, term, rn AS rank FROM words WHERE rn <= 10""")
def cluster_terms(t):
    return cl.top_terms(cl.text_weights(t.posts), fixed_clusters(t)).select("cluster", "term", "rank")


@entry("a14_ingest_metrics", """
WITH r AS (SELECT row_number() OVER (PARTITION BY username, text ORDER BY row_no) AS rn, filled FROM raw_clean)
SELECT count(*) FILTER (filled AND rn = 1) AS processed, count(*) FILTER (filled AND rn > 1) AS duplicates,
  count(*) FILTER (NOT filled) AS errors,
  round(count(*) FILTER (filled AND rn = 1) / count(*) * 100, 6) + 0::DOUBLE AS success_rate FROM r""")
def ingest_metrics(t):
    metrics = ig.metrics(ig.classify(t.raw_rows, t.as_of))
    return metrics.select("processed", "duplicates", "errors", r6("success_rate", "success_rate"))


EXCLUDED = """(SELECT follower_id AS me, followee_id AS item FROM follows UNION SELECT user_id, user_id FROM users)"""


@entry("a18_active_users", f"""
WITH c AS (SELECT user_id AS item, count(*) AS n FROM posts GROUP BY 1),
x AS (SELECT u.user_id, c.item, row_number() OVER (PARTITION BY u.user_id ORDER BY n DESC, c.item) AS rank
  FROM users u, c WHERE NOT EXISTS (SELECT 1 FROM {EXCLUDED} e WHERE e.me = u.user_id AND e.item = c.item))
SELECT user_id, item AS other_id, rank FROM x WHERE rank <= 10""")
def active_users(t):
    people = t.users.select(F.col("user_id").alias("me"))
    found = rc.active_users(people, t.posts, rc.follow_exclusions(t.users, t.follows), 10)
    return found.select(F.col("me").alias("user_id"), F.col("item").alias("other_id"), "rank")


SHARED = """
SELECT a.user_id AS me, b.user_id AS item, sum(b.n)::BIGINT AS score
FROM user_tags a JOIN user_tags b USING (tag) WHERE a.user_id <> b.user_id GROUP BY 1, 2"""


@entry("a19_shared_tags", f"""
SELECT me AS user_id, item AS other_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY me ORDER BY score DESC, item) AS rank FROM ({SHARED})) WHERE rank <= 10""")
def shared_tags(t):
    found = rc.shared_tag_users(t.post_tags)
    return found.select(F.col("me").alias("user_id"), F.col("item").alias("other_id"), "score", "rank")


@entry("a20_cluster_members", f"""
SELECT cluster + 1 AS number, count(*) AS size,
  string_agg(username, ' ' ORDER BY user_id) FILTER (rn <= 5) AS users
FROM (SELECT c.*, username, row_number() OVER (PARTITION BY cluster ORDER BY user_id) AS rn
  FROM {_CLUSTERS} c JOIN users USING (user_id)) GROUP BY cluster""")
def member_preview(t):
    return cl.member_preview(fixed_clusters(t), t.users).select("number", "size", joined("users", "users"))
