"""User-facing queries put together from the operators."""

from pyspark.sql import functions as F

from postflock.catalog.aggregates import FEATURES, LABELS
from postflock.catalog.joins import SIMILAR
from postflock.catalog.ranks import COLLAB, FILL, RECENT, merged_sql
from postflock.catalog.registry import entry, joined, lng, q6, qstamp, r6, stamp
from postflock.catalog.weights import CANDIDATES, tfidf_sql
from postflock.plans import ingest as ig, recommend as rc, report as rp, stats as st, tags as tg

_POSTS = "SELECT post_id AS doc, text FROM posts"
_CONTENT = f"""
SELECT me, item, row_number() OVER (PARTITION BY me ORDER BY score DESC, item) AS rank FROM (
  WITH w AS MATERIALIZED ({tfidf_sql(_POSTS, min_df=2)}),
  taste AS MATERIALIZED (SELECT user_id AS me, term, sum(w) / any_value(n) AS w
    FROM w JOIN posts p ON p.post_id = w.doc
    JOIN (SELECT user_id, count(*) AS n FROM posts GROUP BY 1) USING (user_id) GROUP BY 1, 2),
  len AS (SELECT me, sqrt(sum(w * w)) AS l FROM taste GROUP BY 1),
  cand AS MATERIALIZED ({CANDIDATES.format(who='user_id', table='posts')})
  SELECT taste.me, w.doc AS item, round(sum(taste.w * w.w) / any_value(l), 9) AS score
  FROM taste JOIN w USING (term) JOIN len ON len.me = taste.me
  JOIN cand ON cand.me = taste.me AND cand.post_id = w.doc GROUP BY 1, 2) QUALIFY rank <= 10"""


@entry("r1_posts_no_ml", f"""
SELECT me AS user_id, item AS post_id, source, rank FROM ({merged_sql([_CONTENT, COLLAB, FILL], 5)})""")
def posts_no_ml(t):
    sources = [rc.content_posts(t.posts, 10), rc.collaborative_posts(t.posts, t.post_tags, 10)]
    found = rc.hybrid_posts(t.users, t.posts, sources, 5)
    return found.select(F.col("me").alias("user_id"), F.col("item").alias("post_id"), "source", "rank")


@entry("r6_similar_users", f"""
SELECT user_id, other_id, {q6('sim')} AS similarity, rank FROM ({SIMILAR}) WHERE rank <= 5""")
def similar_users(t):
    found = rc.similar_users(t.post_tags)
    return found.select(F.col("me").alias("user_id"), F.col("item").alias("other_id"), r6("score", "similarity"), "rank")


_HOT = """SELECT tag, count(*) AS n FROM post_tags, latest WHERE ts >= t - INTERVAL 24 HOUR GROUP BY tag
ORDER BY n DESC, tag LIMIT 10"""
TAGS = f"""
WITH recent AS ({RECENT}), hot AS ({_HOT}),
c AS (SELECT user_id, other AS tag, sum(2 * n)::BIGINT AS s FROM recent r JOIN cooc USING (tag)
  WHERE NOT EXISTS (SELECT 1 FROM recent x WHERE x.user_id = r.user_id AND x.tag = other) GROUP BY 1, 2),
h AS (SELECT user_id, tag, n AS s FROM users, hot)
SELECT user_id, tag, sum(s)::BIGINT AS score,
  row_number() OVER (PARTITION BY user_id ORDER BY sum(s) DESC, tag) AS rank
FROM (SELECT * FROM c UNION ALL SELECT * FROM h) GROUP BY 1, 2 QUALIFY rank <= 10"""


@entry("r8_tags", TAGS)
def recommended_tags(t):
    return tg.recommended_tags(t.users, t.posts, t.post_tags, t.as_of)


@entry("r7_api_bundle", f"""
SELECT s.user_id, 'post' AS kind, CAST(p.post_id AS VARCHAR) AS value,
  row_number() OVER (PARTITION BY s.user_id ORDER BY s.rank, p.rn) AS rank
FROM ({SIMILAR}) s JOIN newest p ON p.user_id = s.other_id WHERE s.rank <= 5 AND p.rn <= 5
UNION ALL SELECT user_id, 'tag', tag, rank FROM ({TAGS})""")
def api_bundle(t):
    posts = rc.similar_user_posts(rc.similar_users(t.post_tags), t.posts).select(
        F.col("me").alias("user_id"), F.lit("post").alias("kind"), F.col("post_id").cast("string").alias("value"),
        "user_rank", "post_rank",
    )
    from postflock.operators.ranking import top_k

    placed = top_k(posts, ["user_id"], [F.col("user_rank"), F.col("post_rank")], 25)
    tags = tg.recommended_tags(t.users, t.posts, t.post_tags, t.as_of).select(
        "user_id", F.lit("tag").alias("kind"), F.col("tag").alias("value"), "rank"
    )
    return placed.select("user_id", "kind", "value", "rank").unionByName(tags)


@entry("r9_related", """
SELECT tag, other, posts AS count, n AS co_count, row_number() OVER (PARTITION BY tag ORDER BY posts DESC, other) AS rank
FROM cooc JOIN (SELECT tag AS other, posts FROM usage) USING (other) QUALIFY rank <= 5""")
def related(t):
    return tg.related(t.posts, t.post_tags).select("tag", "other", "count", "co_count", "rank")


@entry("r10_trending", 'SELECT tag, n AS "count" FROM (' + _HOT + ")")
def trending(t):
    return tg.trending(t.post_tags, t.as_of)


@entry("r11_trending_score", f"""
SELECT tag, {q6('posts * recency * trend_score')} AS score, row_number() OVER (ORDER BY posts * recency * trend_score DESC, tag) AS rank
FROM ({FEATURES}) QUALIFY rank <= 10""")
def trending_score(t):
    from pyspark.sql import Window

    best = tg.trending_by_score(tg.tag_features(t.post_tags, t.as_of), 10)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "tag")).cast("long")
    return best.select("tag", r6("score", "score"), place.alias("rank"))


@entry("r12_ingest_posts", f"""
WITH good AS (SELECT *, min(row_no) OVER (PARTITION BY username) AS user_id,
  row_number() OVER (PARTITION BY username, text ORDER BY row_no) AS rn FROM raw_clean WHERE filled)
SELECT row_no AS post_id, user_id, text, {qstamp('ts')} AS ts, sentiment_score, sentiment_label FROM good WHERE rn = 1""")
def ingest_posts(t):
    posts = ig.ingest(t.raw_rows, t.as_of).posts
    return posts.select("post_id", "user_id", "text", stamp("ts", "ts"), "sentiment_score", "sentiment_label")


@entry("r12_ingest_status", """
SELECT row_no, CASE WHEN NOT filled THEN 'missing_field'
  WHEN row_number() OVER (PARTITION BY filled, username, text ORDER BY row_no) > 1 THEN 'duplicate' ELSE 'ok' END AS status
FROM raw_clean""")
def ingest_status(t):
    return ig.classify(t.raw_rows, t.as_of).select("row_no", "status")


@entry("r14_tag_report", f"""
SELECT 'pair' AS kind, tag, other, n FROM cooc
UNION ALL SELECT 'trending', tag, '', n FROM ({_HOT})""")
def tag_report(t):
    report = rp.tag_report(t.posts, t.post_tags, t.as_of)
    pairs = report["co_occurrences"].select(F.lit("pair").alias("kind"), "tag", "other", "n")
    hot = report["trending"].select(F.lit("trending").alias("kind"), "tag", F.lit("").alias("other"), F.col("count").alias("n"))
    return pairs.unionByName(hot)


@entry("r20_profile", f"""
SELECT u.user_id, username, email, bio,
  (SELECT count(*) FROM follows f WHERE f.followee_id = u.user_id) AS followers,
  (SELECT count(*) FROM follows f WHERE f.follower_id = u.user_id) AS following,
  coalesce(positive, 0) AS positive, coalesce(neutral, 0) AS neutral, coalesce(negative, 0) AS negative,
  coalesce(total, 0) AS total, coalesce({q6('average_score')}, 9) AS average_score, coalesce(newest_post, -1) AS newest_post
FROM users u LEFT JOIN (SELECT user_id, {LABELS}, count(*) AS total, avg(sentiment_score) AS average_score,
  arg_max(post_id, (ts, post_id)) AS newest_post FROM posts GROUP BY 1) USING (user_id)""")
def profile(t):
    pages = rp.profile_pages(t.users, t.posts, t.follows)
    counts = [lng(c).alias(c) for c in ("followers", "following", *st.LABELS, "total", "newest_post")]
    score = F.coalesce(r6("average_score", "s"), F.lit(9.0)).alias("average_score")
    return pages.select("user_id", "username", "email", "bio", *counts, score)


@entry("r21_tag_page", f"""
SELECT tag, post_id, p.user_id, {qstamp('p.ts')} AS ts, text, posts AS tag_posts
FROM post_tags g JOIN posts p USING (post_id) JOIN usage USING (tag)""")
def tag_page(t):
    page = tg.tag_page(t.posts, t.post_tags)
    return page.select("tag", "post_id", "user_id", stamp("ts", "ts"), "text", F.col("posts").alias("tag_posts"))


_WEEKS = f"""SELECT CAST(date_trunc('week', ts) AS DATE) AS period, {LABELS},
  {q6('avg(sentiment_score)')} AS average_score FROM posts GROUP BY 1"""


@entry("r22_trend_arrays", f"""
SELECT {", ".join(f"string_agg(CAST({c} AS VARCHAR), ' ' ORDER BY period) AS {c}" for c in ("period", *st.LABELS))},
  {q6('avg(average_score)')} AS mean_of_scores FROM ({_WEEKS})""")
def trend_arrays(t):
    one = st.trend_arrays(st.sentiment_trend(t.posts, "weekly"))
    total = F.aggregate("average_score", F.lit(0.0), lambda s, x: s + F.round(x, 6))
    return one.select(
        *[joined(F.col(c).cast("array<string>"), c) for c in ("period", *st.LABELS)],
        r6(total / F.size("average_score"), "mean_of_scores"),
    )


@entry("r19_dashboard_feed", f"""
SELECT user_id, 'recent' AS panel, post_id, rn AS rank FROM newest WHERE rn <= 10
UNION ALL
SELECT follower_id, 'followed', post_id, row_number() OVER (PARTITION BY follower_id ORDER BY ts DESC, post_id DESC) AS rank
FROM follows JOIN posts ON user_id = followee_id QUALIFY rank <= 10""")
def dashboard_feed(t):
    panels = rp.dashboard(t.users, t.posts, t.post_tags, t.follows, t.as_of, latent=False)
    recent = panels["recent_posts"].select("user_id", F.lit("recent").alias("panel"), "post_id", "rank")
    followed = panels["followed_posts"].select(
        F.col("follower_id").alias("user_id"), F.lit("followed").alias("panel"), "post_id", "rank"
    )
    return recent.unionByName(followed)
