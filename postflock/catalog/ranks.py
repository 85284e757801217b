"""Ranks, limits and merges of ranked lists."""

from pyspark.sql import functions as F

from postflock.catalog.joins import FOF, SIMILAR
from postflock.catalog.aggregates import EXCLUDED, FEATURES, SHARED
from postflock.catalog.registry import entry, q6, qstamp, r6, stamp
from postflock.catalog.weights import CANDIDATES
from postflock.operators.ranking import first_wins
from postflock.plans import graph as gr, ingest as ig, recommend as rc, stats as st, tags as tg


@entry("w1_recent_posts", "SELECT user_id, post_id, rn AS rank FROM newest WHERE rn <= 10")
def recent_posts(t):
    return st.recent_posts(t.posts).select("user_id", "post_id", "rank")


@entry("w2_similar_user_posts", f"""
SELECT s.user_id, s.other_id, p.post_id, s.rank AS user_rank, p.rn AS post_rank
FROM ({SIMILAR}) s JOIN newest p ON p.user_id = s.other_id WHERE s.rank <= 5 AND p.rn <= 5""")
def similar_user_posts(t):
    found = rc.similar_user_posts(rc.similar_users(t.post_tags), t.posts)
    return found.select(F.col("me").alias("user_id"), F.col("other").alias("other_id"), "post_id", "user_rank", "post_rank")


RECENT = "SELECT DISTINCT n.user_id, tag FROM newest n JOIN post_tags g USING (post_id) WHERE rn <= 20"


@entry("w3_recent_tags", RECENT)
def recent_tags(t):
    return tg.recent_tags(t.post_tags, t.posts)


@entry("w4_first_wins", """
SELECT username, min(row_no) AS row_no FROM raw_clean WHERE filled GROUP BY username""")
def first_wins_rows(t):
    rows = ig.prepare(t.raw_rows, t.as_of).filter(F.col("status") == "ok").select("row_no", "username")
    return first_wins(rows, ["username"], "row_no")


@entry("w5_candidates", f"SELECT me AS user_id, post_id, rank FROM ({CANDIDATES.format(who='user_id', table='posts')})")
def candidates(t):
    people = t.posts.select(F.col("user_id").alias("me")).distinct()
    found = rc.newest_by_others(people, rc.newest_pool(t.posts))
    return found.select(F.col("me").alias("user_id"), F.col("item").alias("post_id"), "rank")


@entry("k1_top_tags", "SELECT tag, posts FROM usage ORDER BY posts DESC, tag LIMIT 10")
def top_tags(t):
    return tg.tag_usage(t.post_tags).orderBy(F.desc("posts"), "tag").limit(10)


@entry("k2_tag_posts", f"SELECT tag, post_id, {qstamp('ts')} AS ts FROM post_tags ORDER BY tag, ts DESC, post_id DESC")
def tag_posts(t):
    return t.post_tags.orderBy("tag", F.desc("ts"), F.desc("post_id")).select("tag", "post_id", stamp("ts", "ts"))


@entry("k3_newest", f"SELECT post_id, user_id, {qstamp('ts')} AS ts FROM posts ORDER BY posts.ts DESC, post_id DESC LIMIT 10")
def newest(t):
    return st.newest(t.posts, 10).select("post_id", "user_id", stamp("ts", "ts"))


@entry("k4_feed_top10", """
SELECT follower_id, post_id, rank FROM (
  SELECT follower_id, post_id, row_number() OVER (PARTITION BY follower_id ORDER BY ts DESC, post_id DESC) AS rank
  FROM follows JOIN posts ON user_id = followee_id) WHERE rank <= 10""")
def feed_top(t):
    return gr.newest_feed(t.follows, t.posts.select("user_id", "post_id", "ts")).select("follower_id", "post_id", "rank")


@entry("k5_score_sort", f"""
SELECT tag, {q6('posts * recency * trend_score')} AS score FROM ({FEATURES})
ORDER BY posts * recency * trend_score DESC, tag LIMIT 10""")
def score_sort(t):
    return tg.trending_by_score(tg.tag_features(t.post_tags, t.as_of)).select("tag", r6("score", "score"))


@entry("k6_first_users", "SELECT user_id, username FROM users ORDER BY user_id LIMIT 100")
def first_users(t):
    return t.users.orderBy("user_id").limit(100).select("user_id", "username")


COLLAB = f"""
SELECT me, post_id AS item, rank FROM (
  SELECT s.me, p.post_id, row_number() OVER (PARTITION BY s.me ORDER BY p.ts DESC, p.post_id DESC) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY me ORDER BY score DESC, item) AS sr FROM ({SHARED})) s
  JOIN posts p ON p.user_id = s.item WHERE sr <= 10) WHERE rank <= 10"""


@entry("r2_collab", f"SELECT me AS user_id, item AS post_id, rank FROM ({COLLAB})")
def collaborative(t):
    found = rc.collaborative_posts(t.posts, t.post_tags, 10)
    return found.select(F.col("me").alias("user_id"), F.col("item").alias("post_id"), "rank")


FALLBACK = f"""
SELECT u.user_id AS me, c.item, row_number() OVER (PARTITION BY u.user_id ORDER BY n DESC, c.item) AS rank
FROM users u, (SELECT user_id AS item, count(*) AS n FROM posts GROUP BY 1) c
WHERE u.user_id NOT IN (SELECT user_id FROM post_tags)
  AND NOT EXISTS (SELECT 1 FROM {EXCLUDED} e WHERE e.me = u.user_id AND e.item = c.item)"""


def tag_users_sql(limit: int) -> str:
    return f"""
SELECT me, item, rank FROM (
  SELECT me, item, row_number() OVER (PARTITION BY me ORDER BY score DESC, item) AS rank FROM ({SHARED}) s
  WHERE NOT EXISTS (SELECT 1 FROM {EXCLUDED} e WHERE e.me = s.me AND e.item = s.item)
  UNION ALL SELECT me, item, rank FROM ({FALLBACK})) WHERE rank <= {limit}"""


@entry("r4_tag_users", f"SELECT me AS user_id, item AS other_id, rank FROM ({tag_users_sql(10)})")
def tag_users(t):
    found = rc.tag_based_users(t.users, t.posts, t.post_tags, t.follows, 10)
    return found.select(F.col("me").alias("user_id"), F.col("item").alias("other_id"), "rank")


def mates_sql(limit: int) -> str:
    return f"""
SELECT me, item, rank FROM (
  SELECT a.user_id AS me, b.user_id AS item, row_number() OVER (PARTITION BY a.user_id ORDER BY b.user_id) AS rank
  FROM (SELECT DISTINCT user_id FROM posts) a JOIN (SELECT DISTINCT user_id FROM posts) b ON a.user_id % 3 = b.user_id % 3
  WHERE NOT EXISTS (SELECT 1 FROM {EXCLUDED} e WHERE e.me = a.user_id AND e.item = b.user_id)) WHERE rank <= {limit}"""


@entry("r5_cluster_mates", f"SELECT me AS user_id, item AS other_id, rank FROM ({mates_sql(14)})")
def cluster_mates(t):
    from postflock.catalog.aggregates import fixed_clusters

    found = rc.cluster_mates(fixed_clusters(t), rc.follow_exclusions(t.users, t.follows), 14)
    return found.select(F.col("me").alias("user_id"), F.col("item").alias("other_id"), "rank")


def merged_sql(sources: list[str], limit: int) -> str:
    """Priority union of (me, item, rank) lists; the first source with an item keeps it."""
    parts = "\nUNION ALL ".join(f"SELECT me, item, {i} AS source, rank AS place FROM ({s})" for i, s in enumerate(sources))
    return f"""
SELECT me, item, source, row_number() OVER (PARTITION BY me ORDER BY source, place, item) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY me, item ORDER BY source, place) AS pick FROM ({parts})) WHERE pick = 1
QUALIFY rank <= {limit}"""


def fof_sql(limit: int) -> str:
    return f"SELECT user_id AS me, other_id AS item, rank FROM ({FOF}) WHERE rank <= {limit}"


_USERS = "SELECT me AS user_id, item AS other_id, source, rank FROM ({})"


@entry("r3_users_no_ml", _USERS.format(merged_sql([tag_users_sql(14), fof_sql(14)], 7)))
def users_no_ml(t):
    found = rc.hybrid_users(t.users, t.posts, t.post_tags, t.follows, None)
    return found.select(F.col("me").alias("user_id"), F.col("item").alias("other_id"), "source", "rank")


@entry("u2_user_priority", _USERS.format(merged_sql([mates_sql(14), tag_users_sql(14), fof_sql(14)], 7)))
def user_priority(t):
    from postflock.catalog.aggregates import fixed_clusters

    found = rc.hybrid_users(t.users, t.posts, t.post_tags, t.follows, fixed_clusters(t))
    return found.select(F.col("me").alias("user_id"), F.col("item").alias("other_id"), "source", "rank")


FILL = """
SELECT me, item, rank FROM (
  SELECT u.user_id AS me, p.post_id AS item, row_number() OVER (PARTITION BY u.user_id ORDER BY p.ts DESC, p.post_id DESC) AS rank
  FROM users u JOIN posts p ON p.user_id <> u.user_id) WHERE rank <= 40"""


@entry("u3_post_priority", f"SELECT me AS user_id, item AS post_id, source, rank FROM ({merged_sql([COLLAB, FILL], 12)})")
def post_priority(t):
    found = rc.hybrid_posts(t.users, t.posts, [rc.collaborative_posts(t.posts, t.post_tags, 10)], 12)
    return found.select(F.col("me").alias("user_id"), F.col("item").alias("post_id"), "source", "rank")
