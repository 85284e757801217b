"""Scans, filters and set-based changes."""

from pyspark.sql import functions as F

from postflock.catalog.registry import clean_sql, entry, lng, q6, qstamp, r6, stamp
from postflock.functions import text as tx
from postflock.operators.lexicon import unscored
from postflock.plans import graph as gr, ingest as ig, recommend as rc, stats as st, tags as tg


@entry("s2_scan_posts", f"""
SELECT post_id, user_id, text, {qstamp('ts')} AS ts, {q6('sentiment_score')} AS sentiment_score, sentiment_label
FROM posts""")
def scan_posts(t):
    return t.posts.select("post_id", "user_id", "text", stamp("ts", "ts"), r6("sentiment_score", "sentiment_score"), "sentiment_label")


_TYPES = {
    "users": [("user_id", "bigint"), ("username", "string"), ("email", "string"), ("bio", "string")],
    "posts": [("post_id", "bigint"), ("user_id", "bigint"), ("text", "string"), ("sentiment_label", "string")],
    "follows": [("follower_id", "bigint"), ("followee_id", "bigint")],
    "reactions": [("user_id", "bigint"), ("post_id", "bigint"), ("kind", "string")],
}
_KEYS = {"users": "user_id", "posts": "post_id", "follows": "pair", "reactions": "all"}


def _report_sql() -> str:
    parts = []
    order = {"users": "user_id", "posts": "post_id", "follows": "follower_id, followee_id", "reactions": "user_id, post_id, kind"}
    for table, columns in _TYPES.items():
        for name, kind in columns:
            parts.append(
                f"SELECT '{table}' AS table_name, '{name}' AS column_name, '{kind}' AS data_type, "
                f"(SELECT count(*) FROM {table}) AS row_count, "
                f"(SELECT CAST({name} AS VARCHAR) FROM {table} ORDER BY {order[table]} LIMIT 1) AS sample"
            )
    return "\nUNION ALL ".join(parts)


@entry("s8_schema_report", _report_sql())
def schema_report(t):
    tables = {name: getattr(t, name).select(*[c for c, _ in columns]) for name, columns in _TYPES.items()}
    keys = {
        "users": F.col("user_id"), "posts": F.col("post_id"), "follows": F.struct("follower_id", "followee_id"),
        "reactions": F.struct("user_id", "post_id", "kind"),
    }
    return st.schema_report(tables, keys)


@entry("s10_delete_posts", """
SELECT post_id, user_id FROM posts p
WHERE NOT EXISTS (SELECT 1 FROM reactions r WHERE r.post_id = p.post_id AND r.user_id = p.user_id)""")
def delete_posts(t):
    return ig.delete_posts(t.posts, t.reactions).select("post_id", "user_id")


_REQUESTS = """(SELECT DISTINCT r.user_id AS follower_id, p.user_id AS followee_id
 FROM reactions r JOIN posts p USING (post_id))"""


def follow_requests(t):
    """Readers asking to follow the authors they reacted to."""
    return gr.reaction_edges(t.reactions, t.posts).select(
        F.col("source").alias("follower_id"), F.col("target").alias("followee_id")
    ).distinct()


@entry("s11_follow", f"""
SELECT * FROM follows
UNION
SELECT q.* FROM {_REQUESTS} q WHERE follower_id <> followee_id
 AND follower_id IN (SELECT user_id FROM users) AND followee_id IN (SELECT user_id FROM users)""")
def follow(t):
    return ig.follow(t.follows, follow_requests(t), t.users)


@entry("s11_unfollow", f"""SELECT * FROM follows EXCEPT SELECT * FROM {_REQUESTS}""")
def unfollow(t):
    return ig.unfollow(t.follows, follow_requests(t))


@entry("p1_lookup_user", "SELECT * FROM users WHERE username = 'Customer#000000042'")
def lookup_user(t):
    return t.users.filter(F.col("username") == "Customer#000000042")


@entry("p2_last_24h", f"""
SELECT post_id, user_id, {qstamp('ts')} AS ts FROM posts, latest WHERE ts >= t - INTERVAL 24 HOUR""")
def last_day(t):
    return tg.last_hours(t.posts, t.as_of).select("post_id", "user_id", stamp("ts", "ts"))


@entry("p3_unscored", """
SELECT post_id, author FROM scored_text_posts WHERE sentiment_score IS NULL OR sentiment_label IS NULL""")
def unscored_posts(t):
    return unscored(t.scored_text_posts).select("post_id", "author")


@entry("p4_in_list", """
SELECT post_id, user_id FROM posts
WHERE user_id IN (SELECT followee_id FROM follows) AND post_id NOT IN (SELECT post_id FROM reactions)""")
def in_list(t):
    followed = t.follows.select(F.col("followee_id").alias("user_id"))
    kept = t.posts.join(followed, "user_id", "left_semi").join(t.reactions.select("post_id"), "post_id", "left_anti")
    return kept.select("post_id", "user_id")


@entry("p5_required_fields", f"""
SELECT post_id AS row_no, CASE WHEN length({clean_sql('author')}) > 0 AND length({clean_sql('text')}) > 0
  THEN 'ok' ELSE 'missing_field' END AS status FROM text_posts""")
def required_fields(t):
    return ig.prepare(t.raw_rows, t.as_of).select("row_no", "status")


@entry("p6_valid_posts", """
SELECT post_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 'empty'
  WHEN length(text) > 280 THEN 'too_long' ELSE 'ok' END AS reason FROM text_posts""")
def valid_posts(t):
    return ig.post_validity(t.text_posts).select("post_id", "reason")


@entry("p7_user_quality", r"""
SELECT user_id, length(username) BETWEEN 2 AND 64 AS username_ok,
  regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$') AS email_ok, length(bio) <= 160 AS bio_ok,
  count(*) OVER (PARTITION BY username) = 1 AS username_unique, count(*) OVER (PARTITION BY email) = 1 AS email_unique
FROM users""")
def user_quality(t):
    return ig.user_quality(t.users)


@entry("p8_preview", """
SELECT post_id, substring(text, 1, 100) || '...' AS preview,
  CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS short FROM text_posts""")
def preview(t):
    text = F.col("text")
    return t.text_posts.select("post_id", tx.preview(text).alias("preview"), tx.short_preview(text).alias("short"))


@entry("p9_profile_update", """
WITH asked AS (SELECT s_suppkey AS user_id,
    CASE WHEN s_nationkey < 5 THEN 'Customer#00000000' || CAST(s_nationkey AS VARCHAR) ELSE s_name END AS username, s_name AS bio
  FROM supplier),
free AS (SELECT a.* FROM asked a
  WHERE NOT EXISTS (SELECT 1 FROM users o WHERE o.username = a.username AND o.user_id <> a.user_id))
SELECT u.user_id, coalesce(f.username, u.username) AS username, u.email, coalesce(f.bio, u.bio) AS bio
FROM users u LEFT JOIN free f USING (user_id)""")
def profile_update(t):
    return ig.update_profiles(t.users, profile_updates(t))


def profile_updates(t):
    """Suppliers as users who ask for new names, some of them taken."""
    taken = F.concat(F.lit("Customer#00000000"), F.col("s_nationkey").cast("string"))
    return t.table("supplier").select(
        F.col("s_suppkey").alias("user_id"),
        F.when(F.col("s_nationkey") < 5, taken).otherwise(F.col("s_name")).alias("username"),
        F.lit(None).cast("string").alias("email"), F.col("s_name").alias("bio"),
    )


@entry("u4_unseen", """
SELECT DISTINCT user_id, post_id FROM reactions r
WHERE NOT EXISTS (SELECT 1 FROM posts p WHERE p.post_id = r.post_id AND p.user_id = r.user_id)""")
def unseen(t):
    pairs = t.reactions.select("user_id", "post_id").distinct()
    return pairs.join(t.posts.select("user_id", "post_id"), ["user_id", "post_id"], "left_anti")


@entry("u5_tag_sets", """
WITH s AS (SELECT user_id, count(*) AS n FROM user_tags GROUP BY 1),
c AS (SELECT f.follower_id, f.followee_id, count(*) AS n FROM follows f
  JOIN user_tags a ON a.user_id = f.follower_id JOIN user_tags b ON b.user_id = f.followee_id AND b.tag = a.tag
  GROUP BY 1, 2)
SELECT f.follower_id AS a, f.followee_id AS b, coalesce(c.n, 0) AS common,
  coalesce(sa.n, 0) + coalesce(sb.n, 0) - coalesce(c.n, 0) AS either
FROM follows f LEFT JOIN s sa ON sa.user_id = f.follower_id LEFT JOIN s sb ON sb.user_id = f.followee_id
LEFT JOIN c ON c.follower_id = f.follower_id AND c.followee_id = f.followee_id""")
def set_sizes(t):
    from postflock.operators.overlap import pair_overlap

    pairs = t.follows.toDF("a", "b")
    return pair_overlap(pairs, rc.tag_sets(t.posts)).select("a", "b", lng("common").alias("common"), lng("either").alias("either"))
