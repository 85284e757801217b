"""Joins."""

from pyspark.sql import functions as F

from postflock.catalog.registry import entry, lng, q6, r6
from postflock.operators.cooccur import pairs_in_post
from postflock.operators.overlap import pair_overlap
from postflock.plans import graph as gr, recommend as rc, stats as st, tags as tg


@entry("j1_user_posts", "SELECT user_id, username, post_id FROM users JOIN posts USING (user_id)")
def user_posts(t):
    return t.users.join(t.posts, "user_id").select("user_id", "username", "post_id")


@entry("j2_post_tags", "SELECT p.post_id, p.user_id, tag, text FROM posts p JOIN post_tags g USING (post_id)")
def post_tags(t):
    return t.posts.select("post_id", "user_id", "text").join(t.post_tags.select("post_id", "tag"), "post_id")


@entry("j3_followed_feed", """
SELECT follower_id, user_id, post_id FROM follows JOIN posts ON user_id = followee_id""")
def followed_feed(t):
    return gr.followed_feed(t.follows, t.posts.select("user_id", "post_id")).select("follower_id", "user_id", "post_id")


FOF = """
SELECT a.follower_id AS user_id, b.followee_id AS other_id, count(*) AS paths,
  row_number() OVER (PARTITION BY a.follower_id ORDER BY count(*) DESC, b.followee_id) AS rank
FROM follows a JOIN follows b ON a.followee_id = b.follower_id
WHERE a.follower_id <> b.followee_id AND NOT EXISTS (SELECT 1 FROM follows c
  WHERE c.follower_id = a.follower_id AND c.followee_id = b.followee_id)
GROUP BY 1, 2"""


@entry("j4_friends_of_friends", f"SELECT * FROM ({FOF}) WHERE rank <= 10")
def friends_of_friends(t):
    return gr.friends_of_friends(t.follows)


@entry("j5_tags_sharing_post", "SELECT tag, other FROM cooc")
def tags_sharing_post(t):
    return tg.sharing_tags(t.posts)


@entry("j6_users_with_posts", "SELECT user_id, username FROM users WHERE user_id IN (SELECT user_id FROM posts)")
def users_with_posts(t):
    return t.users.join(t.posts.select("user_id"), "user_id", "left_semi").select("user_id", "username")


@entry("j7_exclude_followed", """
SELECT DISTINCT r.user_id, p.user_id AS other_id FROM reactions r JOIN posts p USING (post_id)
WHERE NOT EXISTS (SELECT 1 FROM follows f WHERE f.follower_id = r.user_id AND f.followee_id = p.user_id)""")
def exclude_followed(t):
    pairs = gr.reaction_edges(t.reactions, t.posts).select(
        F.col("source").alias("user_id"), F.col("target").alias("other_id")
    ).distinct()
    return pairs.join(t.follows.toDF("user_id", "other_id"), ["user_id", "other_id"], "left_anti")


@entry("j8_cooccurrence_pairs", """
SELECT post_id, a.tag, b.tag AS other FROM post_tags a JOIN post_tags b USING (post_id) WHERE a.tag <> b.tag""")
def cooccurrence_pairs(t):
    return pairs_in_post(t.posts)


JACCARD = """
SELECT a.user_id AS user_id, b.user_id AS other_id, count(*) AS common
FROM user_tags a JOIN user_tags b USING (tag) WHERE a.user_id <> b.user_id GROUP BY 1, 2"""
SIMILAR = f"""
SELECT user_id, other_id, common / (x.n + y.n - common) AS sim,
  row_number() OVER (PARTITION BY user_id ORDER BY common / (x.n + y.n - common) DESC, other_id) AS rank
FROM ({JACCARD}) JOIN (SELECT user_id AS i, count(*) AS n FROM user_tags GROUP BY 1) x ON x.i = user_id
JOIN (SELECT user_id AS i, count(*) AS n FROM user_tags GROUP BY 1) y ON y.i = other_id"""


@entry("j10_jaccard", f"""
WITH s AS (SELECT user_id, other_id, sim, rank FROM ({SIMILAR}) WHERE rank <= 5),
pad AS (SELECT u.user_id, o.user_id AS other_id, 0.0 AS sim, 99 AS rank
  FROM users u, (SELECT user_id FROM users ORDER BY user_id LIMIT 11) o
  WHERE u.user_id <> o.user_id AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = u.user_id AND s.other_id = o.user_id)),
ranked AS (SELECT user_id, other_id, sim, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, other_id) AS rank
  FROM (SELECT * FROM s UNION ALL SELECT * FROM pad))
SELECT user_id, other_id, {q6('sim')} AS similarity, rank FROM ranked WHERE rank <= 5""")
def jaccard(t):
    found = rc.similar_users(t.post_tags, 5, pad_with=t.users)
    return found.select(F.col("me").alias("user_id"), F.col("item").alias("other_id"), r6("score", "similarity"), "rank")


@entry("a10_tag_jaccard", f"""
SELECT a, b, {q6('CASE WHEN either > 0 THEN common / either ELSE 0 END')} AS jaccard FROM (
SELECT f.follower_id AS a, f.followee_id AS b,
  (SELECT count(*) FROM user_tags x JOIN user_tags y USING (tag)
    WHERE x.user_id = f.follower_id AND y.user_id = f.followee_id) AS common,
  (SELECT count(DISTINCT tag) FROM user_tags x WHERE x.user_id IN (f.follower_id, f.followee_id)) AS either
FROM follows f)""")
def tag_jaccard(t):
    return pair_overlap(t.follows.toDF("a", "b"), rc.tag_sets(t.posts)).select("a", "b", r6("jaccard", "jaccard"))


@entry("j11_is_following", """
WITH p AS (SELECT DISTINCT r.user_id, p.user_id AS other_id FROM reactions r JOIN posts p USING (post_id))
SELECT user_id, other_id,
  EXISTS (SELECT 1 FROM follows f WHERE f.follower_id = p.user_id AND f.followee_id = p.other_id) AS is_following,
  EXISTS (SELECT 1 FROM follows f WHERE f.follower_id = p.other_id AND f.followee_id = p.user_id) AS is_followed_by
FROM p""")
def is_following(t):
    pairs = gr.reaction_edges(t.reactions, t.posts).select(
        F.col("source").alias("user_id"), F.col("target").alias("other_id")
    ).distinct()
    return gr.relations(pairs, t.follows)


@entry("j12_score_merge", """
WITH a AS (SELECT tag, 2 * posts AS score FROM usage WHERE posts > 50),
b AS (SELECT tag, count(*) AS score FROM post_tags, latest WHERE ts >= t - INTERVAL 24 HOUR GROUP BY tag)
SELECT tag, coalesce(a.score, 0) + coalesce(b.score, 0) AS score FROM a FULL JOIN b USING (tag)""")
def score_merge(t):
    usage = tg.tag_usage(t.post_tags).filter(F.col("posts") > 50).select("tag", (F.col("posts") * 2).alias("score"))
    recent = tg.tag_usage(tg.last_hours(t.post_tags, t.as_of)).withColumnRenamed("posts", "score")
    return tg.merged_scores(usage, recent)


@entry("j13_followers", """
SELECT followee_id AS user_id, 'follower' AS side, follower_id AS other_id, username AS other_name
FROM follows JOIN users ON user_id = follower_id
UNION ALL
SELECT follower_id, 'following', followee_id, username FROM follows JOIN users ON user_id = followee_id""")
def follow_lists(t):
    return gr.follow_lists(t.follows, t.users)


EDGES = """SELECT r.user_id AS source, p.user_id AS target, kind AS type FROM reactions r JOIN posts p USING (post_id)"""


@entry("j14_reaction_edges", EDGES)
def reaction_edges(t):
    return gr.reaction_edges(t.reactions, t.posts)


@entry("j15_sample_post", """
SELECT user_id, min(post_id) AS post_id, substring(arg_min(text, post_id), 1, 100) || '...' AS sample
FROM posts GROUP BY user_id""")
def sample_post(t):
    return st.sample_posts(t.posts)


@entry("u1_edges", f"{EDGES} UNION ALL SELECT follower_id, followee_id, 'follow' FROM follows")
def edges(t):
    return gr.links(t.follows, t.reactions, t.posts)


def _counted(end: str, suffix: str) -> str:
    kinds = ", ".join(f"count(*) FILTER (type = '{k}') AS {k}_{suffix}" for k in ("follow", "retweet", "like"))
    return f"(SELECT {end} AS user_id, {kinds} FROM l GROUP BY 1)"


@entry("r13_network", f"""
WITH l AS ({EDGES} UNION ALL SELECT follower_id, followee_id, 'follow' FROM follows)
SELECT user_id, username, {", ".join(f"coalesce({k}_{s}, 0) AS {k}_{s}" for s in ("out", "in") for k in ("follow", "retweet", "like"))}
FROM users LEFT JOIN {_counted('source', 'out')} USING (user_id) LEFT JOIN {_counted('target', 'in')} USING (user_id)""")
def network(t):
    return gr.network(t.users, gr.links(t.follows, t.reactions, t.posts))


@entry("a5_follow_counts", """
SELECT user_id, (SELECT count(*) FROM follows WHERE followee_id = user_id) AS followers,
  (SELECT count(*) FROM follows WHERE follower_id = user_id) AS following FROM users""")
def follow_counts(t):
    return gr.follow_counts(t.users, t.follows).select("user_id", lng("followers").alias("followers"), lng("following").alias("following"))
