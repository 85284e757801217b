"""TF-IDF, taste vectors, cosine, features."""

from pyspark.sql import functions as F

from postflock.catalog.registry import WORD, entry, q6, r6
from postflock.functions.stopwords import ENGLISH
from postflock.operators import similarity as sm, tfidf as ti
from postflock.plans import cluster as cl, recommend as rc

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)


def tfidf_sql(docs: str, min_df: int = 1, max_features: int | None = None, stop: bool = True, terms: str | None = None) -> str:
    """SELECT doc, term, w over ``docs(doc, text)`` or ready ``terms(doc, term)``."""
    words = terms or f"SELECT doc, unnest(regexp_extract_all(lower(text), '{WORD}{{2,}}')) AS term FROM ({docs})"
    where = f"WHERE term NOT IN ({_STOP})" if stop else ""
    cut = f"ORDER BY cf DESC, term LIMIT {max_features}" if max_features else ""
    return f"""
WITH tf AS (SELECT doc, term, count(*) AS tf FROM ({words}) {where} GROUP BY 1, 2),
n AS (SELECT count(DISTINCT doc) AS n FROM ({docs})),
voc AS (SELECT * FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1) WHERE df >= {min_df} {cut}),
raw AS (SELECT doc, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN voc USING (term), n)
SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM raw"""


POSTS = "SELECT post_id AS doc, text FROM text_posts"
AUTHORS = "SELECT author AS doc, text FROM text_posts"
USERS = "SELECT user_id AS doc, text FROM posts"
TAGS = "SELECT user_id AS doc, tag AS term FROM post_tags WHERE length(tag) > 1"
TEXT100 = tfidf_sql(AUTHORS, max_features=100)


def author_posts(t):
    return t.text_posts.withColumnRenamed("author", "user_id")


@entry("m1_tfidf", f"SELECT doc AS post_id, term, {q6('w')} AS weight FROM ({tfidf_sql(POSTS, min_df=2)})")
def post_weights(t):
    weights = ti.tfidf(t.text_posts, "post_id", min_df=2)
    return weights.select(F.col("doc").alias("post_id"), "term", r6("w", "weight"))


@entry("m2_tfidf_top100", f"SELECT doc AS author, term, {q6('w')} AS weight FROM ({TEXT100})")
def author_weights(t):
    weights = ti.tfidf(t.text_posts, "author", max_features=100)
    return weights.select(F.col("doc").alias("author"), "term", r6("w", "weight"))


@entry("m3_tag_tfidf", f"""
SELECT doc AS user_id, term, {q6('w')} AS weight FROM ({tfidf_sql(USERS, max_features=50, stop=False, terms=TAGS)})""")
def tag_weights(t):
    return cl.tag_weights(t.posts).select(F.col("doc").alias("user_id"), "term", r6("w", "weight"))


_TASTE = f"""
SELECT author, term, sum(w) / any_value(n) AS w
FROM ({tfidf_sql(POSTS, min_df=2)}) x JOIN text_posts p ON p.post_id = x.doc
JOIN (SELECT author, count(*) AS n FROM text_posts GROUP BY 1) USING (author) GROUP BY 1, 2"""


@entry("m4_taste", f"SELECT author, term, {q6('w')} AS weight FROM ({_TASTE})")
def taste(t):
    vectors = rc.taste_vectors(author_posts(t), ti.tfidf(t.text_posts, "post_id", min_df=2))
    return vectors.select(F.col("me").alias("author"), "term", r6("w", "weight"))


CANDIDATES = """
SELECT me, post_id, rank FROM (
  SELECT u.me, p.post_id, row_number() OVER (PARTITION BY u.me ORDER BY ts DESC, post_id DESC) AS rank
  FROM (SELECT DISTINCT {who} AS me FROM {table}) u JOIN {table} p ON p.{who} <> u.me) WHERE rank <= 500"""


@entry("m5_content_topk", f"""
WITH w AS MATERIALIZED ({tfidf_sql(POSTS, min_df=2)}), taste AS MATERIALIZED ({_TASTE}),
len AS (SELECT author, sqrt(sum(w * w)) AS l FROM taste GROUP BY 1),
cand AS MATERIALIZED ({CANDIDATES.format(who='author', table='text_posts')}),
s AS (SELECT taste.author, w.doc AS post_id, round(sum(taste.w * w.w) / any_value(l), 9) AS score
  FROM taste JOIN w USING (term) JOIN len ON len.author = taste.author
  JOIN cand ON cand.me = taste.author AND cand.post_id = w.doc GROUP BY 1, 2)
SELECT author, post_id, {q6('score')} AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY author ORDER BY score DESC, post_id) AS rank FROM s) WHERE rank <= 10""")
def content_topk(t):
    found = rc.content_posts(author_posts(t), 10)
    return found.select(F.col("me").alias("author"), F.col("item").alias("post_id"), r6("score", "score"), "rank")


_PAIRS = f"""
WITH w AS MATERIALIZED ({TEXT100}),
v AS (SELECT doc, list(struct_pack(term := term, w := round(w, 9)) ORDER BY term) AS key FROM w GROUP BY doc),
m AS MATERIALIZED (SELECT doc, min(doc) OVER (PARTITION BY key) AS cls FROM v)
SELECT x.doc AS a, y.doc AS b, sum(x.w * y.w) AS weight FROM w x JOIN w y USING (term)
WHERE x.doc < y.doc AND x.doc IN (SELECT cls FROM m) AND y.doc IN (SELECT cls FROM m)
GROUP BY 1, 2 HAVING sum(x.w * y.w) > 0.3
UNION ALL SELECT cls, doc, 1.0 FROM m WHERE doc <> cls"""


@entry("j9_similarity_pairs", f"SELECT a, b, {q6('weight')} AS weight FROM ({_PAIRS})")
def similarity_pairs(t):
    """Pairs of classes of equal vectors, and each further member with its class."""
    found = sm.similar(ti.tfidf(t.text_posts, "author", max_features=100))
    return found.links().select("a", "b", r6("weight", "weight"))


_USER_TERMS = tfidf_sql(USERS, max_features=100)
_USER_TAGS = tfidf_sql(USERS, max_features=50, stop=False, terms=TAGS)
_FEATURES = f"""
WITH t AS ({_USER_TERMS}), g AS ({_USER_TAGS}), u AS (SELECT DISTINCT user_id FROM posts),
p AS (SELECT user_id, avg(sentiment_score) AS m, count(*) AS n,
  count(*) FILTER (sentiment_label = 'positive') / count(*) AS pos,
  count(*) FILTER (sentiment_label = 'negative') / count(*) AS neg,
  count(*) FILTER (sentiment_label = 'neutral') / count(*) AS neu FROM posts GROUP BY 1)
SELECT u.user_id, i AS axis, coalesce(t.w, 0) AS x
FROM u, (SELECT term, row_number() OVER (ORDER BY term) - 1 AS i FROM (SELECT DISTINCT term FROM t)) v
LEFT JOIN t ON t.doc = u.user_id AND t.term = v.term
UNION ALL
SELECT u.user_id, 100 + i, coalesce(g.w, 0)
FROM u, (SELECT term, row_number() OVER (ORDER BY term) - 1 AS i FROM (SELECT DISTINCT term FROM g)) v
LEFT JOIN g ON g.doc = u.user_id AND g.term = v.term
UNION ALL
SELECT user_id, unnest([150, 151, 152, 153, 154]), unnest([m, pos, neg, neu, n]) FROM p"""


def _long(features):
    return features.select(F.col("id").alias("user_id"), F.posexplode("v").alias("axis", "x")).select(
        "user_id", F.col("axis").cast("long").alias("axis"), r6("x", "x")
    )


@entry("m7_features", f"SELECT user_id, axis, {q6('x')} AS x FROM ({_FEATURES}) WHERE x <> 0")
def features(t):
    """The zeros of the dense vectors are left out of the listing."""
    return _long(cl.behaviour_features(t.posts)).filter(F.col("x") != 0)


SCALED_CTE = f"f AS ({_FEATURES}), s AS (SELECT axis, avg(x) AS m, stddev_pop(x) AS d FROM f GROUP BY 1)"


@entry("m8_scaled", f"""
WITH {SCALED_CTE}
SELECT user_id, axis, {q6('CASE WHEN d > 1e-12 THEN (x - m) / d ELSE 0 END')} AS x FROM f JOIN s USING (axis)
WHERE round(CASE WHEN d > 1e-12 THEN (x - m) / d ELSE 0 END, 6) <> 0""")
def scaled(t):
    return _long(cl.scaled(cl.behaviour_features(t.posts))).filter(F.col("x") != 0)
