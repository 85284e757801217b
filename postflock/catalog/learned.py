"""Fitted models and sentiment. Models have no SQL form; their queries are checked by tests."""

import numpy as np
from pyspark.sql import functions as F

from postflock.catalog.registry import WORD, entry, q6, r6
from postflock.catalog.weights import SCALED_CTE, author_posts
from postflock.operators import induced as ind, lexicon as lx, similarity as sm, starts, tfidf as ti
from postflock.plans import cluster as cl, recommend as rc, tags as tg
from postflock.session import cut_lineage, stored

_ENDS = "CAST(ascii(term) % 21 - 10 AS DOUBLE) / 10"
# A lexicon drawn from the texts themselves: the 400 most frequent words, polarity by first
# letter, three-letter words as intensifiers, two-letter words as negations.
_LEXICON = f"""
SELECT term AS word, CASE WHEN length(term) > 3 THEN {_ENDS} END AS polarity,
  CASE WHEN length(term) = 3 THEN 1.5 END AS intensity, length(term) = 2 AS is_negation
FROM (SELECT term, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(text), '{WORD}{{2,}}')) AS term FROM text_posts) GROUP BY 1 ORDER BY n DESC, term LIMIT 400)"""


def text_lexicon(t):
    terms = ti.term_counts(t.text_posts, "post_id", stop_words=()).groupBy("term").agg(F.sum("tf").alias("n"))
    size, term = F.length("term"), F.col("term")
    return terms.orderBy(F.desc("n"), "term").limit(400).select(
        term.alias("word"), F.when(size > 3, (F.ascii(term) % 21 - 10).cast("double") / 10).alias("polarity"),
        F.when(size == 3, F.lit(1.5)).alias("intensity"), (size == 2).alias("is_negation"),
    )


_SCORES = rf"""
WITH lex AS ({_LEXICON}),
w AS (SELECT post_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT post_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+') AS ws FROM text_posts)),
b AS (SELECT *, lag(word, 1) OVER (PARTITION BY post_id ORDER BY pos) AS one,
  lag(word, 2) OVER (PARTITION BY post_id ORDER BY pos) AS two FROM w),
v AS (SELECT post_id, greatest(-1, least(1, p.polarity * coalesce(i.intensity, 1)
    * CASE WHEN n1.is_negation OR (i.intensity IS NOT NULL AND n2.is_negation) THEN -0.5 ELSE 1 END)) AS x
  FROM b JOIN lex p ON p.word = b.word AND p.polarity IS NOT NULL
  LEFT JOIN lex i ON i.word = b.one AND i.intensity IS NOT NULL
  LEFT JOIN lex n1 ON n1.word = b.one AND n1.is_negation LEFT JOIN lex n2 ON n2.word = b.two AND n2.is_negation),
s AS (SELECT post_id, avg(x) AS score FROM v GROUP BY 1)
SELECT post_id, coalesce(score, 0) AS score,
  CASE WHEN score > 0.3 THEN 'positive' WHEN score < -0.3 THEN 'negative' ELSE 'neutral' END AS label
FROM text_posts LEFT JOIN s USING (post_id)"""


@entry("m15_sentiment", f"SELECT post_id, {q6('score')} AS score, label FROM ({_SCORES})")
def sentiment(t):
    scored = lx.score_texts(t.text_posts, text_lexicon(t))
    return scored.select("post_id", r6("sentiment_score", "score"), F.col("sentiment_label").alias("label"))


@entry("m16_sentiment_batch", f"SELECT label, count(*) AS posts FROM ({_SCORES}) GROUP BY label")
def sentiment_batch(t):
    scored = lx.score_texts(t.text_posts, text_lexicon(t))
    return scored.groupBy(F.col("sentiment_label").alias("label")).agg(F.count(F.lit(1)).alias("posts"))


@entry("m17_backfill", f"""
SELECT post_id, {q6('coalesce(t.sentiment_score, s.score)')} AS score,
  coalesce(t.sentiment_label, s.label) AS label, t.sentiment_score IS NULL AS updated
FROM scored_text_posts t JOIN ({_SCORES}) s USING (post_id)""")
def backfill(t):
    done = lx.backfill(t.scored_text_posts, text_lexicon(t))
    return done.select("post_id", r6("sentiment_score", "score"), F.col("sentiment_label").alias("label"), "updated")


@entry("m15_log_odds", rf"""
WITH w AS (SELECT DISTINCT post_id, sentiment_score > 0 AS good, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+')) AS word
  FROM scored_text_posts WHERE sentiment_score <> 0),
c AS (SELECT word, count(*) FILTER (good) AS pos, count(*) FILTER (NOT good) AS neg FROM w GROUP BY 1),
a AS (SELECT *, sum(pos) OVER () AS p, sum(neg) OVER () AS n, {ind.PRIOR} * (pos + neg) / (sum(pos + neg) OVER ()) AS a FROM c),
o AS (SELECT *, ln((pos + a) / (p + {ind.PRIOR})) - ln((neg + a) / (n + {ind.PRIOR})) AS odds FROM a)
SELECT word, pos, neg, {q6('odds')} AS log_odds, {q6('odds / sqrt(1 / (pos + a) + 1 / (neg + a))')} AS z FROM o""")
def log_odds(t):
    """Every word of the scored texts with its odds of standing in a positive rather than a negative one."""
    return ind.log_odds(t.scored_text_posts).select("word", "pos", "neg", r6("log_odds", "log_odds"), r6("z", "z"))


@entry("m15_held_out")
def held_out(t):
    """Posts of the fold that the induced lexicon has not seen, by the sign of their score and of the lexicon's."""
    scored = ind.held_out(t.posts)
    sign = F.signum("score").cast("int").alias("found")
    return scored.groupBy("said", sign).agg(F.count(F.lit(1)).alias("posts"))


@entry("m6_als")
def latent(t):
    found = rc.latent_posts(t.posts, t.post_tags, 10)
    return found.select(F.col("me").alias("user_id"), F.col("item").alias("post_id"), r6("score", "score"), "rank")


@entry("m9_pca")
def axes(t):
    placed = cl.project(cl.scaled(cl.behaviour_features(t.posts)))
    return placed.select(F.col("id").alias("user_id"), r6(F.get("p", F.lit(0)), "x"), r6(F.get("p", F.lit(1)), "y"))


@entry("m10_kmeans")
def kmeans(t):
    features = cl.scaled(cl.behaviour_features(t.posts))
    return cl.kmeans(features, cl.BEHAVIOUR_CLUSTERS).withColumnRenamed("id", "user_id")


_STEP = f"""
WITH {SCALED_CTE},
p AS (SELECT f.user_id, axis, CASE WHEN d > 1e-12 THEN (x - m) / d ELSE 0 END AS x FROM f JOIN s USING (axis)),
ids AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS i, row_number() OVER (ORDER BY user_id DESC) AS j
  FROM (SELECT DISTINCT user_id FROM p)),
c AS (SELECT 0 AS start, i - 1 AS cluster, axis, x FROM p JOIN ids USING (user_id) WHERE i <= {cl.BEHAVIOUR_CLUSTERS}
  UNION ALL
  SELECT 1, {cl.BEHAVIOUR_CLUSTERS} - j, axis, x FROM p JOIN ids USING (user_id) WHERE j <= {cl.BEHAVIOUR_CLUSTERS}),
g AS (SELECT user_id, start, cluster, sum((p.x - c.x) * (p.x - c.x)) AS gap FROM p JOIN c USING (axis) GROUP BY 1, 2, 3),
near AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id, start ORDER BY gap, cluster) = 1),
cost AS (SELECT start, cluster, count(*) AS size, sum(gap) AS cost FROM near GROUP BY 1, 2)
SELECT CAST(start AS BIGINT) AS start, cluster, axis, {q6('avg(x)')} AS x, any_value(size) AS size, {q6('any_value(cost)')} AS cost
FROM near JOIN p USING (user_id) JOIN cost USING (start, cluster) GROUP BY start, cluster, axis"""


@entry("m10_lloyd_step", _STEP)
def lloyd_step(t):
    """New centres, sizes and costs after one pass for two starts: the first and the last users by id."""
    points = cl.prepared(cl.scaled(cl.behaviour_features(t.posts)))
    k = cl.BEHAVIOUR_CLUSTERS
    ends = [points.orderBy("id").limit(k).collect(), points.orderBy(F.desc("id")).limit(k).collect()[::-1]]
    step = starts.moments(points, [np.array([r["v"] for r in rows]) for rows in ends])
    return step.select(
        F.col("start").cast("long").alias("start"), F.col("cluster").cast("long").alias("cluster"),
        F.col("axis").cast("long").alias("axis"), r6(F.col("total") / F.col("size"), "x"), "size", r6("cost", "cost"))


@entry("m11_kmeans_tfidf")
def kmeans_text(t):
    features = cl.content_features(author_posts(t))
    named = cl.kmeans(_numbered(features), cl.CONTENT_CLUSTERS, restarts=1)
    return named


def _numbered(features):
    """Text keys as stable numbers, for the operators that want integer ids."""
    return features.withColumn("id", F.xxhash64("id"))


@entry("m12_dbscan")
def dbscan(t):
    run = cl.behaviour_clusters(t.posts, method="dbscan")
    return run.assigned.select("user_id", "cluster")


@entry("m13_silhouette")
def silhouette(t):
    """Each cluster with its size and the quality of the whole clustering."""
    features = cut_lineage(cl.content_features(t.posts))
    labels = cl.kmeans(features, cl.CONTENT_CLUSTERS, restarts=3)
    quality = cl.silhouette(features, labels)
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).withColumn("silhouette", F.lit(quality))


@entry("m14_trending_lr")
def trending_model(t):
    found = tg.trending_by_model(tg.tag_features(t.post_tags, t.as_of))
    return found.select("tag", r6("probability", "probability"))


@entry("r1_posts")
def hybrid_posts(t):
    sources = [
        rc.latent_posts(t.posts, t.post_tags, 10), rc.content_posts(t.posts, 10),
        rc.collaborative_posts(t.posts, t.post_tags, 10),
    ]
    found = rc.hybrid_posts(t.users, t.posts, sources, 5)
    return found.select(F.col("me").alias("user_id"), F.col("item").alias("post_id"), "source", "rank")


@entry("r3_users")
def hybrid_users(t):
    assigned = cl.content_clusters(t.posts)
    found = rc.hybrid_users(t.users, t.posts, t.post_tags, t.follows, assigned)
    return found.select(F.col("me").alias("user_id"), F.col("item").alias("other_id"), "source", "rank")


@entry("r15_clusters")
def content_clusters(t):
    return cl.content_clusters(t.posts).select("user_id", "cluster", r6("x", "x"), r6("y", "y"))


def _r6_cosine(value):
    """``r6`` of a cosine, to the same double: decimal rounding, by far the dearest step of a pair, is done only where
    the seventh place and those behind it lie about half way."""
    scaled = value * 1e6
    near_half = F.abs(scaled - F.floor(scaled) - 0.5) <= 1e-6
    return F.when(near_half, F.round(value, 6)).otherwise(F.floor(scaled + 0.5) / 1e6) + F.lit(0.0)


@entry("r16_sim_network")
def similarity_network(t):
    """Edges between classes of users with equal texts, and each further user with its class, with the clusters of
    both ends and the number of users that the first of them is linked with."""
    posts = t.posts
    text = cl.text_weights(posts)
    found = cl.content_clusters(posts, text=text).select(F.col("user_id").alias("doc"), "cluster")
    network = sm.similar(text)
    # Stored, so that the clusters and the links are not made again for every use.
    known = stored(found.join(network.degrees(), "doc"), "known")
    return network.links(known, a=("cluster", "links"), b=("cluster",)).select(
        "a", "b", _r6_cosine(F.col("weight")).alias("weight"), "cluster_a", "cluster_b", "links_a")


@entry("r17_behaviour")
def behaviour(t):
    run = cl.behaviour_clusters(t.posts)
    return run.assigned.select("user_id", "cluster", r6("x", "x"), r6("y", "y"))
