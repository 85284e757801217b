"""User features, clusters and cluster reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from postflock.functions import text as tx, trend as tr
from postflock.operators import starts, tfidf as ti
from postflock.operators.dbscan import dbscan, default_min_samples, renumber
from postflock.operators.ranking import top_k
from postflock.plans.stats import profiles
from postflock.session import cut_lineage

TEXT_TERMS, TAG_TERMS = 100, 50
CONTENT_CLUSTERS, BEHAVIOUR_CLUSTERS = 3, 5
EPS = 0.5
# Projected axes for the neighbour search; the first three form its grid, all of them prune.
GRID_AXES = 6
SHOWN_TERMS, SHOWN_MEMBERS = 10, 5


def text_weights(posts: DataFrame, max_features: int = TEXT_TERMS) -> DataFrame:
    """(doc, term, w) per user over all their posts; the texts are never joined into one."""
    return ti.tfidf(posts, "user_id", max_features=max_features)


def tag_weights(posts: DataFrame, max_features: int = TAG_TERMS) -> DataFrame:
    """(doc, term, w) per user over tags with repeats, no stop list; a tag once per post."""
    words = F.filter(tx.tag_set(F.col("text")), lambda t: F.length(t) > 1)
    return ti.tfidf(posts, "user_id", words, (), max_features=max_features)


def dense(weights: DataFrame, docs: DataFrame, width: int, name: str) -> DataFrame:
    """``docs(doc)`` with an array of ``width`` weights in term order, zeros where there is none.
    ``width`` bounds the group gathered per document."""
    terms = ti.indexed(weights.select("term").distinct())
    entries = F.map_from_entries(F.collect_list(F.struct("idx", "w")))
    packed = weights.join(terms, "term").groupBy("doc").agg(entries.alias("_m"))
    places = F.sequence(F.lit(0), F.lit(width - 1))
    values = F.transform(
        places, lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0))
    )
    return docs.join(packed, "doc", "left").withColumn(name, values).drop("_m")


def behaviour_features(posts: DataFrame, text: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """(id, v): text terms, tag terms, mean score, label shares, post count. One vocabulary. ``text`` and ``people`` are
    ``text_weights`` and ``profiles`` of the posts, where they have been made already."""
    people = (profiles(posts) if people is None else people).withColumnRenamed("user_id", "doc")
    docs = dense(text_weights(posts) if text is None else text, people, TEXT_TERMS, "_text")
    docs = dense(tag_weights(posts), docs, TAG_TERMS, "_tags")
    shares = [tr.label_share(F.col(n), F.col("posts")) for n in ("positive", "negative", "neutral")]
    tail = F.array(F.col("avg_sentiment"), *shares, F.col("posts").cast("double"))
    return docs.select(F.col("doc").alias("id"), F.concat("_text", "_tags", tail).alias("v"))


def content_features(posts: DataFrame, text: DataFrame | None = None) -> DataFrame:
    """(id, v) of all users. ``text`` is ``text_weights`` of the posts, where they have been made already."""
    docs = posts.select(F.col("user_id").alias("doc")).distinct()
    return dense(text_weights(posts) if text is None else text, docs, TEXT_TERMS, "v").withColumnRenamed("doc", "id")


def scaled(features: DataFrame) -> DataFrame:
    """Each axis to mean 0 and population deviation 1; a constant axis to 0. The moments are one
    row per axis, gathered into two short arrays. Moments and values both read the features, which are made once."""
    features = cut_lineage(features)
    axes = (
        features.select(F.posexplode("v").alias("axis", "x")).groupBy("axis")
        .agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    )
    ordered = axes.agg(F.array_sort(F.collect_list(F.struct("axis", "m", "s"))).alias("a"))
    moments = ordered.select(F.transform("a", lambda e: F.struct(e["m"].alias("m"), e["s"].alias("s")))).scalar()
    pairs = F.arrays_zip(F.col("v").alias("x"), F.col("_m").alias("q"))
    flat = F.lit(1e-12)
    return features.withColumn("_m", moments).select(
        "id", F.transform(
            pairs,
            lambda p: F.when(p["q"]["s"] > flat, (p["x"] - p["q"]["m"]) / p["q"]["s"]).otherwise(0.0),
        ).alias("v"),
    )


def centred(features: DataFrame) -> DataFrame:
    means = (
        features.select(F.posexplode("v").alias("axis", "x")).groupBy("axis").agg(F.avg("x").alias("m"))
        .agg(F.array_sort(F.collect_list(F.struct("axis", "m"))).alias("a"))
        .select(F.transform("a", lambda e: e["m"])).scalar()
    )
    return features.withColumn("_m", means).select(
        "id", F.zip_with("v", "_m", lambda x, m: x - m).alias("v")
    )


def prepared(features: DataFrame) -> DataFrame:
    """Features spread and sorted by id so that a fit can be repeated. Stored once, so that every pass reads
    few, well filled partitions."""
    spread = features.repartition("id").sortWithinPartitions("id")
    return cut_lineage(spread.select("id", "v")).persist()


def project(features: DataFrame, k: int = 2) -> DataFrame:
    """(id, p): coordinates on the first ``k`` principal axes of ``features(id, v)``. Each axis is
    turned so that its largest loading is positive."""
    data = centred(features).withColumn("features", array_to_vector("v")).persist()
    model = PCA(k=k, inputCol="features", outputCol="p").fit(data)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    turn = F.array(*[F.lit(s) for s in signs])
    turned = F.zip_with(vector_to_array("p"), turn, lambda x, s: x * s)
    placed = cut_lineage(model.transform(data).select("id", turned.alias("p")))
    data.unpersist()
    return placed


def kmeans(features: DataFrame, k: int, restarts: int = 10, seed: int = 42) -> DataFrame:
    """(id, cluster): the best of several starts, clusters numbered by size, then least id. All starts share each pass
    over the points; an empty table has no clusters."""
    data = prepared(features)
    if data.isEmpty():
        labels = data.select("id", F.lit(0).alias("prediction"))
    else:
        labels = cut_lineage(starts.assign(data, starts.fit(data, k, restarts, seed).best))
    data.unpersist()
    return renumber(labels, "prediction", "cluster")


def silhouette(features: DataFrame, assigned: DataFrame) -> float:
    """Mean silhouette with squared distances, in one pass over points and cluster moments."""
    data = features.join(assigned, "id").withColumn("features", array_to_vector("v"))
    return ClusteringEvaluator(predictionCol="cluster", featuresCol="features").evaluate(data)


@dataclass(frozen=True)
class Behaviour:
    """Clusters by behaviour: (user_id, x, y, cluster) and facts about them."""

    assigned: DataFrame
    features: DataFrame
    method: str
    n_clusters: int
    user_count: int


def behaviour_clusters(
    posts: DataFrame, n_clusters: int = BEHAVIOUR_CLUSTERS, method: str = "kmeans",
    restarts: int = 10, eps: float = EPS, text: DataFrame | None = None, people: DataFrame | None = None,
) -> Behaviour:
    features = cut_lineage(scaled(behaviour_features(posts, text, people)))
    count = features.count()
    axes = project(features, GRID_AXES if method == "dbscan" else 2)
    if method == "kmeans":
        labels = kmeans(features, min(n_clusters, count), restarts)
    elif method == "dbscan":
        labels = dbscan(features.join(axes, "id"), eps, default_min_samples(count), axes=3)
    else:
        raise ValueError(f"unknown method: {method}")
    assigned = labels.join(axes, "id").select(
        F.col("id").alias("user_id"), F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"), "cluster"
    )
    found = labels.filter(F.col("cluster") >= 0).agg(F.count_distinct("cluster")).first()[0]
    return Behaviour(assigned, features, method, found, count)


def content_clusters(
    posts: DataFrame, k: int = CONTENT_CLUSTERS, restarts: int = 1, text: DataFrame | None = None
) -> DataFrame:
    """(user_id, x, y, cluster) from text weights alone."""
    features = cut_lineage(content_features(posts, text))
    labels = kmeans(features, k, restarts)
    return labels.join(project(features), "id").select(
        F.col("id").alias("user_id"), F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"), "cluster"
    )


# ---- reports -------------------------------------------------------------------------------

def top_terms(weights: DataFrame, assigned: DataFrame, k: int = SHOWN_TERMS) -> DataFrame:
    """(cluster, term, score, rank): terms by mean weight over all members of the cluster."""
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("_size"))
    sums = (
        weights.withColumnRenamed("doc", "user_id").join(assigned.select("user_id", "cluster"), "user_id")
        .groupBy("cluster", "term").agg(F.sum("w").alias("_sum"))
    )
    scored = sums.join(sizes, "cluster").select(
        "cluster", "term", F.round(F.col("_sum") / F.col("_size"), 9).alias("score")
    )
    return top_k(scored, ["cluster"], [F.desc("score"), F.col("term")], k)


def top_tags(post_tags: DataFrame, assigned: DataFrame, k: int = SHOWN_TERMS) -> DataFrame:
    """(cluster, tag, n, rank): tags by use. Counted per user first, so the join is small."""
    uses = post_tags.groupBy("user_id", "tag").agg(F.count(F.lit(1)).alias("_n"))
    summed = (
        uses.join(assigned.select("user_id", "cluster"), "user_id")
        .groupBy("cluster", "tag").agg(F.sum("_n").alias("n"))
    )
    return top_k(summed, ["cluster"], [F.desc("n"), F.col("tag")], k)


def members(assigned: DataFrame, users: DataFrame) -> DataFrame:
    """(cluster, user_id, username), long form: whole, whatever the size of a cluster."""
    return assigned.select("user_id", "cluster").join(users.select("user_id", "username"), "user_id")


def summary(
    assigned: DataFrame, posts: DataFrame, post_tags: DataFrame, weights: DataFrame, people: DataFrame | None = None
) -> DataFrame:
    """(cluster, size, avg_sentiment, top_keywords, top_hashtags). Keywords are shown in
    alphabetical order, tags by use. Members are not in it: see ``members``."""
    means = (profiles(posts) if people is None else people).select("user_id", "avg_sentiment")
    facts = (
        assigned.select("user_id", "cluster").join(means, "user_id").groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("size"), F.avg("avg_sentiment").alias("avg_sentiment"))
    )
    words = top_terms(weights, assigned).groupBy("cluster").agg(
        F.array_sort(F.collect_list("term")).alias("top_keywords")
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", "tag")))
    marks = top_tags(post_tags, assigned).groupBy("cluster").agg(
        F.transform(ordered, lambda e: e["tag"]).alias("top_hashtags")
    )
    empty = F.array().cast("array<string>")
    return (
        facts.join(words, "cluster", "left").join(marks, "cluster", "left")
        .withColumn("top_keywords", F.coalesce("top_keywords", empty))
        .withColumn("top_hashtags", F.coalesce("top_hashtags", empty))
    )


def short_summary(full: DataFrame, shown: int = 3) -> DataFrame:
    return full.select(
        "cluster", "size", "avg_sentiment",
        F.slice("top_keywords", 1, shown).alias("top_keywords"),
        F.slice("top_hashtags", 1, shown).alias("top_hashtags"),
    )


def mood(full: DataFrame) -> DataFrame:
    return full.select("cluster", "avg_sentiment", "size", tx.mood_label(F.col("avg_sentiment")).alias("label"))


def keywords(full: DataFrame) -> DataFrame:
    return full.select("cluster", "top_keywords", "size")


def hashtags(full: DataFrame) -> DataFrame:
    return full.select("cluster", "top_hashtags", "size")


def member_preview(assigned: DataFrame, users: DataFrame, shown: int = SHOWN_MEMBERS) -> DataFrame:
    """(number, size, users): clusters numbered from 1 with their first members by id."""
    first = top_k(assigned.select("cluster", "user_id"), ["cluster"], [F.col("user_id")], shown)
    names = first.join(users.select("user_id", "username"), "user_id").groupBy("cluster").agg(
        F.array_sort(F.collect_list(F.struct("rank", "username"))).alias("_u")
    )
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(names, "cluster").select(
        (F.col("cluster") + 1).alias("number"), "size", F.transform("_u", lambda e: e["username"]).alias("users")
    )
