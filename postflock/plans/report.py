"""Composite reports: dashboard, profile pages, tag report, clustering analysis."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from postflock.operators.cooccur import cooccurrence
from postflock.plans import cluster as cl, graph as gr, recommend as rc, stats as st, tags as tg
from postflock.plans.stats import profiles
from postflock.session import cut_lineage
from postflock.sources import analyses

# Page sizes.
PAGE, TRENDS, SUGGESTIONS = 10, 10, 5
MAP_CHUNK = 10_000


def dashboard(
    users: DataFrame, posts: DataFrame, post_tags: DataFrame, follows: DataFrame, as_of: Column,
    assigned: DataFrame | None = None, latent: bool = True,
) -> dict[str, DataFrame]:
    """One lazy frame per panel, each for all users."""
    features = tg.tag_features(post_tags, as_of)
    sources = [rc.latent_posts(posts, post_tags, 2 * SUGGESTIONS)] if latent else []
    sources += [
        rc.content_posts(posts, 2 * SUGGESTIONS), rc.collaborative_posts(posts, post_tags, 2 * SUGGESTIONS)
    ]
    return {
        "total_posts": posts.agg(F.count(F.lit(1)).alias("total")),
        "recent_posts": st.recent_posts(posts, PAGE),
        "followed_posts": gr.newest_feed(follows, posts, PAGE),
        "trending_tags": tg.trending_by_score(features, TRENDS),
        "recommended_posts": rc.hybrid_posts(users, posts, sources, SUGGESTIONS),
        "recommended_users": rc.hybrid_users(users, posts, post_tags, follows, assigned, SUGGESTIONS),
        "sentiment": st.chart_data(st.sentiment_stats(posts, users)),
    }


def profile_pages(users: DataFrame, posts: DataFrame, follows: DataFrame) -> DataFrame:
    """Counts, sentiment and newest post of every user. Whether a viewer follows a user is
    ``graph.relations``; the posts themselves are ``stats.recent_posts``."""
    newest = posts.groupBy("user_id").agg(F.max(F.struct("ts", "post_id")).alias("_n"))
    return (
        users.join(gr.follow_counts(users, follows), "user_id")
        .join(st.sentiment_stats(posts, users), "user_id").join(newest, "user_id", "left")
        .withColumn("newest_post", F.coalesce(F.col("_n.post_id"), F.lit(-1))).drop("_n")
    )


def tag_report(posts: DataFrame, post_tags: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    return {"co_occurrences": cooccurrence(posts), "trending": tg.trending(post_tags, as_of)}


def cooccurrence_maps(pairs: DataFrame, chunk: int = MAP_CHUNK) -> DataFrame:
    """(tag, part, others): the co-occurrence list of each tag as a map. A tag with more than
    ``chunk`` partners has several maps, split by hash, that together hold all of them."""
    sizes = pairs.groupBy("tag").agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64("other"), F.ceil(F.col("_n") / chunk)).alias("part")
    entries = F.array_sort(F.collect_list(F.struct(F.col("other").alias("key"), F.col("n").alias("value"))))
    return (
        pairs.join(sizes, "tag").select("tag", part, "other", "n").groupBy("tag", "part")
        .agg(F.map_from_entries(entries).alias("others"))
    )


@dataclass(frozen=True)
class Analysis:
    path: str
    n_clusters: int
    summary: DataFrame
    members: DataFrame


def clustering_analysis(
    users: DataFrame, posts: DataFrame, post_tags: DataFrame, root: str,
    n_clusters: int = cl.BEHAVIOUR_CLUSTERS, method: str = "kmeans", restarts: int = 10,
    stamp: str | None = None,
) -> Analysis:
    """Cluster users, save document and rows, return path and short summary."""
    text, people = cl.text_weights(posts), cut_lineage(profiles(posts))
    run = cl.behaviour_clusters(posts, n_clusters, method, restarts, text=text, people=people)
    run = replace(run, assigned=cut_lineage(run.assigned))
    quality = None
    if run.n_clusters > 1:
        flat = run.assigned.select(F.col("user_id").alias("id"), "cluster").filter(F.col("cluster") >= 0)
        quality = cl.silhouette(run.features, flat)
    full = cut_lineage(cl.summary(run.assigned, posts, post_tags, text, people))
    means = people.select("user_id", "avg_sentiment", "posts")
    stamp = stamp or datetime.now().strftime(analyses.STAMP)
    document = analyses.result_document(run, full, users, quality, stamp)
    rows = analyses.feature_rows(run, posts, post_tags, users, means)
    path = analyses.save_analysis(run, document, rows, users, root, stamp)
    return Analysis(path, run.n_clusters, cl.short_summary(full), cl.members(run.assigned, users))
