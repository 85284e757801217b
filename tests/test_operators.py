"""Operators against brute force on small frames, with hot keys and forced bounded paths."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from postflock.catalog import learned, registry
from postflock.operators import overlap as ov, tfidf as ti
from postflock.operators import (
    blocks as bl, dbscan as db, induced as ind, products as pr, quantile as qu, ranking as rk, similarity as sm, starts,
)
from postflock.operators.dbscan import dbscan
from postflock.operators.quantile import exact_quantile
from postflock.operators.ranking import (
    bucketed_rank, dense_ids, first_unexcluded, first_wins, priority_union, top_k,
)
from postflock.plans import cluster as cl, recommend as rc


def hot_sets(people=60, keys=25, seed=3):
    """Sets in which one key is held by nearly everyone."""
    rng = random.Random(seed)
    counts = {}
    for p in range(people):
        if rng.random() < 0.9:
            counts[p, "hot"] = rng.choice([1, 1, 1, 2, 5])
        for _ in range(rng.randint(0, 5)):
            counts[p, f"k{rng.randint(0, keys)}"] = rng.randint(1, 4)
    return counts


def by_sum(counts, excluded, k):
    wanted, held = defaultdict(set), defaultdict(dict)
    for (p, key), n in counts.items():
        wanted[p].add(key)
        held[p][key] = n
    found = {}
    for me in wanted:
        scores = [
            (-sum(n for key, n in held[o].items() if key in wanted[me]), o)
            for o in held if o != me and (me, o) not in excluded
        ]
        found[me] = [(o, -s) for s, o in sorted(x for x in scores if x[0] < 0)[:k]]
    return {m: r for m, r in found.items() if r}


def listed(frame):
    rows = defaultdict(list)
    for r in frame.orderBy("me", "rank").collect():
        rows[r["me"]].append((r["item"], r["score"]))
    return dict(rows)


@pytest.mark.parametrize("head,plain_rows", [(4, 0), (16, 0), (1000, 0), (4, 10**9)])
@pytest.mark.parametrize("seed", [3, 4])
def test_top_by_sum(spark, head, plain_rows, seed):
    counts = hot_sets(seed=seed)
    rng = random.Random(seed)
    excluded = {(rng.randint(0, 59), rng.randint(0, 59)) for _ in range(150)}
    rows = [(p, k, n) for (p, k), n in counts.items()]
    data = spark.createDataFrame(rows, "p long, key string, n long")
    out = spark.createDataFrame(sorted(excluded), "me long, item long")
    found = ov.top_by_sum(
        data.select(F.col("p").alias("me"), "key"),
        data.select("key", F.col("p").alias("item"), F.col("n").alias("v")),
        3, exclude=out, head=head, plain_rows=plain_rows,
    )
    assert listed(found) == by_sum(counts, excluded, 3)


def test_top_by_sum_salted(spark, monkeypatch):
    monkeypatch.setattr(ov, "SENT_ITEMS", 0)
    counts = hot_sets(seed=5)
    data = spark.createDataFrame([(p, k, n) for (p, k), n in counts.items()], "p long, key string, n long")
    found = ov.top_by_sum(
        data.select(F.col("p").alias("me"), "key"),
        data.select("key", F.col("p").alias("item"), F.col("n").alias("v")), 4,
    )
    assert listed(found) == by_sum(counts, set(), 4)


def test_one_hot_key_is_settled_without_the_plain_join(spark, monkeypatch):
    """All hold one key once: ties are proven by id, so nobody is sent to the plain join."""
    data = spark.createDataFrame([(p, "hot") for p in range(500)], "me long, key string")
    seen = []
    real = ov._settle

    def spy(wants, best, bound, proven, plain, k):
        closed = best.filter(F.col("rank") == k).join(bound, "me").filter(proven)
        seen.append(bound.count() - closed.count())
        return real(wants, best, bound, proven, plain, k)

    monkeypatch.setattr(ov, "_settle", spy)
    postings = data.select("key", F.col("me").alias("item"), F.lit(1).cast("long").alias("v"))
    found = listed(ov.top_by_sum(data, postings, 2, head=8, plain_rows=0))
    assert found[0] == [(1, 1), (2, 1)] and found[400] == [(0, 1), (1, 1)]
    found = listed(ov.top_by_jaccard(data, 2, head=8, plain_rows=0))
    assert found[400] == [(0, 1.0), (1, 1.0)]
    assert seen == [0, 0]


@pytest.mark.parametrize("head,plain_rows", [(4, 0), (16, 0), (4, 10**9)])
@pytest.mark.parametrize("seed", [6, 7])
def test_top_by_jaccard(spark, head, plain_rows, seed):
    sets = defaultdict(set)
    for p, key in hot_sets(seed=seed):
        sets[p].add(key)
    rows = [(p, k) for p, s in sets.items() for k in s]
    found = listed(ov.top_by_jaccard(spark.createDataFrame(rows, "me long, key string"), 3, head, plain_rows))
    for me in sets:
        scores = [(-len(sets[me] & sets[o]) / len(sets[me] | sets[o]), o) for o in sets if o != me]
        assert found.get(me, []) == [(o, -s) for s, o in sorted(x for x in scores if x[0] < 0)[:3]]


@pytest.mark.parametrize("head", [4, 16])
def test_two_steps_stay_exact(spark, monkeypatch, head):
    """The same two steps where a product of blocks would cost less."""
    monkeypatch.setattr(ov, "STEP_PAIRS", 0)
    counts = hot_sets(seed=9)
    data = spark.createDataFrame([(p, k, n) for (p, k), n in counts.items()], "p long, key string, n long")
    wants = data.select(F.col("p").alias("me"), "key")
    postings = data.select("key", F.col("p").alias("item"), F.col("n").alias("v"))
    assert listed(ov.top_by_sum(wants, postings, 3, head=head, plain_rows=0)) == by_sum(counts, set(), 3)
    whole = listed(ov.top_by_jaccard(wants, 3))
    assert listed(ov.top_by_jaccard(wants, 3, head=head, plain_rows=0)) == whole


def test_many_popular_keys_are_multiplied_in_blocks(spark, monkeypatch):
    """Where all share many popular keys the two steps, which shuffle pairs, are not begun."""
    def refuse(*_):
        raise AssertionError("the two steps made pairs")

    monkeypatch.setattr(ov, "_settle", refuse)
    for name, value in (("BLOCK_ROWS", 16), ("TILE", 300), ("PIECE", 7), ("FIRST", 3), ("STEP", 8), ("DENSE", 150)):
        monkeypatch.setattr(pr, name, value)
    counts = hot_sets(seed=8)
    excluded = {(p, (p * 7) % 60) for p in range(60)}
    data = spark.createDataFrame([(p, k, n) for (p, k), n in counts.items()], "p long, key string, n long")
    wants = data.select(F.col("p").alias("me"), "key")
    found = ov.top_by_sum(
        wants, data.select("key", F.col("p").alias("item"), F.col("n").alias("v")), 5,
        exclude=spark.createDataFrame(sorted(excluded), "me long, item long"), head=16, plain_rows=0,
    )
    assert listed(found) == by_sum(counts, excluded, 5)
    sets = defaultdict(set)
    for p, key in counts:
        sets[p].add(key)
    found = listed(ov.top_by_jaccard(wants, 5, head=16, plain_rows=0))
    for me in sets:
        scores = [(-len(sets[me] & sets[o]) / len(sets[me] | sets[o]), o) for o in sets if o != me]
        assert found.get(me, []) == [(o, -s) for s, o in sorted(x for x in scores if x[0] < 0)[:5]]


def test_pair_overlap(spark):
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c")], "me long, key string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 4)], "a long, b long")
    found = {(r.a, r.b): (r.common, r.either, r.jaccard) for r in ov.pair_overlap(pairs, sets).collect()}
    assert found == {(1, 2): (1, 3, 1 / 3), (1, 3): (0, 2, 0.0), (3, 4): (0, 0, 0.0)}


def test_similar_pairs(spark):
    rng = np.random.default_rng(1)
    vectors = {}
    for d in range(40):
        w = rng.random(12) * (rng.random(12) < 0.4)
        if w.any():
            vectors[d] = w / np.linalg.norm(w)
    rows = [(d, f"t{i:02}", float(x)) for d, v in vectors.items() for i, x in enumerate(v) if x > 0]
    found = {(r.a, r.b): r.weight for r in ti.similar_pairs(spark.createDataFrame(rows, "doc long, term string, w double")).collect()}
    expected = {
        (a, b): float(vectors[a] @ vectors[b]) for a in vectors for b in vectors
        if a < b and vectors[a] @ vectors[b] > 0.3
    }
    assert found.keys() == expected.keys()
    assert all(math.isclose(found[p], expected[p], abs_tol=1e-12) for p in found)


@pytest.mark.parametrize("n", [1, 2, 7, 144, 25_000])
def test_exact_quantile(spark, n):
    rng = np.random.default_rng(n)
    data = np.where(rng.random(n) < 0.3, 2.0, np.round(rng.random(n) * 3, 4))
    frame = spark.createDataFrame([(float(x),) for x in data], "x double")
    assert math.isclose(exact_quantile(frame, "x", 0.8).first()[0], float(np.percentile(data, 80)), abs_tol=1e-12)


def brute_dbscan(points, eps, least):
    """Labels up to numbering: cores joined by reach, border points to the least core label."""
    gaps = np.linalg.norm(points[:, None] - points[None], axis=2) <= eps
    core = gaps.sum(axis=1) >= least
    label = np.full(len(points), -1)
    for i in range(len(points)):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] < 0:
                    label[j] = i
                    stack += [m for m in np.flatnonzero(gaps[j] & core) if label[m] < 0]
    for i in np.flatnonzero(~core):
        near = label[np.flatnonzero(gaps[i] & core)]
        label[i] = near.min() if len(near) else -1
    found = [x for x in np.unique(label) if x >= 0]
    order = sorted(found, key=lambda x: (-(label == x).sum(), np.flatnonzero(label == x).min()))
    return [order.index(x) if x >= 0 else -1 for x in label]


@pytest.mark.parametrize("axes", [1, 2])
def test_dbscan(spark, axes):
    rng = np.random.default_rng(5)
    points = np.concatenate([
        rng.normal(0, 0.25, (40, 4)), rng.normal(3, 0.25, (30, 4)), np.linspace([0] * 4, [1.2] * 4, 6),
        rng.uniform(-8, 8, (15, 4)), np.repeat([[6.0, 6, 6, 6]], 5, axis=0),
    ])
    rows = [(i, [float(x) for x in p], [float(x) for x in p[:2]]) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "id long, v array<double>, p array<double>")
    found = {r.id: r.cluster for r in dbscan(frame, 0.5, 3, axes).collect()}
    assert [found[i] for i in range(len(points))] == brute_dbscan(points, 0.5, 3)


def test_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 2), rng.randint(0, 3), i * 40_000) for i in range(300)]
    frame = spark.createDataFrame(rows, "g long, n long, id long")
    found = {r.id: r["rank"] for r in bucketed_rank(frame, ["g"], "id", ["n"]).collect()}
    for g in range(3):
        expected = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [found[r[2]] for r in expected] == list(range(1, len(expected) + 1))
    ids = {r.id: r.no for r in dense_ids(frame, "id", "no", 16).collect()}
    assert sorted(ids.values()) == list(range(1, 301))


def test_top_k_beyond_the_group_limit(spark):
    frame = spark.range(5000).select(F.lit(1).alias("g"), "id")
    found = top_k(frame, ["g"], [F.desc("id")], 1500).collect()
    assert sorted(r.id for r in found) == list(range(3500, 5000))


def test_first_wins(spark):
    frame = spark.createDataFrame([(3, "a", "z"), (1, "a", "y"), (2, "b", "x")], "no long, k string, v string")
    assert sorted(tuple(r) for r in first_wins(frame, ["k"], "no").collect()) == [(1, "a", "y"), (2, "b", "x")]


def test_first_unexcluded(spark):
    rng = random.Random(8)
    members = [(g, i) for i in range(80) for g in [i % 2]]
    ranked = spark.createDataFrame([(g, i, i // 2 + 1) for g, i in members], "grp long, item long, rank long")
    requests = spark.createDataFrame([(i, g) for g, i in members], "me long, grp long")
    out = {(i, i) for _, i in members} | {(4, j) for j in range(0, 70)} | {(rng.randint(0, 79), rng.randint(0, 79)) for _ in range(200)}
    found = first_unexcluded(requests, ranked, spark.createDataFrame(sorted(out), "me long, item long"), 3)
    lists = defaultdict(list)
    for r in found.orderBy("me", "rank").collect():
        lists[r.me].append(r.item)
    for g, me in members:
        assert lists[me] == [i for h, i in members if h == g and (me, i) not in out][:3]


def test_priority_union(spark):
    first = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "me long, item long, rank long")
    second = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (2, 13, 1)], "me long, item long, rank long")
    found = sorted((r.me, r["rank"], r.item, r.source) for r in priority_union([first, second], 2).collect())
    assert found == [(1, 1, 10, 0), (1, 2, 11, 0), (2, 1, 13, 1)]


def test_candidates_with_a_busy_author(spark):
    """One author wrote nearly all new posts; everyone still gets the newest ten by others."""
    start = datetime(2024, 1, 1)
    posts = [(i, 1 if i >= 40 else i % 7, start + timedelta(minutes=i)) for i in range(200)]
    frame = spark.createDataFrame(posts, "post_id long, user_id long, ts timestamp")
    people = frame.select(F.col("user_id").alias("me")).distinct()
    pool = rc.newest_pool(frame, 10)
    assert pool.count() <= 30
    lists = defaultdict(list)
    for r in rc.newest_by_others(people, pool, 10).orderBy("me", "rank").collect():
        lists[r.me].append(r.item)
    for me in range(7):
        assert lists[me] == [p for p, u, _ in reversed(posts) if u != me][:10]


def _unit_rows(rng, n, copies):
    vectors = []
    for _ in range(n):
        w = rng.random(10) * (rng.random(10) < 0.4)
        w[0] = 0.3
        vectors.append(w / np.linalg.norm(w))
    vectors += [vectors[i % 5] for i in range(copies)]
    return vectors, [(d, f"t{i:02}", float(x)) for d, v in enumerate(vectors) for i, x in enumerate(v) if x > 0]


@pytest.mark.parametrize("block_rows", [7, 2000])
def test_similar_classes(spark, block_rows):
    """Copies are members, not pairs; one term stands in every vector."""
    vectors, rows = _unit_rows(np.random.default_rng(4), 60, 40)
    found = sm.similar(spark.createDataFrame(rows, "doc long, term string, w double"), 0.6, block_rows)
    members = dict(found.members.collect())
    assert members == {d: next(i for i, v in enumerate(vectors) if np.allclose(v, vectors[d], atol=1e-12)) for d in range(100)}
    first = sorted(set(members.values()))
    expected = {(a, b): vectors[a] @ vectors[b] for a in first for b in first if a < b and vectors[a] @ vectors[b] > 0.6}
    pairs = {(r.a, r.b): r.weight for r in found.pairs.collect()}
    assert pairs.keys() == expected.keys() and all(math.isclose(pairs[p], expected[p], abs_tol=1e-12) for p in pairs)
    linked = {d: sum(vectors[d] @ v > 0.6 for v in vectors) - 1 for d in range(100)}
    assert dict(found.degrees().collect()) == linked
    best = [(r.cls, r.other) for r in found.strongest(2).collect()]
    for a in first:
        near = sorted((-w, x + y - a) for (x, y), w in expected.items() if a in (x, y))[:2]
        assert sorted(o for c, o in best if c == a) == sorted(o for _, o in near)


def test_a_term_of_all_vectors_is_dealt(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc"), F.lit("all").alias("term"), F.lit(0.2).alias("w"),
                                    F.lit(0.5).alias("after"), F.array().cast("array<string>").alias("before"))
    left, right, keys = bl.dealt_sides(rows, rows, ["term"], F.col("doc"), F.col("doc"), 100)
    most = [s.groupBy(*keys).count().agg(F.max("count"), F.count("*")).first() for s in (left, right)]
    assert all(m[0] <= 200 and m[1] == 900 for m in most)
    assert sm.candidates(rows, 0.3).count() == 0 and sm.candidates(rows, 0.29, 100).count() == 3000 * 2999 // 2


def test_matched_to_few_keeps_every_row(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 3000, -1).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    found = bl.matched_to_few(rows, groups, "k", "n").collect()
    assert len(found) == 5000 and {r.n for r in found if r.k == -1} == {3000}


@pytest.mark.parametrize("least", [3, 6])
@pytest.mark.parametrize("seed", [1, 2])
def test_dbscan_with_dense_cells(spark, seed, least):
    """Piles, touching piles, points just inside and outside their reach, and copies."""
    rng = np.random.default_rng(seed)
    points = np.concatenate([
        rng.normal(0, 0.04, (60, 2)), rng.normal([0.55, 0], 0.05, (50, 2)), rng.normal([1.5, 1.5], 0.3, (80, 2)),
        rng.uniform(-2, 3, (60, 2)), np.repeat([[2.5, -1.5]], 7, axis=0), [[2.5, -1.0], [2.5, -0.99], [2.99, -1.5]],
        np.linspace([-1.9, 2.0], [-1.0, 2.9], 8)])
    rows = [(i, [float(x) for x in p], [float(x) for x in p]) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "id long, v array<double>, p array<double>")
    found = {r.id: r.cluster for r in dbscan(frame, 0.5, least, 2).collect()}
    assert [found[i] for i in range(len(points))] == brute_dbscan(points, 0.5, least)


def test_dbscan_of_a_full_cell_compares_few(spark, monkeypatch):
    """100,000 points within one cell, and some around: nothing is compared inside the cell."""
    seen, cut = [], db.cut_lineage
    monkeypatch.setattr(db, "cut_lineage", lambda df: (seen.append(kept := cut(df)), kept)[1])
    pile = spark.range(100_000).select("id", F.array(0.05 + F.rand(3) / 10, 0.05 + F.rand(4) / 10).alias("v"))
    ring = spark.createDataFrame([(200_000 + i, [0.1 + x, 0.1 + y]) for i, (x, y) in enumerate(
        [(0.3, 0.0), (0.0, 0.45), (0.9, 0.0), (5.0, 5.0)])], "id long, v array<double>")
    frame = pile.unionByName(ring).withColumn("p", F.col("v"))
    found = dbscan(frame, 0.5, 4, 2).groupBy("cluster").count().collect()
    assert sorted(map(tuple, found)) == [(-1, 2), (0, 100_002)]
    assert max(df.count() for df in seen) <= 100_010


def test_rank_of_one_group_in_even_ranges(spark, monkeypatch):
    """One constant group, ten million ids apart: no range holds more than its share."""
    seen, cut = [], rk.cut_lineage
    monkeypatch.setattr(rk, "cut_lineage", lambda df: (seen.append(kept := cut(df)), kept)[1])
    frame = spark.range(40_000).select(F.lit(0).alias("g"), (F.col("id") * 10_000_019).alias("id"), (F.col("id") % 3).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would become one range
    found = {r.id: r["rank"] for r in bucketed_rank(frame.repartition(7), ["g"], "id", ["n"]).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    order = sorted(found, key=lambda i: (-(i // 10_000_019 % 3), i))
    assert [found[i] for i in order] == list(range(1, 40_001))
    most, ranges = seen[0].groupBy("_range").count().agg(F.max("count"), F.count("*")).first()
    assert ranges >= 4 and most <= 2 * 40_000 / ranges


@pytest.mark.parametrize("shape", ["even", "heavy", "two"])
def test_quantile_of_ten_million_sorts_few(spark, monkeypatch, shape):
    value = {"even": F.rand(5), "heavy": F.when(F.rand(5) < 0.7, 0.25).otherwise(F.rand(6)),
             "two": F.when(F.col("id") % 5 == 0, 1.0).otherwise(0.0)}[shape]
    frame = spark.range(0, 10_000_000, 1, 8).select(value.alias("x")).persist()
    sizes, real = [], type(frame).groupBy
    monkeypatch.setattr(type(frame), "groupBy", lambda self, *c: (c and sizes.append(self.count()), real(self, *c))[1])
    found = exact_quantile(frame, "x", 0.8).first()[0]
    monkeypatch.undo()
    data = np.sort(frame.toPandas().x.to_numpy())
    frame.unpersist()
    assert math.isclose(found, float(np.percentile(data, 80)), abs_tol=1e-12)
    assert all(s <= qu.SORTED_ROWS for s in sizes)


def test_kmeans_of_many_starts(spark):
    """No dearer than separate fits of the library, in fewer passes; the labels are those of the nearest centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(3)
    middles = rng.normal(0, 6, (6, 4))
    rows = [(i, (middles[i % 6] + rng.normal(0, 1, 4)).tolist()) for i in range(900)]
    points = spark.createDataFrame(rows, "id long, v array<double>").repartition(5, "id").cache()
    vectors = points.withColumn("features", array_to_vector("v"))
    separate = [KMeans(k=6, seed=42 + i, maxIter=50).fit(vectors).summary for i in range(4)]
    together = starts.fit(points, 6, 4)
    assert min(together.costs) <= min(s.trainingCost for s in separate) * 1.001
    assert together.passes < sum(s.numIter for s in separate) + 4 * 7
    x = np.array([v for _, v in rows])
    near = ((x[:, None, :] - together.best[None]) ** 2).sum(axis=2)
    found = dict(map(tuple, starts.assign(points, together.best).collect()))
    assert [found[i] for i in range(900)] == near.argmin(axis=1).tolist()
    assert abs(near.min(axis=1).sum() - min(together.costs)) < 1e-6


def test_kmeans_of_few_points(spark):
    """Fewer different points than clusters, repeated points, one point, none."""
    same = [(i, [1.0, 2.0]) for i in range(5)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    assert {r.cluster for r in cl.kmeans(frame(same), 3, restarts=2).collect()} == {0}
    assert {r.id: r.cluster for r in cl.kmeans(frame(same + [(9, [5.0, 5.0])]), 3, restarts=2).collect()} == {**dict.fromkeys(range(5), 0), 9: 1}
    assert cl.kmeans(frame([(3, [0.0, 0.0])]), 2).collect()[0].cluster == 0
    assert cl.kmeans(frame([]), 2).count() == 0


def _scored(spark):
    rng, rows = random.Random(4), []
    for i in range(1200):
        good = rng.random() < 0.5
        word = rng.choice(["fine", "lovely"] if good else ["dull", "grim"])
        turned = rng.random() < 0.2
        said = ("nay " if turned else "") + word
        near = {"fine": "sunlit", "grim": "murky"}.get(word, "plain")
        text = " ".join(rng.choice(["table", "chair", "lamp", "door"]) for _ in range(4)) + f" {said} {near}"
        rows.append((i, text, (1.0 if good else -1.0) * (-1 if turned else 1)))
    rows += [(2000, None, 1.0), (2001, "", -1.0), (2002, "fine", None), (2003, "fine grim", 0.0)] + rows[:3]
    return spark.createDataFrame(rows, "post_id long, text string, sentiment_score double"), rows


def test_log_odds_and_spread_by_brute_force(spark):
    frame, rows = _scored(spark)
    pos, neg, pairs = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, score in rows:
        words = (text or "").split()
        for w in set(words):
            if score:
                (pos if score > 0 else neg)[w] += 1
        for a, b in zip(words, words[1:]):
            if a != b:
                pairs[a, b] += 1
                pairs[b, a] += 1
    p, n = sum(pos.values()), sum(neg.values())
    found = {r.word: r for r in ind.log_odds(frame).collect()}
    assert set(found) == set(pos) | set(neg)
    for w, r in found.items():
        a = ind.PRIOR * (pos[w] + neg[w]) / (p + n)
        odds = math.log((pos[w] + a) / (p + ind.PRIOR)) - math.log((neg[w] + a) / (n + ind.PRIOR))
        assert (r.pos, r.neg) == (pos[w], neg[w]) and abs(r.log_odds - odds) < 1e-9
        assert abs(r.z - odds / math.sqrt(1 / (pos[w] + a) + 1 / (neg[w] + a))) < 1e-9
    seeds = {"fine": 0.8, "grim": -0.6}
    held = dict(seeds)
    for _ in range(2):
        held = {**{w: sum(held.get(o, 0.0) * c for (v, o), c in pairs.items() if v == w and c > 1)
                   / sum(c for (v, o), c in pairs.items() if v == w and c > 1)
                   for w in {v for (v, _), c in pairs.items() if c > 1}}, **seeds}
    spread = dict(map(tuple, ind.spread(
        spark.createDataFrame(list(seeds.items()), "word string, polarity double"), ind.neighbours(frame)).collect()))
    assert all(abs(spread.get(w, 0.0) - x) < 1e-9 for w, x in held.items()) and set(spread) <= set(held)


def test_induced_lexicon(spark):
    """Polar words, their companions and the negation are found; held-out posts are told apart; nothing comes of nothing."""
    frame, _ = _scored(spark)
    rows = {r.word: r for r in ind.lexicon(frame).collect()}
    assert all(rows[w].polarity > 0.2 for w in ("fine", "lovely")) and all(rows[w].polarity < -0.2 for w in ("dull", "grim"))
    assert rows["sunlit"].polarity > 0.05 and rows["murky"].polarity < -0.05
    assert rows["nay"].is_negation and [w for w, r in rows.items() if r.is_negation] == ["nay"]
    # A negation turns the next word alone, so a turned word with a polar companion is left out.
    text = {r.post_id: r.text for r in frame.collect()}
    out = [r for r in ind.held_out(frame.filter("text is not null and text <> ''")).collect()
           if not ("nay" in text[r.post_id] and text[r.post_id].endswith(("sunlit", "murky")))]
    assert len(out) > 200 and sum((r.score > 0) == (r.said > 0) for r in out) >= 0.95 * len(out)
    assert ind.lexicon(frame.filter("sentiment_score is null")).count() == 0 and ind.lexicon(frame.limit(0)).count() == 0


def test_pairs_in_cells_are_those_of_brute_force(spark):
    rng = np.random.default_rng(7)
    vectors = rng.random((60, 8)) * (rng.random((60, 8)) < 0.6)
    vectors[np.arange(60), np.arange(60) % 8] += 0.1
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = [(doc, f"t{i}", float(x)) for doc, v in enumerate(vectors) for i, x in enumerate(v) if x]
    weights = spark.createDataFrame(rows, "doc long, term string, w double")
    cells = sm.in_cells(weights, 8, 0.6, cell_rows=17).collect()
    cosine = vectors @ vectors.T
    expected = {(a, b): round(cosine[a, b], 9) for a in range(60) for b in range(a + 1, 60) if cosine[a, b] > 0.6}
    assert len(cells) == len(expected) and {(r.a, r.b): round(r.weight, 9) for r in cells} == expected


def _cells_only(monkeypatch, cell_rows=15):
    """All vectors with terms that are few go to the cells, in several blocks."""
    for name, value in (("PLAIN_ROWS", -1), ("JOINED", 10**9), ("CELL_ROWS", cell_rows), ("RUN", 100)):
        monkeypatch.setattr(sm, name, value)


@pytest.mark.parametrize("named", [lambda d: d, lambda d: f"d{d}"], ids=["numbers", "names"])
def test_links_from_cells_are_not_stored(spark, monkeypatch, named):
    """Tables hold no more rows than there are documents or terms, and a link takes what is known of its ends along."""
    _cells_only(monkeypatch)
    sizes, real = {}, sm.stored

    def spy(df, name):
        table = real(df, name)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(sm, "stored", spy)
    vectors, rows = _unit_rows(np.random.default_rng(4), 60, 40)
    kind = "long" if named(0) == 0 else "string"
    network = sm.similar(spark.createDataFrame([(named(d), t, w) for d, t, w in rows], f"doc {kind}, term string, w double"), 0.6)
    names = [named(d) for d in range(100)]
    cls = {named(d): min(named(i) for i, v in enumerate(vectors) if np.allclose(v, vectors[d], atol=1e-12)) for d in range(100)}
    assert dict(network.members.collect()) == cls
    linked = {named(d): int(sum(vectors[d] @ v > 0.6 for v in vectors)) - 1 for d in range(100)}
    assert dict(network.degrees().collect()) == linked
    of = dict(zip(names, vectors))
    first = sorted(set(cls.values()))
    expected = {(a, b): of[a] @ of[b] for a in first for b in first if a < b and of[a] @ of[b] > 0.6}
    expected |= {(cls[d], d): 1.0 for d in names if cls[d] != d}
    colour = {d: len(d) if kind == "string" else d % 7 for d in names}
    nodes = spark.createDataFrame([(d, colour[d], linked[d]) for d in names], f"doc {kind}, colour long, links long")
    links = network.links(nodes, a=("colour", "links"), b=("colour",))
    found = [(r.a, r.b, r.colour_a, r.links_a, r.colour_b) for r in links.collect()]
    assert sorted(found) == sorted((a, b, colour[a], linked[a], colour[b]) for a, b in expected)
    plain = {(r.a, r.b): r.weight for r in network.links().collect()}
    assert plain.keys() == expected.keys() and all(math.isclose(plain[p], expected[p], abs_tol=1e-12) for p in plain)
    assert len(expected) > 300 and max(sizes.values()) <= 100
    # Past the products neither end is joined with or sent anywhere.
    plan = network.cells.pairs(nodes, ("colour",), ("colour",))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan.split("MapInArrow")[0] for word in ("Join", "Exchange"))


def test_links_by_joins_take_the_ends_along(spark):
    vectors, rows = _unit_rows(np.random.default_rng(5), 20, 10)
    network = sm.similar(spark.createDataFrame(rows, "doc long, term string, w double"), 0.6)
    nodes = spark.range(30).select(F.col("id").alias("doc"), (F.col("id") % 7).alias("colour")).filter("doc <> 3")
    found = {(r.a, r.b): (r.colour_a, r.colour_b) for r in network.links(nodes, a=("colour",), b=("colour",)).collect()}
    assert network.cells is None and found == {
        (r.a, r.b): (r.a % 7, r.b % 7) for r in network.links().collect() if 3 not in (r.a, r.b)}


def test_a_vector_is_copied_to_few_blocks(spark):
    """The copies of a vector stay few as vectors grow, until a block would hold too much."""
    single = spark.createDataFrame([(1, 1, [(0, 1.0)])], "doc long, n long, v array<struct<term: short, w: double>>")
    blocks = {n: sm.Cells.of(single, n, 100, 0.3).blocks for n in (0, 1, 2000, 90_000, 4_000_000)}
    assert blocks[0] == blocks[1] == blocks[2000] == 1
    assert blocks[90_000] <= 8 and blocks[4_000_000] == 100
    rows = spark.range(50).select(F.col("id").alias("doc"), F.lit(1.0).alias("n"))
    dealt = sm.Cells(rows, 50, 1, 0.3, 5)._dealt(rows)
    meet = [(r.i, r.j, r.side) for r in dealt.collect()]
    tasks = {(r.task, r.i, r.j) for r in dealt.withColumn("task", F.spark_partition_id()).collect()}
    assert len(tasks) == 15 == len({t for t, _, _ in tasks})
    assert len(meet) == 250 and set(meet) == {(i, j, s) for i in range(5) for j in range(i, 5) for s in (0, 1) if i < j or not s}


def test_joined_rows_are_those_of_the_posted_terms(spark):
    _, rows = _unit_rows(np.random.default_rng(6), 50, 10)
    weights = spark.createDataFrame(rows, "doc long, term string, w double")
    for threshold in (0.3, 0.6, 0.95):
        _, single = sm.vector_classes(sm.numbered(weights, weights.select("term").distinct()))
        posted = sm.posted(single.select("doc", F.inline("v")), threshold)
        counts = [r["count"] for r in posted.groupBy("term").count().collect()]
        assert math.isclose(sm._joined_rows(single, threshold), sum(n * n / 2 for n in counts))
    assert sm._joined_rows(single.limit(0), 0.3) == 0


def test_signs_of_zero_make_no_classes(spark):
    rows = [(1, "a", 1.0), (1, "b", 0.0), (2, "a", 1.0), (2, "b", -0.0), (3, "a", 1.0), (4, "a", 1.0 + 1e-12)]
    members, single = sm.vector_classes(spark.createDataFrame(rows, "doc long, term string, w double"))
    assert dict(members.collect()) == {1: 1, 2: 1, 3: 3, 4: 3} and {(r.doc, r.n) for r in single.collect()} == {(1, 2), (3, 2)}


def test_cosines_are_rounded_as_others(spark):
    rng = np.random.default_rng(8)
    values = [0.3000005, 0.1234565, 0.9999995, 1.0, 0.30000049999999996, 0.5, 1 + 2e-16, *rng.random(2000), *(rng.integers(300000, 10**6, 2000) + 0.5) / 1e6]
    frame = spark.createDataFrame([(float(x),) for x in values], "x double")
    assert frame.filter(learned._r6_cosine(F.col("x")) != registry.r6("x", "x")).count() == 0
