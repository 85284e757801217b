"""Approximate nearest neighbours by inner product: one navigable small-world graph per shard.

Vectors are lifted by one coordinate to equal length, ``sqrt(longest**2 - length**2)``; their inner products
then order like distances on a sphere, and a query's (lifted by 0) are its inner products with the vectors
themselves. Each shard holds a bounded number of different vectors. Its graph has layers; each is one flat
array of neighbour numbers, ``width`` per node, -1 where there are fewer. Nodes are inserted in batches, and
queries walk the graph in step, so the inner loops are numpy over whole batches.

Equal vectors are one node. Every shard answers every query, and the answers are merged.

Graphs are built and walked in single precision on scaled copies, so that components of any finite size fit; the nodes
found are scored and ordered in double precision on the vectors themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from postflock.llm.common import stored

NEAREST = 20
SHARD_ROWS = 16_384
QUERY_BLOCK = 8_192
DEGREE = 24
BUILD_BEAM = 96
SEARCH_BEAM = 192
STEP = 4
BATCH = 1024
SCORED = 64

INDEX = ("dim int, shard int, ids array<long>, vectors array<double>, entry int, "
         "layers array<struct<nodes array<int>, width int, neighbours array<int>>>")


def _levels(ids: np.ndarray, degree: int) -> np.ndarray:
    """Layer of each node, drawn from its id: a rebuilt shard gets the same graph."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    part = ((h >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)
    return np.floor(-np.log(part) / math.log(degree)).astype(int)


def _scaled(vectors: np.ndarray, largest: np.ndarray | float) -> np.ndarray:
    """Single-precision copies, divided by ``largest``, the largest component they shall be compared by."""
    return (vectors / largest).astype(np.float32)


def beam_search(
    vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities), best first, -1 and -inf behind. ``entries`` has start nodes per query (-1: none);
    ``neighbours`` is the layer as (node, width). All queries take a step together; a step opens each query's
    STEP best nodes that are not opened yet, as long as they are better than the worst of its full beam."""
    count = len(queries)
    rows = np.arange(count)[:, None]
    seen = np.zeros((count, len(vectors) + 1), dtype=bool)
    nodes = np.full((count, beam), -1, dtype=np.int64)
    sims = np.full((count, beam), -np.inf, dtype=np.float32)
    opened = np.ones((count, beam), dtype=bool)

    def offer(active: np.ndarray, new: np.ndarray) -> None:
        who = active[:, None]
        new = np.where(seen[who, new], -1, new)
        ordered = np.sort(new, axis=1)
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        seen[who, ordered] = True
        seen[:, -1] = False
        found = (vectors[ordered] @ queries[active][:, :, None])[:, :, 0]
        found[ordered < 0] = -np.inf
        all_sims = np.concatenate([sims[active], found], axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        sims[active] = np.take_along_axis(all_sims, best, axis=1)
        nodes[active] = np.take_along_axis(np.concatenate([nodes[active], ordered], axis=1), best, axis=1)
        state = np.concatenate([opened[active], ordered < 0], axis=1)
        opened[active] = np.take_along_axis(state, best, axis=1)

    active = np.arange(count)
    offer(active, entries)
    while active.size:
        waiting = ~opened[active] & (nodes[active] >= 0)
        active = active[waiting.any(axis=1)]
        if not active.size:
            break
        waiting = ~opened[active] & (nodes[active] >= 0)
        places = np.argsort(~waiting, axis=1, kind="stable")[:, :STEP]
        valid = np.take_along_axis(waiting, places, axis=1)
        chosen = np.where(valid, nodes[active[:, None], places], -1)
        opened[active[:, None], places] = True
        around = neighbours[chosen]
        around[chosen < 0] = -1
        offer(active, around.reshape(len(active), -1))
    return nodes, sims


def choose(vectors: np.ndarray, candidates: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) at most ``degree``: first those that are nearer to
    the row's node than to any candidate chosen before, then the best of the others."""
    count, many = candidates.shape
    points = vectors[candidates]
    between = points @ points.transpose(0, 2, 1)
    taken = np.zeros((count, many), dtype=bool)
    nearest = np.full((count, many), -np.inf, dtype=np.float32)
    for c in range(many):
        take = (candidates[:, c] >= 0) & (nearest[:, c] < sims[:, c]) & (taken.sum(axis=1) < degree)
        taken[:, c] = take
        nearest = np.where(take[:, None], np.maximum(nearest, between[:, :, c]), nearest)
    order = np.argsort(~taken, axis=1, kind="stable")[:, :degree]
    return np.take_along_axis(candidates, order, axis=1)


class Graph:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> None:
        """Nodes in the order of descending layer, then id. The bottom layer allows twice the degree."""
        levels = _levels(ids, degree)
        order = np.lexsort((ids, -levels))
        self.ids, levels = ids[order], levels[order]
        self.vectors = np.ascontiguousarray(vectors[order], dtype=np.float64)
        walked = _scaled(self.vectors, np.abs(self.vectors).max())
        length = np.einsum("nd,nd->n", walked, walked, dtype=np.float64)
        lift = np.sqrt(np.maximum(length.max() - length, 0)).astype(np.float32)
        scale = np.float32(1 / math.sqrt(length.max()))
        self._lifted = np.column_stack([walked, lift]) * scale
        self._lifted = np.vstack([self._lifted, np.zeros((1, self._lifted.shape[1]), dtype=np.float32)])
        self.entry = 0
        self.layers: list[np.ndarray] = []
        top = int(levels[0]) if len(ids) else 0
        for level in range(top, -1, -1):
            self._fill(int((levels >= level).sum()), degree * (1 if level else 2), degree, beam)

    def _entries(self, queries: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
        """Best node per query after a walk down the given layers."""
        at = np.full((len(queries), 1), self.entry, dtype=np.int64)
        for layer in layers:
            at = beam_search(self._lifted[:len(layer) - 1], layer, queries, at, 4)[0]
        return at

    def _fill(self, size: int, width: int, degree: int, beam: int) -> None:
        """Adds the layer of the first ``size`` nodes. The last row stands for "no node"."""
        near = np.full((size + 1, width), -1, dtype=np.int64)
        done = 0
        while done < size:
            take = min(BATCH, max(64, done), size - done)
            new = np.arange(done, done + take)
            queries = self._lifted[new]
            inside = queries @ queries.T
            np.fill_diagonal(inside, -np.inf)
            keep = min(beam, take)
            best = np.argsort(-inside, axis=1, kind="stable")[:, :keep]
            nodes, sims = new[best], np.take_along_axis(inside, best, axis=1)
            if done:
                above = self._entries(queries, self.layers)
                above = np.where(above < done, above, -1)
                above[(above < 0).all(axis=1), 0] = 0
                old, old_sims = beam_search(self._lifted[:size], near, queries, above, beam)
                nodes, sims = np.concatenate([nodes, old], axis=1), np.concatenate([sims, old_sims], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            nodes, sims = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(sims, order, axis=1)
            nodes[~np.isfinite(sims)] = -1
            near[new, :degree] = self._padded(choose(self._lifted, nodes, sims, degree), degree)
            self._back(near, new, degree, width)
            done += take
        self.layers.append(near)

    @staticmethod
    def _padded(rows: np.ndarray, width: int) -> np.ndarray:
        return np.pad(rows, ((0, 0), (0, width - rows.shape[1])), constant_values=-1)

    def _back(self, near: np.ndarray, new: np.ndarray, degree: int, width: int) -> None:
        """Links from the chosen neighbours back to the new nodes; full lists are chosen anew."""
        source = np.repeat(new, degree)
        target = near[new, :degree].ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not target.size:
            return
        sims = np.einsum("nd,nd->n", self._lifted[source], self._lifted[target])
        order = np.lexsort((source, -sims, target))
        source, target = source[order], target[order]
        first = np.concatenate(([True], target[1:] != target[:-1]))
        nodes = target[first]
        group = np.cumsum(first) - 1
        place = np.arange(target.size) - np.flatnonzero(first)[group]
        for low in range(0, nodes.size, BATCH):
            part = nodes[low:low + BATCH]
            mine = (group >= low) & (group < low + part.size) & (place < width)
            incoming = np.full((part.size, width), -1, dtype=np.int64)
            incoming[group[mine] - low, place[mine]] = source[mine]
            both = np.concatenate([near[part], incoming], axis=1)
            ordered = np.sort(both, axis=1)
            ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
            found = (self._lifted[ordered] @ self._lifted[part][:, :, None])[:, :, 0]
            found[ordered < 0] = -np.inf
            best = np.argsort(-found, axis=1, kind="stable")
            ordered, found = np.take_along_axis(ordered, best, axis=1), np.take_along_axis(found, best, axis=1)
            full = (ordered >= 0).sum(axis=1) > width
            near[part[~full]] = ordered[~full, :width]
            if full.any():
                near[part[full]] = self._padded(choose(self._lifted, ordered[full], found[full], width), width)

    def rows(self) -> list[dict]:
        """The layers as flat arrays, the top one first; nodes count from the front of ``ids``."""
        return [{"nodes": np.arange(len(x) - 1, dtype=np.int32), "width": x.shape[1],
                 "neighbours": x[:-1].astype(np.int32).ravel()} for x in self.layers]


def search(
    ids: np.ndarray, vectors: np.ndarray, layers: list[np.ndarray], entry: int, queries: np.ndarray,
    nearest: int, beam: int = SEARCH_BEAM,
) -> tuple[np.ndarray, np.ndarray]:
    """(places in ids, inner products in double precision) of the nearest found per query; -1 behind."""
    walked = _scaled(vectors, np.abs(vectors).max())
    padded = np.vstack([walked, np.zeros((1, walked.shape[1]), dtype=np.float32)])
    found_nodes, found_sims = [], []
    for low in range(0, len(queries), BATCH):
        own = queries[low:low + BATCH]
        part = _scaled(own, np.abs(own).max(axis=1, keepdims=True))
        at = np.full((len(part), 1), entry, dtype=np.int64)
        for n, layer in enumerate(layers):
            last = n == len(layers) - 1
            at = beam_search(padded[:len(layer) - 1], layer, part, at, max(beam, nearest) if last else 8)[0]
        exact = np.concatenate([
            np.einsum("qd,qnd->qn", own[n:n + SCORED], vectors[at[n:n + SCORED]]) for n in range(0, len(own), SCORED)])
        exact[at < 0] = -np.inf
        best = np.lexsort((np.where(at >= 0, ids[at], 0), -exact), axis=1)[:, :nearest]
        found_nodes.append(np.take_along_axis(at, best, axis=1))
        found_sims.append(np.take_along_axis(exact, best, axis=1))
    return np.concatenate(found_nodes), np.concatenate(found_sims)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    graph = Graph(rows.cls.to_numpy(np.int64), np.stack(rows.embedding.to_numpy()).astype(np.float64))
    return pd.DataFrame({
        "dim": [rows.dim.iloc[0]], "shard": [rows.shard.iloc[0]], "ids": [graph.ids],
        "vectors": [graph.vectors.ravel()], "entry": [graph.entry], "layers": [graph.rows()]})


def _answer(nearest: int):
    names = ["query", "cls", "score"]

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if index.empty or queries.empty:
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "cls": pd.Series(dtype="int64"),
                                 "score": pd.Series(dtype="float64")})
        own = index.iloc[0]
        ids = np.asarray(own["ids"])
        layers = []
        for layer in own["layers"]:
            near = np.asarray(layer["neighbours"], dtype=np.int64).reshape(-1, layer["width"])
            layers.append(np.vstack([near, np.full((1, layer["width"]), -1)]))
        vectors = np.asarray(own["vectors"], dtype=np.float64).reshape(len(ids), -1)
        asked = np.stack(queries.embedding.to_numpy()).astype(np.float64)
        at, score = search(ids, vectors, layers, int(own["entry"]), asked, nearest)
        query = np.repeat(queries.cls.to_numpy(np.int64), at.shape[1]).reshape(at.shape)
        good = at >= 0
        return pd.DataFrame({"query": query[good], "cls": ids[at[good]], "score": score[good]}, columns=names)
    return run


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def neighbours(
    vectors: DataFrame, is_query: Column, nearest: int = NEAREST, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row (vec_id, embedding) that ``is_query`` names, the
    ``nearest`` other rows of largest inner product that were found, ties to the smaller id.

    Rows whose vector is null, zero or holds a null or non-finite component, and rows without an id, take no
    part; rows repeated whole count once; an id with two vectors is two rows. Vectors meet only vectors of their own
    length. Components may be of any number type and are read as doubles; a product beyond the doubles is infinite. Of
    equal vectors the ``nearest + 1`` least ids are carried along, which is all that an answer can hold.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asked")).filter(
        F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).distinct()
    equal = Window.partitionBy("embedding").orderBy("vec_id")
    classes = stored(
        rows.select("vec_id", "embedding").distinct()
        .withColumn("_n", F.row_number().over(equal)).filter(F.col("_n") <= nearest + 1)
        .groupBy("embedding").agg(F.min("vec_id").alias("cls"), F.array_sort(F.collect_list("vec_id")).alias("members"))
        .withColumn("dim", F.size("embedding")), "hnsw-classes")
    asked = stored(
        rows.filter("asked").select(F.col("vec_id").alias("query_id"), "embedding")
        .join(classes.select("embedding", "cls"), "embedding").select("query_id", "cls"), "hnsw-queries")
    queries = classes.select("cls", "dim", "embedding").join(asked.select("cls").distinct(), "cls", "left_semi")
    shards = max(1, -(-classes.count() // shard_rows))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    index = stored(
        classes.select("cls", "dim", "embedding", F.pmod(F.xxhash64("cls"), F.lit(shards)).cast("int").alias("shard"))
        .groupBy("dim", "shard").applyInPandas(_build, INDEX), "hnsw-index")

    def numbered(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = index.withColumn("block", numbered(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(blocks)).cast("int")).withColumn(
        "shard", numbered(shards))
    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _answer(nearest + 1), "query long, cls long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    merged = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= nearest + 1)
    by_row = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    single = (
        merged.join(classes.select("cls", "members"), "cls")
        .select("query", "score", F.explode("members").alias("vec_id"))
        .withColumn("_n", F.row_number().over(by_row)).filter(F.col("_n") <= nearest + 1)
        .select(F.col("query").alias("cls"), "score", "vec_id")
    )
    final = Window.partitionBy("query_id", "cls").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(single, "cls").filter(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= nearest)
        .select(F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), "score")
    )
