"""Conversations as a trie of shared beginnings, and totals over its subtrees by centroid decomposition.

*Trie.* A node is a distinct sequence of first turns. It is named by 128 bits: the XOR of one hash per turn and place,
so that the names along a conversation are a running XOR, found in ranges of turns, and a node's parent is its name
without its last turn.

*Rollup.* The nodes with their parent edges form a forest. Its parts are split, all large parts at once, at their
centroids: the weight of a node is the number of turns of all conversations below it, known from a plain sum, and the
nodes with at least half of their part's weight are one path from the part's top down; its last node is the centroid.
Below the centroid every child begins a part of its own; what stays has at most half of the weight. The sum of the
values from the centroid down, a plain sum over the nodes cut off, is added to every node of the path, centroid to top.
Parts of at most PART_NODES nodes are summed from below in one task. A node's total is the sum of what it got.
Rounds grow with the logarithm of the number of turns, also where the forest is one long chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from postflock.llm.common import bound_batches, stored

HEADS = 6
HEAD_OF = 100
TURN_RANGE = 4096
IDS_PER_CHUNK = 16_384
PART_NODES = 4096
BROADCAST_PARTS = 100_000
NOTHING = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, one, two, chars): turns numbered from 1 within their conversation, null turns first, ties by
    role and then by the MD5 of the text; ``one`` and ``two`` name role and text. All turns are sorted by ranges, so
    one conversation may fill many tasks; where it does, each begins behind what the ranges before it hold, at most
    one row per range."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.md5(text.cast("binary")).alias("mark"), F.length(text).alias("chars"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "mark"]
    named = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.monotonically_increasing_id().alias("place"),
        F.xxhash64("role", "mark", F.lit(1)).alias("one"), F.xxhash64(F.lit(2), "mark", "role").alias("two"), "chars")
    rows = stored(named, "trie-turns").withColumn("part", F.shiftright("place", 33))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("conv_id", "part").count().withColumn("carried", F.sum("count").over(before)).filter(
        "carried > 0").select("conv_id", "part", "carried")
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("place"))
    numbered = rows.withColumn("inside", inside).join(F.broadcast(carried), ["conv_id", "part"], "left")
    position = F.col("inside") + F.coalesce("carried", F.lit(0))
    return stored(numbered.select("conv_id", position.alias("position"), "one", "two", "chars"), "trie-positions")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, depth, length, one, two, chars) after each took the
    first h turns of the conversation whose id ends in two zeros, in place of its own first h."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own")).select(
        "conv_id", "own", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % HEAD_OF).alias("base"))
    bases = own.filter(F.col("conv_id") == F.col("base")).select("base", F.col("own").alias("offered"))
    head = F.least("h", F.coalesce("offered", F.lit(0)))
    convs = own.join(bases, "base", "left").select(
        "conv_id", "base", "h", head.alias("head"),
        (head + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    convs = stored(convs, "trie-conversations")
    kept = turns.join(convs, "conv_id").filter(F.col("position") > F.col("h")).select(
        "conv_id", (F.col("position") - F.col("h") + F.col("head")).alias("depth"), "length", "one", "two", "chars")
    offered = turns.filter((F.col("conv_id") % HEAD_OF == 0) & (F.col("position") < HEADS)).withColumnRenamed("conv_id", "base")
    taken = convs.filter("head > 0").join(offered, "base").filter(F.col("position") <= F.col("head")).select(
        "conv_id", F.col("position").alias("depth"), "length", "one", "two", "chars")
    return convs.select("conv_id", "length"), kept.union(taken)


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, length, id, parent, chars): the nodes that each rebuilt conversation runs through, from the
    root, depth 0, whose name is all zeros and whose parent is null."""
    convs, rows = rebuilt(turns)
    hashed = rows.select(
        "conv_id", "depth", "length", "chars", F.floor(F.col("depth") / TURN_RANGE).alias("range"),
        F.xxhash64("depth", "one", "two").alias("one"), F.xxhash64("two", "one", "depth").alias("two"))
    inside = Window.partitionBy("conv_id", "range").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = hashed.filter(F.col("length") >= TURN_RANGE).groupBy("conv_id", "range").agg(
        F.bit_xor("one").alias("x"), F.bit_xor("two").alias("y")).select(
        "conv_id", "range", F.bit_xor("x").over(before).alias("x"), F.bit_xor("y").over(before).alias("y"))
    named = hashed.withColumns({"a": F.bit_xor("one").over(inside), "b": F.bit_xor("two").over(inside)}).join(
        carried, ["conv_id", "range"], "left")
    a = F.col("a").bitwiseXOR(F.coalesce("x", F.lit(0)))
    b = F.col("b").bitwiseXOR(F.coalesce("y", F.lit(0)))
    nodes = named.select(
        "conv_id", "depth", "length", F.struct(a.alias("a"), b.alias("b")).alias("id"),
        F.struct(a.bitwiseXOR(F.col("one")).alias("a"), b.bitwiseXOR(F.col("two")).alias("b")).alias("parent"), "chars")
    root = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", root.alias("id"),
                         F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), F.lit(0).alias("chars"))
    return stored(roots.union(nodes.select(roots.columns)), "trie-paths")


def trie(conversations_paths: DataFrame) -> DataFrame:
    """(id, depth, parent, line, parent_line, n_convs, n_children, chars, weight): the nodes. ``line`` is the least
    conversation through a node; ``weight`` the number of turns of all its conversations from it on, its own included."""
    nodes = stored(conversations_paths.groupBy("id", "depth").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("line"), F.count("*").alias("n_convs"),
        F.max("chars").alias("chars"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight")), "trie-nodes")
    children = nodes.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("id").alias("parent"), F.col("line").alias("parent_line"))
    found = nodes.join(children, "id", "left").join(parents, "parent", "left")
    return stored(found.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-linked")


def _from_below(values: int):
    """Sums over subtrees within parts that come one after the other, deepest nodes first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, below = None, {}
        for rows in batches:
            columns = [rows[c].to_list() for c in rows.columns]
            out = []
            for p, q, a, b, up_a, up_b, *own in zip(*columns):
                if (p, q) != part:
                    part, below = (p, q), {}
                if (kept := below.pop((a, b), None)) is not None:
                    own = [x + y for x, y in zip(own, kept)]
                up = below.setdefault((up_a, up_b), [0] * values)
                for i, x in enumerate(own):
                    up[i] += x
                out.append((a, b, *own))
            yield pd.DataFrame(out, columns=["a", "b", *(f"v{i}" for i in range(values))])
    return run


def _sums(values: list[str]) -> list[Column]:
    return [F.sum(v).alias(v) for v in values]


def rollup(nodes: DataFrame, lines: DataFrame, values: list[str], part_nodes: int = PART_NODES) -> DataFrame:
    """(id, values...): for every node the sums of the whole-number ``values`` over its subtree.

    ``nodes(id, parent, depth, line, weight, values...)`` is a forest whose ids are structs of two longs; the root has a
    null parent. ``lines(line, depth, id, parent)`` must hold, for every line that a node names, the nodes from the root
    down to that node. ``weight`` must exceed the sum of the children's weights. An empty forest gives no rows."""
    state = nodes.select("id", "parent", "depth", "line", "weight", *values).withColumn(
        "part", F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    small, added = [], []
    steps = lines.select("line", F.col("depth").alias("_at"), F.col("id").alias("_step"), F.col("parent").alias("_above"))
    while True:
        large = stored(state.groupBy("part").agg(F.count("*").alias("_nodes"), F.max("weight").alias("_whole"))
                       .filter(F.col("_nodes") > part_nodes).drop("_nodes"), "trie-large")
        parts = large.count()
        small.append(state.join(large, "part", "left_anti") if parts else state)
        if not parts:
            break
        hint = F.broadcast if parts <= BROADCAST_PARTS else (lambda df: df)
        open_ = state.join(hint(large), "part").withColumn("_heavy", 2 * F.col("weight") >= F.col("_whole")).drop("_whole")
        centroids = stored(open_.filter("_heavy").groupBy("part").agg(F.min(F.struct("weight", "depth", "id")).alias("c"))
                           .select("part", F.col("c.id").alias("_c"), F.col("c.depth").alias("_c_depth"),
                                   F.col("c.weight").alias("_c_weight")), "trie-centroids")
        open_ = open_.join(hint(centroids), "part").withColumn("_at", F.col("_c_depth") + 1)
        asks = ~F.col("_heavy") & (F.col("depth") >= F.col("_at"))
        asked = open_.filter(asks).join(steps, ["line", "_at"])
        settled = open_.filter(~asks).withColumns({
            "_step": F.lit(None).cast("struct<a:bigint,b:bigint>"), "_above": F.lit(None).cast("struct<a:bigint,b:bigint>")})
        cut = stored(asked.unionByName(settled).withColumn("_under", F.coalesce(F.col("_above") == F.col("_c"), F.lit(False))),
                     "trie-round")
        amounts = cut.filter(F.col("_under") | (F.col("id") == F.col("_c"))).groupBy("part").agg(*_sums(values))
        added.append(cut.filter("_heavy").select("id", "part").join(amounts, "part").select("id", *values))
        state = cut.filter(F.col("id") != F.col("_c")).select(
            "id", "parent", "depth", "line",
            F.when(F.col("_heavy"), F.col("weight") - F.col("_c_weight")).otherwise(F.col("weight")).alias("weight"),
            *values, F.when(F.col("_under"), F.col("_step")).otherwise(F.col("part")).alias("part"))
    bound_batches(nodes.sparkSession)
    rest = reduce(DataFrame.unionByName, small)
    order = [F.col("part"), F.col("depth").desc()]
    flat = rest.repartition("part").sortWithinPartitions(*order).select(
        F.col("part.a").alias("p"), F.col("part.b").alias("q"), F.col("id.a").alias("a"), F.col("id.b").alias("b"),
        F.coalesce("parent.a", F.lit(0)).alias("up_a"), F.coalesce("parent.b", F.lit(-1)).alias("up_b"), *values)
    kinds = ", ".join(["a long, b long", *(f"v{i} long" for i in range(len(values)))])
    summed = flat.mapInPandas(_from_below(len(values)), kinds).select(
        F.struct("a", "b").alias("id"), *(F.col(f"v{i}").alias(v) for i, v in enumerate(values)))
    return reduce(DataFrame.unionByName, added, summed).groupBy("id").agg(*_sums(values))


def _hash_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One hash per node, over its chunks as they come, sorted."""
    current, state = None, None
    for rows in batches:
        out = []
        for a, b, ids in zip(rows.a.to_list(), rows.b.to_list(), rows.ids):
            if (a, b) != current:
                if state is not None:
                    out.append((*current, state.hexdigest()))
                current, state = (a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["a", "b", "ends_sha256"])
    if state is not None:
        yield pd.DataFrame([(*current, state.hexdigest())], columns=["a", "b", "ends_sha256"])


def ends(conversations_paths: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the nodes at which conversations end. Ids travel in chunks of at most IDS_PER_CHUNK."""
    last = conversations_paths.filter(F.col("depth") == F.col("length")).select(
        "id", F.floor(F.col("conv_id") / IDS_PER_CHUNK).alias("chunk"), "conv_id")
    chunks = last.groupBy("id", "chunk").agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    rows = chunks.repartition("id").sortWithinPartitions("id", "chunk").select("id.a", "id.b", "ids")
    return rows.mapInPandas(_hash_chunks, "a long, b long, ends_sha256 string").select(
        F.struct("a", "b").alias("id"), "ends_sha256")


def nodes_report(conversations: DataFrame, part_nodes: int = PART_NODES) -> DataFrame:
    """One row per node of the rebuilt conversations: conv_id (its least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves and saved_tokens (over its subtree), ends_sha256.

    Rows without a conv_id belong to no conversation; a null role or text is empty; null turns come first, ties go by
    role and then by the MD5 of the text, and repeated rows are turns of their own; empty and very long texts are turns
    like any other; other columns are not read; an empty table has no conversation and so gives no rows, not even the
    root."""
    run = paths(ordered_turns(conversations))
    nodes = trie(run)
    valued = nodes.withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    lines = stored(run.join(nodes.select(F.col("line").alias("conv_id")).distinct(), "conv_id", "left_semi").select(
        F.col("conv_id").alias("line"), "depth", "id", "parent"), "trie-lines")
    totals = rollup(valued, lines, ["n_leaves", "saved_tokens"], part_nodes)
    return nodes.join(totals, "id").join(ends(run), "id", "left").select(
        F.col("line").alias("conv_id"), "depth", F.col("parent_line").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


#: The nodes by grouping whole beginnings, with every node added to all its ancestors, in DuckDB's SQL.
SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS position
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, count(*) AS own, conv_id - conv_id % {HEAD_OF} AS base,
    xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % {HEADS} AS h
  FROM turns GROUP BY conv_id),
convs AS (
  SELECT o.conv_id, o.base, o.h, least(o.h, coalesce(b.own, 0)) AS head,
    least(o.h, coalesce(b.own, 0)) + greatest(o.own - o.h, 0) AS length
  FROM own o LEFT JOIN own b ON b.conv_id = o.base),
rebuilt AS (
  SELECT c.conv_id, c.length, position - h + head AS depth, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND position > h
  UNION ALL SELECT c.conv_id, c.length, position, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND position <= head),
paths AS MATERIALIZED (
  SELECT conv_id, 0 AS depth, length, '' AS id, 0 AS chars FROM convs
  UNION ALL SELECT conv_id, depth, length, md5(string_agg(length(role) || ':' || role || md5(text), '/') OVER (
    PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)), length(text) FROM rebuilt),
steps AS (
  SELECT a.*, b.id AS parent FROM paths a LEFT JOIN paths b ON a.conv_id = b.conv_id AND a.depth = b.depth + 1),
grouped AS (
  SELECT id, depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length) AS ends FROM steps GROUP BY id, depth),
nodes AS MATERIALIZED (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM grouped c WHERE c.parent = n.id AND c.depth = n.depth + 1) AS n_children
  FROM grouped n LEFT JOIN grouped p ON n.parent = p.id AND n.depth = p.depth + 1),
totals AS (
  SELECT a.id, a.depth, sum((n.n_children = 0)::BIGINT) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM nodes n JOIN paths a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.id, a.depth)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes JOIN totals USING (id, depth)"""
