"""Sums over shared keys of everyone with everyone, as matrix products of blocks.

Where most people share popular keys, a join makes one row per pair and shared key. Here both sides are packed into one
row per person and dealt into blocks by id; each pair of blocks is a cell, worked on alone. In a cell the popular keys are
columns of two matrices whose product is made tile by tile; the other keys' lists are added to the tile. A cell keeps the
``k`` best of each person, so what leaves it grows with people, not with pairs.

The work is still quadratic in people. Memory is bounded by a block and a tile, shuffles by BLOCKS copies of either side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from postflock.operators.ranking import dense_ids, top_k
from postflock.session import cut_lineage

#: A side is cut into at most BLOCKS blocks, of at least BLOCK_ROWS rows, unless a block would hold more than BLOCK_KEYS keys.
BLOCKS = 10
BLOCK_ROWS = 512
BLOCK_KEYS = 8_000_000
#: Numbers in a tile, in the matrix of popular keys, and matches of other keys added at once.
TILE = 8_000_000
DENSE = 32_000_000
PIECE = 2_000_000
#: One match of two list entries costs about so many multiplications.
MATCH = 64
#: Columns looked at first and at most at once.
FIRST, STEP = 256, 4096
#: Whole numbers below this are exact in single precision.
SINGLE = 2**24


def _dealt(rows: int, keys: int) -> int:
    return max(1, min(BLOCKS, -(-rows // BLOCK_ROWS)), -(-keys // BLOCK_KEYS))


def _block(who: str, blocks: int):
    return F.pmod(F.xxhash64(who), F.lit(blocks)).cast("int")


def _sizes(side: DataFrame) -> tuple[int, int]:
    found = side.agg(F.count(F.lit(1)), F.sum(F.size("_keys"))).first()
    return int(found[0]), int(found[1] or 0)


def nearest(
    wants: DataFrame, postings: DataFrame, k: int, exclude: DataFrame | None, skip_self: bool, head: int, index: bool = False
) -> DataFrame:
    """(me, item, score, rank): the ``k`` items with the largest sum of ``v`` over the wanted keys, or with ``index`` the
    largest Jaccard index, where both sides are sets. Sums are exact below 2^53; ids are not null. Keys of at most
    ``head`` items are never columns."""
    if index:
        postings = postings.withColumn("v", F.lit(1))
    ids = dense_ids(postings, "key", "_key").withColumn("_key", F.col("_key").cast("int"))
    whole = postings.groupBy("item").agg(F.sum("v").alias("_v")).agg(F.max("_v")).first()[0] or 0
    number = "float" if whole < SINGLE else "double"
    entry = F.struct("_key", F.col("v").cast(number).alias("_v"))
    right = postings.filter(F.col("item").isNotNull()).join(ids, "key").groupBy("item").agg(F.collect_list(entry).alias("_e"))
    right = cut_lineage(right.select("item", F.col("_e._key").alias("_keys"), F.col("_e._v").alias("_vals")))
    left = wants.filter(F.col("me").isNotNull()).join(ids, "key").groupBy("me").agg(F.collect_list("_key").alias("_keys"))
    left = cut_lineage(left)
    rows, columns = _dealt(*_sizes(left)), _dealt(*_sizes(right))
    if exclude is None:
        left = left.withColumn("_out", F.array().cast(f"array<{dict(postings.dtypes)['item']}>"))
    else:
        at = F.struct(_block("item", columns).alias("at"), "item")
        left = left.join(exclude.groupBy("me").agg(F.collect_list(at).alias("_out")), "me", "left")
    left = left.withColumn("_i", _block("me", rows)).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    if exclude is not None:
        left = left.withColumn("_out", F.filter("_out", lambda e: e["at"] == F.col("_j"))["item"])
    right = right.withColumn("_j", _block("item", columns)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    cells = ["_i", "_j"]
    types = dict(wants.dtypes) | dict(postings.dtypes)
    best = left.repartition(2 * rows * columns, *cells).groupBy(*cells).cogroup(
        right.repartition(2 * rows * columns, *cells).groupBy(*cells)
    ).applyInPandas(_best_of(k, skip_self, head, index), f"me {types['me']}, item {types['item']}, score double")
    if not index:
        best = best.withColumn("score", F.col("score").cast("long"))
    return top_k(best, ["me"], [F.desc("score"), F.col("item")], k)


def _best_of(k: int, skip_self: bool, head: int, index: bool) -> Callable:
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"me": left["me"][:0], "item": right["item"][:0], "score": np.zeros(0)})]
        if len(left) and len(right):
            right = right.sort_values("item", ignore_index=True)
            me, item = left["me"].to_numpy(), right["item"].to_numpy()
            ours, theirs = left["_keys"].map(len).to_numpy(), right["_keys"].map(len).to_numpy()
            closed = _closed(left, item, skip_self)
            for first, tile in _tiles(left["_keys"], right["_keys"], right["_vals"], head):
                last = first + len(tile)
                rows, columns = closed
                inside = (rows >= first) & (rows < last)
                tile[rows[inside] - first, columns[inside]] = 0
                row, column, score = _leading(tile, k, ours[first:last] if index else None, theirs)
                parts.append(pd.DataFrame({"me": me[row + first], "item": item[column], "score": score}))
        return pd.concat(parts[1:] or parts, ignore_index=True)

    return best


def _closed(left: pd.DataFrame, item: np.ndarray, skip_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the pairs that are left out."""
    outs = [np.asarray(o if o is not None else [], dtype=item.dtype) for o in left["_out"]]
    rows = np.repeat(np.arange(len(left)), [len(o) for o in outs])
    names = np.concatenate(outs)
    if skip_self:
        rows = np.concatenate([rows, np.arange(len(left))])
        names = np.concatenate([names, left["me"].to_numpy().astype(item.dtype)])
    columns = np.minimum(np.searchsorted(item, names), len(item) - 1)
    known = item[columns] == names
    return rows[known], columns[known]


def _tiles(left_keys: pd.Series, right_keys: pd.Series, right_vals: pd.Series, head: int):
    """(first row, sums of a run of rows with all columns), run by run."""
    n, m = len(left_keys), len(right_keys)
    lens = left_keys.map(len).to_numpy()
    row, lkey = np.repeat(np.arange(n), lens), np.concatenate(left_keys.to_numpy())
    column, rkey = np.repeat(np.arange(m), right_keys.map(len).to_numpy()), np.concatenate(right_keys.to_numpy())
    value = np.concatenate(right_vals.to_numpy())
    keys, rkey = np.unique(rkey, return_inverse=True)
    at = np.minimum(np.searchsorted(keys, lkey), len(keys) - 1)
    row, lkey = row[known := keys[at] == lkey], at[known]

    a, b = np.bincount(lkey, minlength=len(keys)), np.bincount(rkey, minlength=len(keys))
    gain = a * b.astype(float) * MATCH - float(n) * m
    popular = np.flatnonzero((b > head) & (gain > 0))
    popular = popular[np.argsort(-gain[popular], kind="stable")[: DENSE // max(n, m)]]
    place = np.full(len(keys), -1)
    place[popular] = np.arange(len(popular))
    there = place[rkey] >= 0
    matrix = np.zeros((len(popular), m), value.dtype)
    matrix[place[rkey[there]], column[there]] = value[there]

    by_key = np.flatnonzero(~there)[np.argsort(rkey[~there], kind="stable")]
    listed, worth = column[by_key], value[by_key]
    length = np.where(place >= 0, 0, b)
    start = np.cumsum(length) - length
    run = max(1, TILE // m)
    ends = np.searchsorted(row, np.arange(0, n + run, run))
    for turn, first in enumerate(range(0, n, run)):
        mine = slice(ends[turn], ends[turn + 1])
        r, key = row[mine] - first, lkey[mine]
        height = min(run, n - first)
        wanted = np.zeros((height, len(popular)), value.dtype)
        dense = place[key] >= 0
        wanted[r[dense], place[key[dense]]] = 1
        tile = wanted @ matrix
        r, key = r[~dense], key[~dense]
        reps = length[key]
        piece = np.cumsum(reps) // PIECE
        for number in np.unique(piece):
            some = piece == number
            times = reps[some]
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            where = np.repeat(start[key[some]], times) + inner
            np.add.at(tile, (np.repeat(r[some], times), listed[where]), worth[where])
        yield first, tile


def _leading(tile: np.ndarray, k: int, ours: np.ndarray | None, theirs: np.ndarray):
    """(row, column, score) of the ``k`` largest above 0 of every row, ties to the lesser column: columns are read in
    order, and a later one counts only if it is larger than the k-th so far."""
    height, width = tile.shape
    floor = np.zeros(height)
    row, column, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    first, step = 0, FIRST
    while first < width:
        part = tile[:, first : first + step]
        if ours is not None:
            part = part.astype(float)
            part /= ours[:, None] + theirs[None, first : first + step] - part
            found = part > floor[:, None]
        else:
            found = part > floor[:, None].astype(part.dtype)
        r, c = np.nonzero(found)
        if len(r):
            row, column = np.concatenate([row, r]), np.concatenate([column, c + first])
            score = np.concatenate([score, part[r, c].astype(float)])
            order = np.lexsort((column, -score, row))
            row, column, score = row[order], column[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, column, score, place = (x[place < k] for x in (row, column, score, place))
            floor[row[place == k - 1]] = score[place == k - 1]
        first, step = first + step, min(2 * step, STEP)
    return row, column, score
