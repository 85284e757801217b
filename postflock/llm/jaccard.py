"""N-gram Jaccard join: which documents' shingle sets are alike by 0.8 or more, and the groups they form.

Tokens (shingles) are hashed into groups, twice with the same idea.

*Where to look.* Within a size band every set is split into G groups. Sets that link differ in at most a
ninth of their summed sizes, and each differing token spoils one group, so at least ``groups - differing``
groups are equal as a whole. The equal ones are met by a prefix filter over (band, group, content): each set
posts its ``differing + 1`` first groups, in one order for all, the largest groups first. Sets that can link
therefore meet in a bucket; unrelated sets hardly ever do, for a whole group must agree. Sets near the upper
end of a band also post in the next. A text is cut into shingles once for its name and its groups, and only once
more if its set comes up in a bucket.

*What to compare.* Each set is a point, its counts of tokens per coordinate; the sum of two points' minima bounds
their overlap. Buckets are first joined along stars, STAR_TURNS times: each set meets one other, of another
component, that it shares most buckets with, and is verified against it if the bound allows. That connects groups of
copies in as many checks as there are copies. What is left are buckets with sets of several components. There an
R-tree over the points holds boxes whose corners bound the overlap in the same way. Nearly all pairs that survive the bound link, so FOREST_TURNS times each bucket gives out only as many
survivors as it takes to connect its components; then all pairs that still lie in different components and
survive are given out. They are verified on the full sets. A pair that shares many buckets is given out by the
one of least name. No pair that can link is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from postflock.llm.common import bound_batches, stored, texts
from postflock.llm.rolling import SHINGLE_WORDS, mixed, shingles
from postflock.operators.components import components

COORDINATES = 256
FOLD = 4
MOST = (1 << 8) - 1
LEAF = 32
SMALL = 64
GROUPS_PER_SIZE = 0.64
HOT = 256
STAR_TURNS = 2
FOREST_TURNS = 1
NAMES_KEPT = 8
BROADCAST_PAIRS = 500_000
NO_NAME = (1 << 63) - 1
SALTS = 16
SIZE_CAP = 6
FLUSH = 1_500_000


def _link(shared: Column, a: Column, b: Column) -> Column:
    return 100 * shared >= 80 * (a + b - shared)


def least_overlap(a, b):
    """Tokens that sets of these sizes must share to link: 0.8 of the union."""
    return -(-4 * (a + b) // 9)


def set_key(tokens: np.ndarray) -> int:
    """64-bit name of a set: equal sets have equal names. As signed number."""
    if not tokens.size:
        return 0
    total = np.add.reduce(mixed(tokens * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)))
    return int(mixed(np.array([total + np.uint64(tokens.size)], dtype=np.uint64)).view(np.int64)[0])


def counts(tokens: np.ndarray) -> np.ndarray:
    """The point of a set: how many of its tokens fall on each coordinate, MOST at most. Sets of some 50,000 tokens
    come so far; two points with a full coordinate are not bounded but verified."""
    found = np.bincount((tokens % np.uint64(COORDINATES)).astype(np.int64), minlength=COORDINATES)
    return np.minimum(found, MOST).astype(np.uint8)


def _band(size: int) -> int:
    """0 for sets below SMALL, then one band per doubling."""
    return max(0, size.bit_length() - SMALL.bit_length() + 1)


def _band_start(band: int) -> int:
    return SMALL << (band - 1) if band else 1


def _postings_in(tokens: np.ndarray, band: int) -> np.ndarray:
    groups = int(_band_start(band) * GROUPS_PER_SIZE) if band else SMALL
    spoiled = tokens.size // 4
    group = mixed(tokens + np.uint64(0x632BE59BD9B4E019)) % np.uint64(groups)
    order = np.argsort(group, kind="stable")
    group = group[order]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(first, append=group.size)
    content = np.add.reduceat(mixed(tokens[order] * np.uint64(0xA0761D6478BD642F) + np.uint64(7)), first)
    name = mixed(content + group[first] * np.uint64(0xE7037ED1A0B428DB) + np.uint64(band * 1_000_003) + size.astype(np.uint64))
    ranked = np.lexsort((name, -np.minimum(size, SIZE_CAP)))
    kept = name[ranked[:spoiled + 1]]
    if first.size <= spoiled:
        kept = np.append(kept, mixed(np.array([band + 0xFACE], dtype=np.uint64)))
    return kept


def postings(tokens: np.ndarray) -> np.ndarray:
    """Names of the groups under which a set is to be met. A set with too few filled groups for the guarantee
    also posts under one name that all such sets of the band share."""
    if not tokens.size:
        return tokens
    band = _band(tokens.size)
    found = [_postings_in(tokens, band)]
    if 5 * tokens.size >= 4 * _band_start(band + 1):
        found.append(_postings_in(tokens, band + 1))
    return np.concatenate(found)


def _post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(name, salt, key) of the groups of each set; sets that several rows of a task have post once."""
    def flush(names: list[np.ndarray], keys: list[np.ndarray]) -> pd.DataFrame:
        name, key = np.concatenate(names), np.concatenate(keys)
        salt = np.zeros(name.size, dtype=np.int32)
        own, where, many = np.unique(name, return_inverse=True, return_counts=True)
        hot = many[where] > HOT
        rows = pd.DataFrame({"name": name, "key": key, "salt": salt})
        if hot.any():
            rows.loc[hot, "salt"] = 1 + (key[hot].view(np.uint64) % np.uint64(SALTS)).astype(np.int32)
            least = rows[hot].groupby(["name", "salt"], as_index=False)["key"].min().assign(salt=np.int32(0))
            rows = pd.concat([rows, least])
        return rows[["name", "salt", "key"]]

    seen: set[int] = set()
    names: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    held = 0
    for rows in batches:
        for key, own in zip(rows.key.to_list(), rows["names"]):
            if key in seen:
                continue
            seen.add(key)
            names.append(np.frombuffer(own, dtype="<i8"))
            keys.append(np.full(names[-1].size, key, dtype=np.int64))
            held += names[-1].size
        if held >= FLUSH:
            yield flush(names, keys)
            names, keys, held = [], [], 0
    if names:
        yield flush(names, keys)


def _mark(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, mark, key, n_shingles, names) of every row; ``mark`` tells the texts of one id apart, ``names`` are the
    set's groups, packed, at the first row of a batch that has the set."""

    @F.pandas_udf("key long, n_shingles long, names binary")
    def run(batch: pd.Series) -> pd.DataFrame:
        seen: set[int] = set()
        out = []
        for text in batch:
            tokens = shingles(text, words)
            key = set_key(tokens)
            new = tokens.size > 0 and key not in seen
            seen.add(key)
            out.append((key, tokens.size, postings(tokens).view("<i8").tobytes() if new else None))
        return pd.DataFrame(out, columns=["key", "n_shingles", "names"]).astype({"key": "int64", "n_shingles": "int64"})

    return texts(docs).select("doc_id", _mark("text").alias("mark"), run("text").alias("s")).select("doc_id", "mark", "s.*")


def _content(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for rows in batches:
            out = []
            for key, text in zip(rows.key, rows.text):
                tokens = shingles(text, words)
                if key not in seen and set_key(tokens) == key:
                    seen.add(key)
                    out.append((key, tokens.size, counts(tokens).tobytes(), tokens.view(np.int64)))
            yield pd.DataFrame(out, columns=["key", "size", "counts", "tokens"])
    return run


def _contents(docs: DataFrame, members: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """(key, size, counts, tokens) of the wanted keys, each from one row that has it: that of least id and mark. Rows
    that repeat id and text meet in one task, which keeps the first."""
    holders = members.join(keys, "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("_h"))
    rows = texts(docs).withColumn("mark", _mark("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_h.doc_id")) & (F.col("mark") == F.col("_h.mark"))
    found = rows.join(holders, same).select("key", "text")
    return found.mapInPandas(_content(words), "key long, size long, counts binary, tokens array<long>")


def _sides(pairs: DataFrame, contents: DataFrame, *columns: str) -> list[DataFrame]:
    """The contents of both ends of stored ``pairs``. Few pairs are sent to where the contents lie, so that only the
    contents in question move; many are joined."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    contents = contents.join(F.broadcast(keys) if pairs.count() <= BROADCAST_PAIRS else keys, "key", "left_semi")
    return [contents.select(F.col("key").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in columns]) for n in ("a", "b")]


def _may_link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        if rows.empty:
            continue
        one, two = (np.frombuffer(b"".join(rows[c]), dtype=np.uint8).reshape(len(rows), -1) for c in ("counts_a", "counts_b"))
        shared = np.minimum(one, two).sum(axis=1, dtype=np.int64)
        full = (one == MOST).any(axis=1) & (two == MOST).any(axis=1)
        yield rows.loc[full | (shared >= least_overlap(rows.size_a.to_numpy(), rows.size_b.to_numpy())), ["a", "b"]]


def _bounded(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sum of their points' minima does not rule out."""
    one, two = _sides(pairs, contents, "size", "counts")
    return pairs.join(one, "a").join(two, "b").mapInPandas(_may_link, "a long, b long")


def _verified(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    one, two = _sides(pairs, contents, "size", "tokens")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return pairs.join(one, "a").join(two, "b").filter(
        _link(shared, F.col("size_a"), F.col("size_b"))).select("a", "b")


class CountTree:
    """R-tree over count vectors, packed by size and then by the coordinates' pattern: leaves of LEAF points,
    nodes of LEAF leaves. A box keeps the upper corner and the least set size, which bound the overlap that
    any of its points can have with a query and the overlap that it would need. Boxes and points are first
    compared on coordinates folded by FOLD, then the points that are left on all of them."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        folded = self._folded(points)
        self.order = np.lexsort((folded.argmax(axis=1), np.log2(np.maximum(sizes, 1)).astype(int)))
        self.fine, self.points, self.sizes = points[self.order], folded[self.order], sizes[self.order]
        self.levels = []
        high, small = self.points, self.sizes
        while len(high) > 1:
            at = np.arange(0, len(high), LEAF)
            high, small = np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(small, at)
            self.levels.append((high, small))
        self.levels.reverse()

    @staticmethod
    def _folded(points: np.ndarray) -> np.ndarray:
        return points.reshape(len(points), -1, FOLD).sum(axis=2, dtype=np.int32)

    @staticmethod
    def _open(query: np.ndarray, size: int, high: np.ndarray, small: np.ndarray) -> np.ndarray:
        allowed = np.minimum(high, query).sum(axis=1, dtype=np.int64) >= least_overlap(size, small)
        return allowed | (high.max(axis=1) >= MOST) if query.max() >= MOST else allowed

    def search(self, query: np.ndarray, size: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """Places (in the given order of points) of all points that the bound does not rule out, of those that
        are ``wanted``."""
        low = self._folded(query[None])[0]
        at = np.zeros(1, dtype=np.int64)
        for high, small in self.levels:
            at = at[at < len(high)]
            at = at[self._open(low, size, high[at], small[at])]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.points)]
        if wanted is not None:
            at = at[wanted[self.order[at]]]
        at = at[self._open(low, size, self.points[at], self.sizes[at])]
        return self.order[at[self._open(query, size, self.fine[at], self.sizes[at])]]


def _allowed(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which two of a few points the bound does not rule out: what CountTree finds, for all at once."""
    shared = np.minimum(counts[:, None], counts[None]).sum(axis=2, dtype=np.int32)
    full = (counts == MOST).any(axis=1)
    return (shared >= least_overlap(size[:, None], size[None])) | (full[:, None] & full[None])


def _first_met(least: np.ndarray, name: int, i: int, at: np.ndarray) -> np.ndarray:
    """Of the rows ``at`` those that do not meet row ``i`` in a bucket of lesser name, as far as the lists of
    their NAMES_KEPT least names show. The bucket of least name always keeps its pairs."""
    before = least[i][least[i] < name]
    if not before.size or not at.size:
        return at
    return at[~(least[at][:, :, None] == before).any(axis=(1, 2))]


def _surviving(name: int, rows: dict[str, np.ndarray], forest: bool) -> list[tuple[int, int]]:
    """Pairs of different components in one bucket, one from each side, that the tree does not rule out; for a
    ``forest`` only those that join what the pairs before them have not joined. Within a bucket that is
    compared with itself both sides are all rows."""
    left, right = np.flatnonzero(rows["left"]), np.flatnonzero(rows["right"])
    part, key, size, counts = rows["component"].copy(), rows["key"], rows["size"], rows["counts"]
    if not left.size or not right.size or (part == part[0]).all():
        return []
    small = part.size <= LEAF
    if small:
        may = _allowed(counts, size)
    else:
        tree = CountTree(counts[right], size[right])
    found = []
    for i in left:
        other = part[right] != part[i]
        at = right[other & may[i, right]] if small else right[tree.search(counts[i], size[i], other)]
        if not at.size:
            continue
        at = _first_met(rows["least"], name, i, at)
        if forest and at.size:
            joined, one = np.unique(part[at], return_index=True)
            at = at[one]
            part[np.isin(part, joined)] = part[i]
        found.extend((min(key[i], other), max(key[i], other)) for other in key[at].tolist())
    return found


def _tree_join(forest: bool):
    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[int, int]] = set()
        if len(rows):
            columns = {c: rows[c].to_numpy() for c in ("key", "component", "size", "left", "right")}
            columns["counts"] = np.frombuffer(b"".join(rows["counts"]), dtype=np.uint8).reshape(len(rows), -1)
            columns["least"] = np.stack(rows["least"].to_list())
            name, block = rows["name"].to_numpy(), rows["block"].to_numpy()
            change = (name[1:] != name[:-1]) | (block[1:] != block[:-1])
            edges = np.concatenate(([0], np.flatnonzero(change) + 1, [len(rows)]))
            for low, high in zip(edges[:-1], edges[1:]):
                found.update(_surviving(name[low], {c: v[low:high] for c, v in columns.items()}, forest))
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Buckets come one after the other, sorted; a bucket may reach over batches."""
        rest: pd.DataFrame | None = None
        for rows in batches:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            if rows.empty:
                continue
            last = (rows["name"] == rows["name"].iloc[-1]) & (rows["block"] == rows["block"].iloc[-1])
            rest = rows[last]
            yield pairs(rows[~last])
        if rest is not None:
            yield pairs(rest)
    return run


def _buckets(members: DataFrame) -> DataFrame:
    """(name, salt, key) of all buckets that hold two sets or more. Copies post once per task. A name that many
    sets of one task share is dealt by salt, and the least key of each salt also stands in the bucket of salt
    0, so that no task gets a whole hot bucket."""
    rows = members.filter("names is not null").select("key", "names").mapInPandas(_post, "name long, salt int, key long")
    bucket = Window.partitionBy("name", "salt")
    return (
        rows.withColumn("_low", F.min("key").over(bucket)).withColumn("_high", F.max("key").over(bucket))
        .filter(F.col("_low") != F.col("_high")).select("name", "salt", "key").distinct()
    )


def _meeting(rows: DataFrame, turn: int) -> DataFrame:
    """One pair (a, b) per key: of the keys of another component that stand for their component in the key's
    buckets, the one it meets most often. Which key stands for a component changes with ``turn``."""
    face = F.struct("component", F.xxhash64("key", F.lit(turn)).alias("draw"), "key")
    faces = rows.groupBy("name", "salt").agg(F.min(face).alias("_low"), F.max(face).alias("_high")).filter(
        F.col("_low.component") != F.col("_high.component"))
    other = F.when(F.col("component") != F.col("_low.component"), F.col("_low.key")).otherwise(F.col("_high.key"))
    return (
        rows.join(faces, ["name", "salt"]).select("key", other.alias("other"))
        .groupBy("key", "other").count()
        .groupBy("key").agg(F.max(F.struct("count", "other")).alias("best"))
        .select(F.least("key", "best.other").alias("a"), F.greatest("key", "best.other").alias("b")).distinct()
    )


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (key, component) after components that a link (a, b) connects became one. Only one edge per two
    components goes into the search, however many of their keys are linked."""
    one = labels.select(F.col("key").alias("a"), F.col("component").alias("src"))
    two = labels.select(F.col("key").alias("b"), F.col("component").alias("dst"))
    edges = links.join(one, "a").join(two, "b").select("src", "dst").filter("src != dst").distinct()
    edges = stored(edges.union(edges.select("dst", "src")).distinct(), "jaccard-edges")
    found = components(edges.select(F.col("src").alias("id")).distinct(), edges)
    after = labels.join(found, F.col("component") == F.col("id"), "left")
    return stored(after.select("key", F.coalesce("label", "component").alias("component")), "jaccard-labels")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (name, salt, key) with the component of each key, stored, as a turn reads them several times."""
    return stored(rows.select("name", "salt", "key").join(labels, "key"), "jaccard-rows")


def _open(rows: DataFrame) -> DataFrame:
    """The rows of names that hold several components, stored. Components only grow together: a name that is left out
    stays closed, and later turns do not read it."""
    names = rows.groupBy("name").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter(
        F.col("_low") != F.col("_high"))
    return stored(rows.join(names.select("name"), "name", "left_semi"), "jaccard-open")


def _unsettled(rows: DataFrame, tested: DataFrame | None, settled: bool = False) -> DataFrame:
    """The rows of the buckets that still hold several components and have to be looked into, with ``hot`` if a bucket
    is dealt by salt, stored. Later turns need no other rows. Of buckets with the same members
    one is enough; a key that stands twice counts with its salts, or it would leave no trace in the XOR. A bucket of
    two sets has one pair: it is left out if that has been tested, and once a forest turn has ``settled`` such buckets."""
    members = [F.bit_xor(F.xxhash64("key", "salt", F.lit(seed))).alias(f"_members{seed}") for seed in (1, 2)]
    open_names = rows.groupBy("name").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.max("salt").alias("_salts"),
        F.count("*").alias("_rows"), F.min("key").alias("a"), F.max("key").alias("b"), *members,
    ).filter(F.col("_low") != F.col("_high")).groupBy("_rows", "_members1", "_members2", "a", "b").agg(
        F.min("name").alias("name"), F.max(F.col("_salts") > 0).alias("hot"))
    if settled:
        open_names = open_names.filter(F.col("_rows") > 2)
    elif tested is not None:
        known = tested.withColumn("_rows", F.lit(2).cast("long"))
        open_names = open_names.join(known, ["a", "b", "_rows"], "left_anti")
    return stored(rows.join(open_names.select("name", "hot"), "name"), "jaccard-unsettled")


def _remaining(rows: DataFrame, contents: DataFrame, forest: bool) -> DataFrame:
    """Candidate pairs (a, b) of different components, from the buckets of the ``_unsettled`` rows: all, or for a
    ``forest`` enough of each bucket to connect what its candidates connect."""
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS))).otherwise(F.array(F.lit(0)))
    least = rows.groupBy("key").agg(F.slice(F.concat(
        F.array_sort(F.collect_set("name")), F.array_repeat(F.lit(NO_NAME), NAMES_KEPT)), 1, NAMES_KEPT).alias("least"))
    rows = (
        rows.withColumn("_other", F.explode(every))
        .select(
            "name", "key", "component",
            F.when(F.col("hot"), F.least("salt", "_other") * (SALTS + 1) + F.greatest("salt", "_other"))
            .otherwise(0).alias("block"),
            (~F.col("hot") | (F.col("salt") <= F.col("_other"))).alias("left"),
            (~F.col("hot") | (F.col("salt") >= F.col("_other"))).alias("right"))
        .join(contents.select("key", "size", "counts").join(least, "key"), "key")
        .repartition("name", "block").sortWithinPartitions("name", "block")
    )
    return rows.mapInPandas(_tree_join(forest), "a long, b long").distinct()


def _grouped(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``_sets`` that have shingles, with their component, and those that have none."""
    bound_batches(docs.sparkSession)
    members = stored(_sets(docs, words), "jaccard-members")
    buckets = stored(_buckets(members), "jaccard-buckets")
    contents = stored(_contents(docs, members, buckets.select("key").distinct(), words), "jaccard-contents")
    labels = buckets.select("key").distinct().withColumn("component", F.col("key"))
    rows, tested = buckets.withColumn("component", F.col("key")), None
    for turn in range(STAR_TURNS + FOREST_TURNS + 1):
        star = turn < STAR_TURNS
        if turn:
            rows = _labelled(rows, labels)
        if star:
            rows = _open(rows) if turn else rows
            pairs = _meeting(rows.repartition("name", "salt"), turn)
        else:
            rows = _unsettled(rows, tested, turn > STAR_TURNS)
            pairs = _remaining(rows, contents, turn < STAR_TURNS + FOREST_TURNS)
        pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        if star:
            pairs = stored(_bounded(pairs, contents), "jaccard-bounded")
        labels = _merged(labels, _verified(pairs, contents))
    filled = members.filter("n_shingles > 0").join(labels, "key", "left").select(
        "doc_id", "mark", "key", "n_shingles", F.coalesce("component", "key").alias("_component"))
    return filled, members.filter("n_shingles = 0")


def groups(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    Null and empty texts have no shingles and stand alone. Repeated rows and equal sets are one group. A
    component without any id has a null component_id.
    """
    filled, empty = _grouped(docs, words)
    least = filled.groupBy("_component").agg(F.min("doc_id").alias("component_id"))
    return filled.join(least, "_component").select("doc_id", "n_shingles", "component_id").union(
        empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one document of each group, the one of least id (of several texts under that id the one of
    least set key), with all its columns as they are, whatever their names.

    Rows that repeat id and text become one: the least by their columns as text, in their order, nulls first. Documents
    without shingles (null, empty or blank texts) and texts of other groups under the same id stay; rows without an id
    stay, each; an empty table stays empty."""
    filled, empty = _grouped(docs.filter("doc_id is not null"), words)
    row = F.struct("doc_id", "key", "mark")
    least = filled.groupBy("_component").agg(F.min(row).alias("_least"))
    dropped = filled.join(least, "_component").filter(row != F.col("_least")).select("doc_id", "mark", F.lit(True).alias("gone"))
    often = filled.select("doc_id", "mark").union(empty.select("doc_id", "mark")).groupBy("doc_id", "mark").count().filter("count > 1")
    fate = stored(dropped.distinct().join(often, ["doc_id", "mark"], "full").select(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.coalesce("gone", F.lit(False)).alias("_gone")), "jaccard-fates")
    same = (F.col("doc_id") == F.col("_id")) & (_mark("text") == F.col("_mark"))
    single = docs.join(fate, same, "left_anti")
    first = Window.partitionBy("_id", "_mark").orderBy(*[F.col(c).cast("string") for c in docs.columns])
    repeated = docs.join(fate.filter(~F.col("_gone")), same).withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
    return single.unionByName(repeated.select(*docs.columns))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All pairs that share a shingle, counted, and the components of those that link, in DuckDB's SQL.
SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
    range(1, greatest(len(w) - {SHINGLE_WORDS - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' '))) END AS s
  FROM words),
tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)"""
