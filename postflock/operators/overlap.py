"""Best partners by shared keys, for everyone at once, exact and without listing all pairs.

Both operators below join people to items over shared keys. Joined plainly, one popular key makes
as many rows as (people with it) x (items with it). So the plain join runs only where its row
count, measured first, is small. Otherwise the operators work in two steps:

1. Keys with a long list of items keep only the head of that list, in an order where better items
   come first; other keys keep all. Every item found this way gets its exact score.
2. For each person an upper bound is set on the score of any item not found. Where the k-th best
   score beats that bound the answer is proven. The rest, and only they, take the plain join.

The method is the threshold algorithm of Fagin, Lotem and Naor, recast as joins. Where people share many popular keys its
two steps would make as many rows as the plain join and shuffle them: there, by the counts measured, and for those left
over, the sums are made as products of blocks (``products``), which shuffle people and not pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from postflock.operators.products import nearest
from postflock.operators.ranking import top_k

HEAD = 128
PLAIN_ROWS = 200_000_000
# A row of the two steps costs about as much as so many pairs in a product of blocks.
STEP_PAIRS = 16
# Rows one task of the plain join should make, and items small enough to be sent to every task.
TASK_ROWS = 4_000_000
SENT_ITEMS = 1_000_000
SALTS = 16


@dataclass(frozen=True)
class Work:
    """Measured size of a plain join: rows it makes and items on its right side; rows that the two steps make."""

    rows: int
    items: int
    step_rows: int = 0

    def plain(self, plain_rows: int) -> bool:
        """A plain join whose items are not sent to every task shuffles its pairs, so it may make fewer."""
        return self.rows <= (plain_rows if self.items <= SENT_ITEMS else plain_rows // SALTS)

    def blocked(self, wants: DataFrame, postings: DataFrame) -> bool:
        """Whether all pairs in blocks cost less than the two steps."""
        people, items = wants.agg(F.count_distinct("me")).first()[0], postings.agg(F.count_distinct("item")).first()[0]
        return self.step_rows * STEP_PAIRS > people * items


def measure(wants: DataFrame, postings: DataFrame, head: int = HEAD) -> Work:
    """One small aggregate per side; no pair is made. Step 1 makes a row per want and open item; each is completed by
    the cut keys of its person."""
    left = wants.groupBy("key").agg(F.count(F.lit(1)).alias("a"))
    right = postings.groupBy("key").agg(F.count(F.lit(1)).alias("b"))
    a, b = F.coalesce("a", F.lit(0)).cast("double"), F.col("b")
    found = right.join(left, "key", "left").agg(
        F.sum(a * b), F.sum("b"), F.sum(a * F.least(b, F.lit(head))), F.sum(F.when(b > head, a))
    ).first()
    people = wants.agg(F.count_distinct("me")).first()[0]
    steps = (found[2] or 0) * (1 + (found[3] or 0) / max(1, people))
    return Work(int(found[0] or 0), int(found[1] or 0), int(steps))


def matched(wants: DataFrame, postings: DataFrame, work: Work) -> DataFrame:
    """Join on ``key`` spread over as many tasks as the measured rows ask for.

    Inputs are small next to the output here, so sizes alone would leave all of it to few tasks.
    Few items go to every task, and people are spread by id, so the pairs of a person meet in
    one task and the sums that follow need no shuffle. Otherwise each key is salted on the left
    and repeated on the right, so that a hot key is worked on by many tasks.
    """
    context = wants.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, work.rows // TASK_ROWS)
    if work.items <= SENT_ITEMS:
        return wants.repartition(tasks, "me").join(F.broadcast(postings), "key")
    salted = wants.withColumn("_salt", F.pmod(F.xxhash64("me"), F.lit(SALTS)).cast("int"))
    repeated = postings.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = ["key", "_salt"]
    return salted.repartition(tasks, *keys).join(repeated.repartition(tasks, *keys), keys).drop("_salt")


def _visible(postings: DataFrame, order, head: int):
    """Postings open to step 1, the last row shown of each cut list, and the rows cut off."""
    heavy = (
        postings.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > head).select("key")
    )
    cut = postings.join(heavy, "key", "left_semi")
    shown = top_k(cut, ["key"], order, head, rank="_place")
    last = shown.filter(F.col("_place") == head).select(
        "key", F.col("item").alias("_last"), F.col("v").alias("_edge")
    )
    visible = postings.join(heavy, "key", "left_anti").unionByName(shown.drop("_place"))
    return visible, last, cut.join(last, "key")


def _without(pairs: DataFrame, exclude: DataFrame | None, skip_self: bool) -> DataFrame:
    if skip_self:
        pairs = pairs.filter(F.col("me") != F.col("item"))
    return pairs if exclude is None else pairs.join(exclude, ["me", "item"], "left_anti")


def _exact(seen: DataFrame, heavy_wants: DataFrame, tail: DataFrame, add) -> DataFrame:
    """Add to each seen pair what its cut-off keys hold."""
    missing = (
        seen.select("me", "item").join(heavy_wants.select("me", "key"), "me")
        .join(tail.select("key", "item", "v"), ["key", "item"])
        .groupBy("me", "item").agg(add.alias("_more"))
    )
    total = F.col("score") + F.coalesce(F.col("_more"), F.lit(0))
    return seen.join(missing, ["me", "item"], "left").withColumn("score", total).drop("_more")


def top_by_sum(
    wants: DataFrame,
    postings: DataFrame,
    k: int,
    exclude: DataFrame | None = None,
    skip_self: bool = True,
    head: int = HEAD,
    plain_rows: int = PLAIN_ROWS,
) -> DataFrame:
    """For each ``me`` the ``k`` items with the largest sum of ``v`` over the keys it wants.

    ``wants(me, key)`` distinct; ``postings(key, item, v)`` with whole positive ``v``, one row per
    (key, item); ``exclude(me, item)``. Ties go to the smaller item. Returns (me, item, score, rank).
    """
    order = [F.desc("score"), F.col("item")]

    def plain(part: DataFrame) -> DataFrame:
        pairs = matched(part, postings, work).groupBy("me", "item").agg(F.sum("v").alias("score"))
        return top_k(_without(pairs, exclude, skip_self), ["me"], order, k)

    def blocks(part: DataFrame) -> DataFrame:
        return nearest(part, postings, k, exclude, skip_self, head)

    work = measure(wants, postings, head)
    if work.plain(plain_rows):
        return plain(wants)
    if work.blocked(wants, postings):
        return blocks(wants)

    visible, last, tail = _visible(postings, [F.desc("v"), F.col("item")], head)
    after = (F.col("v") < F.col("_edge")) | ((F.col("v") == F.col("_edge")) & (F.col("item") > F.col("_last")))
    tail = tail.filter(after)
    heavy_wants = wants.join(last, "key")
    # An unseen item adds at most the edge value of each cut list. It reaches that sum only when it
    # ties at every edge, and then its id lies past every last id shown.
    bound = heavy_wants.groupBy("me").agg(F.sum("_edge").alias("_bound"), F.max("_last").alias("_past"))
    seen = wants.join(visible, "key").groupBy("me", "item").agg(F.sum("v").alias("score"))
    best = top_k(
        _exact(_without(seen, exclude, skip_self), heavy_wants, tail, F.sum("v")), ["me"], order, k
    )
    proven = (F.col("score") > F.col("_bound")) | (
        (F.col("score") == F.col("_bound")) & (F.col("item") <= F.col("_past"))
    )
    return _settle(wants, best, bound, proven, blocks, k)


def top_by_jaccard(
    sets: DataFrame,
    k: int,
    head: int = HEAD,
    plain_rows: int = PLAIN_ROWS,
) -> DataFrame:
    """For each member the ``k`` others with the largest Jaccard index of their key sets.

    ``sets(me, key)`` distinct. Others with no common key are left out. Ties go to the smaller id.
    Returns (me, item, score, rank).
    """
    order = [F.desc("score"), F.col("item")]
    sizes = sets.groupBy("me").agg(F.count(F.lit(1)).alias("size"))
    postings = sets.join(sizes, "me").select("key", F.col("me").alias("item"), F.col("size").alias("v"))

    def index(pairs: DataFrame) -> DataFrame:
        """Overlap in ``score`` to Jaccard; ``v`` is the other side's size."""
        ratio = F.col("score") / (F.col("size") + F.col("v") - F.col("score"))
        return pairs.join(sizes, "me").withColumn("score", ratio).select("me", "item", "score")

    def overlap(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter(F.col("me") != F.col("item"))
        return pairs.groupBy("me", "item").agg(F.count(F.lit(1)).alias("score"), F.max("v").alias("v"))

    def plain(part: DataFrame) -> DataFrame:
        return top_k(index(overlap(matched(part, postings, work))), ["me"], order, k)

    def blocks(part: DataFrame) -> DataFrame:
        return nearest(part, postings, k, None, True, head, index=True)

    work = measure(sets, postings, head)
    if work.plain(plain_rows):
        return plain(sets)
    if work.blocked(sets, postings):
        return blocks(sets)

    visible, last, tail = _visible(postings, [F.col("v"), F.col("item")], head)
    after = (F.col("v") > F.col("_edge")) | ((F.col("v") == F.col("_edge")) & (F.col("item") > F.col("_last")))
    tail = tail.filter(after)
    heavy_wants = sets.join(last, "key")
    # An unseen other shares cut lists only. Sharing i of them, it is at least as large as the i-th
    # smallest edge size, which bounds the index.
    nth = F.row_number().over(Window.partitionBy("me").orderBy("_edge", "key"))
    union = F.col("size") + F.greatest(F.col("_i"), F.col("_edge")) - F.col("_i")
    bound = (
        heavy_wants.withColumn("_i", nth.cast("long")).join(sizes, "me")
        .groupBy("me").agg(
            F.max(F.col("_i") / union).alias("_bound"), F.max("_last").alias("_past"),
            F.count(F.lit(1)).alias("_cut"),
        )
    )
    seen = _exact(overlap(sets.join(visible, "key")), heavy_wants, tail, F.count(F.lit(1)))
    best = top_k(index(seen), ["me"], order, k)
    tie = (F.col("score") == F.col("_bound")) & (F.col("_cut") == 1) & (F.col("item") <= F.col("_past"))
    return _settle(sets, best, bound, (F.col("score") > F.col("_bound")) | tie, blocks, k)


def _settle(wants, best, bound, proven, rest, k) -> DataFrame:
    """Keep proven answers and send everyone else's wants to ``rest``. A person without a
    cut list has seen every item, so any answer, however short, stands."""
    closed = best.filter(F.col("rank") == k).join(bound, "me").filter(proven).select("me")
    open_people = bound.select("me").join(closed, "me", "left_anti")
    return best.join(open_people, "me", "left_anti").unionByName(
        rest(wants.join(open_people, "me", "left_semi"))
    )


def pair_overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Set sizes, overlap, union and Jaccard for given pairs ``(a, b)`` over ``sets(me, key)``.

    Sizes come ready counted and only the common keys are joined."""
    sizes = sets.groupBy("me").agg(F.count(F.lit(1)).alias("n"))
    common = (
        pairs.join(sets.withColumnRenamed("me", "a"), "a")
        .join(sets.withColumnRenamed("me", "b"), ["b", "key"])
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    )
    zero = F.lit(0)
    joined = (
        pairs.join(sizes.select(F.col("me").alias("a"), F.col("n").alias("n_a")), "a", "left")
        .join(sizes.select(F.col("me").alias("b"), F.col("n").alias("n_b")), "b", "left")
        .join(common, ["a", "b"], "left").na.fill(0, ["n_a", "n_b", "common"])
    )
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return joined.withColumn("either", union).withColumn(
        "jaccard", F.when(union > zero, F.col("common") / union).otherwise(0.0)
    )
