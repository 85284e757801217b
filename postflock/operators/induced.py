"""A sentiment lexicon learned from scored posts.

1. ``log_odds``: how much likelier a word stands in a positive than in a negative post, with a prior in proportion to
   the word's overall use, and its distance from chance.
2. ``spread``: words that stand beside the surely polar ones take the mean polarity of their neighbours.
3. ``modifiers``: a word before polar words that turns or strengthens what their posts say is a negation or intensifier.

All three are counts per word or pair of words, summed up before each shuffle. The result has the lexicon schema that
``lexicon.score_texts`` reads.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from postflock.operators.lexicon import TOKEN, score_texts
from postflock.session import cut_lineage

PRIOR = 500.0
LEAST_PAIRS = 2
ROUNDS = 2
LEAST_POLARITY = 0.05
LEAST_USES = 20
ERRORS = 3.0


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def log_odds(posts: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(word, pos, neg, log_odds, z) over ``posts(text, sentiment_score)``: in how many positive and negative posts a
    word stands, however often in each; posts without score or with score 0 take no part."""
    side = F.col("sentiment_score") > 0
    counts = (
        posts.filter("sentiment_score <> 0")
        .select(side.alias("good"), F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
        .groupBy("word").agg(F.count_if("good").alias("pos"), F.count_if(~F.col("good")).alias("neg"))
    )
    counts = cut_lineage(counts)
    sums = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    all_pos, all_neg = sums.select("p").scalar(), sums.select("n").scalar()
    own = F.lit(prior) * (F.col("pos") + F.col("neg")) / (F.col("_p") + F.col("_n"))
    good, bad = F.col("pos") + F.col("_a"), F.col("neg") + F.col("_a")
    odds = F.log(good / (F.col("_p") + F.lit(prior))) - F.log(bad / (F.col("_n") + F.lit(prior)))
    return (
        counts.withColumn("_p", all_pos).withColumn("_n", all_neg).withColumn("_a", own)
        .select("word", "pos", "neg", odds.alias("log_odds"), (odds / F.sqrt(1 / good + 1 / bad)).alias("z"))
    )


def sure(odds: DataFrame, least_z: float | None = None) -> DataFrame:
    """(word, polarity) of the words beyond chance. By default the bound rises with the number of words looked at, so
    that not one of them is expected to pass by chance; the polarity is the odds ratio brought to -1 to 1."""
    bound = F.lit(least_z) if least_z is not None else odds.agg(F.sqrt(2 * F.log(2.0 * F.count(F.lit(1))))).scalar()
    return odds.filter(F.abs("z") >= bound).select("word", F.tanh(F.col("log_odds") / 2).alias("polarity"))


def neighbours(posts: DataFrame, least: int = LEAST_PAIRS) -> DataFrame:
    """(word, other, n): how often two different words stand side by side in ``posts(text)``, in either order, if at
    least ``least`` times. The number of pairs grows with the texts, not with its square."""
    words = posts.select(words_of(F.col("text")).alias("w"))
    follow = words.select(F.explode(F.arrays_zip(
        F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("p"))
    pairs = (
        follow.filter("p.b is not null and p.a <> p.b")
        .select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b"))
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    )
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("other")))
    return pairs.select(F.explode(both).alias("e"), "n").select("e.word", "e.other", "n")


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(word, polarity): the seeds as they are, other words by the mean polarity of all that stands beside them (0
    where a neighbour has none yet), weighted by count, ``rounds`` times over."""
    held = seeds
    for _ in range(rounds):
        from_others = (
            edges.join(held.withColumnRenamed("word", "other"), "other", "left")
            .groupBy("word").agg((F.sum(F.coalesce("polarity", F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("polarity"))
        )
        held = cut_lineage(seeds.unionByName(
            from_others.join(seeds.select("word"), "word", "left_anti").filter("polarity <> 0")))
    return held


def modifiers(posts: DataFrame, polar: DataFrame, least: int = LEAST_USES, errors: float = ERRORS) -> DataFrame:
    """(word, intensity, is_negation) of words right before polar ones. What a polar word promises is its sign, what its
    post says is the score: a word before which they disagree, by more than ``errors`` standard errors, is a negation;
    one before which they agree more, or less, than elsewhere has an intensity, held to 0.5 to 2."""
    words = posts.filter("sentiment_score <> 0").select("sentiment_score", words_of(F.col("text")).alias("w"))
    follow = words.select("sentiment_score", F.explode(F.arrays_zip(
        F.col("w").alias("before"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("after"))).alias("p"))
    agree = F.signum("sentiment_score") * F.signum("polarity")
    uses = cut_lineage(
        follow.filter("p.after is not null").select("sentiment_score", "p.before", F.col("p.after").alias("word"))
        .join(polar, "word").groupBy("before").agg(
            F.count(F.lit(1)).alias("n"), F.sum(agree).alias("s"), F.sum(agree * agree).alias("q")))
    base = uses.agg(F.sum("s") / F.sum("n")).scalar()
    mean = F.col("s") / F.col("n")
    error = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, 1 / F.col("n")) / F.col("n"))
    turned = F.col("_m") + errors * F.col("_e") < 0
    apart = (F.abs(F.col("_m") - F.col("_base")) > errors * F.col("_e")) & (F.col("_m") > 0) & (F.col("_base") > 0)
    strength = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("_m") / F.col("_base")))
    return (
        uses.filter(F.col("n") >= least).withColumn("_m", mean).withColumn("_e", error).withColumn("_base", base)
        .select(F.col("before").alias("word"), F.when(apart, strength).alias("intensity"),
                turned.alias("is_negation"))
        .filter("intensity is not null or is_negation")
    )


def lexicon(posts: DataFrame, least_z: float | None = None) -> DataFrame:
    """The lexicon that ``posts(text, sentiment_score)`` teach. Posts without a score still tell which words stand side by
    side. Null and empty texts have no words; without positive and negative posts the lexicon is empty."""
    seeds = cut_lineage(sure(log_odds(posts), least_z))
    polar = spread(seeds, cut_lineage(neighbours(posts))).filter(F.abs("polarity") >= LEAST_POLARITY)
    before = modifiers(posts, seeds)
    return cut_lineage(polar.join(before, "word", "full").select(
        "word", "polarity", "intensity", F.coalesce("is_negation", F.lit(False)).alias("is_negation")))


def held_out(posts: DataFrame, key: str = "post_id", folds: int = 4, least_z: float | None = None) -> DataFrame:
    """(post_id, said, score): posts of one of ``folds`` parts, by the CRC-32 of the id, scored by the lexicon that the
    other parts teach; ``said`` is the sign of their own score. Posts without score, or with score 0, are left out."""
    out = F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0
    learned = lexicon(posts.filter(~out), least_z)
    mine = posts.filter(out).filter("sentiment_score <> 0")
    scored = score_texts(mine, learned, key).select(key, F.col("sentiment_score").alias("score"))
    return mine.select(key, F.signum("sentiment_score").cast("int").alias("said")).join(scored, key)
