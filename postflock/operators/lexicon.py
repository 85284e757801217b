"""Lexicon sentiment as joins.

Mean polarity of the matched words of a text. An intensifier right before a word multiplies its
polarity; a negation right before it, or before its intensifier, multiplies by -0.5; each word's
value is held to [-1, 1]. A text without matches scores 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postflock.functions import text as tx
from postflock.schema import LEXICON

NEGATION_FACTOR = -0.5
TOKEN = r"[\p{L}\p{N}_']+"

# A small lexicon of our own. Callers with a better one pass it as a DataFrame.
POLARITY = {
    "good": 0.7, "great": 0.8, "awesome": 1.0, "excellent": 1.0, "happy": 0.8, "love": 0.5,
    "best": 1.0, "better": 0.5, "nice": 0.6, "win": 0.8, "beautiful": 0.85, "fun": 0.3,
    "perfect": 1.0, "wonderful": 1.0, "amazing": 0.6, "cool": 0.35, "enjoy": 0.4, "glad": 0.5,
    "bad": -0.7, "worst": -1.0, "worse": -0.4, "terrible": -1.0, "awful": -1.0, "sad": -0.5,
    "hate": -0.8, "angry": -0.5, "poor": -0.4, "boring": -1.0, "ugly": -0.7, "sick": -0.7,
    "wrong": -0.5, "hard": -0.3, "stupid": -0.8, "horrible": -1.0, "sorry": -0.5, "fail": -0.5,
}
INTENSITY = {
    "very": 1.3, "really": 1.2, "extremely": 1.5, "so": 1.2, "too": 1.1, "quite": 1.1,
    "slightly": 0.7, "somewhat": 0.8, "absolutely": 1.5, "totally": 1.4,
}
NEGATIONS = ("not", "no", "never", "cannot", "don't", "doesn't", "didn't", "isn't", "wasn't", "can't", "won't")


def default_lexicon(spark: SparkSession) -> DataFrame:
    rows = [(w, p, None, False) for w, p in POLARITY.items()]
    rows += [(w, None, i, False) for w, i in INTENSITY.items()]
    rows += [(w, None, None, True) for w in NEGATIONS]
    return spark.createDataFrame(rows, LEXICON)


def score_texts(posts: DataFrame, lexicon: DataFrame, key: str = "post_id") -> DataFrame:
    """``posts`` with sentiment_score and sentiment_label set anew.

    Each word carries the two before it, so no window is needed; words without polarity drop out
    at the first join. The lexicon's size is not known here, so Spark chooses the join.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN), 0)
    # Outer, so that no filter on the array is added below and the pattern is matched once.
    spread = (
        posts.select(key, words.alias("_w")).select(key, "_w", F.posexplode_outer("_w").alias("_p", "word"))
        .select(
            key, "word",
            F.get("_w", F.col("_p") - 1).alias("_one"), F.get("_w", F.col("_p") - 2).alias("_two"),
        )
    )
    polar = lexicon.filter(F.col("polarity").isNotNull()).select("word", "polarity")
    strong = lexicon.filter(F.col("intensity").isNotNull()).select(F.col("word").alias("_one"), "intensity")
    denial = lexicon.filter("is_negation")
    first = denial.select(F.col("word").alias("_one"), F.lit(True).alias("_not_one"))
    second = denial.select(F.col("word").alias("_two"), F.lit(True).alias("_not_two"))
    matched = (
        spread.join(polar, "word").join(strong, "_one", "left")
        .join(first, "_one", "left").join(second, "_two", "left")
    )
    negated = F.col("_not_one").isNotNull() | (
        F.col("intensity").isNotNull() & F.col("_not_two").isNotNull()
    )
    value = (
        F.col("polarity") * F.coalesce("intensity", F.lit(1.0))
        * F.when(negated, NEGATION_FACTOR).otherwise(1.0)
    )
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))
    scores = matched.groupBy(key).agg(F.avg(clipped).alias("_score"))
    score = F.coalesce("_score", F.lit(0.0))
    return (
        posts.drop("sentiment_score", "sentiment_label").join(scores, key, "left")
        .withColumn("sentiment_score", score)
        .withColumn("sentiment_label", tx.polarity_label(F.col("sentiment_score"))).drop("_score")
    )


def unscored(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("sentiment_score").isNull() | F.col("sentiment_label").isNull())


def backfill(posts: DataFrame, lexicon: DataFrame, key: str = "post_id") -> DataFrame:
    """All posts, those lacking score or label scored anew, with a flag ``updated``."""
    done = posts.filter(F.col("sentiment_score").isNotNull() & F.col("sentiment_label").isNotNull())
    fresh = score_texts(unscored(posts), lexicon, key)
    return done.withColumn("updated", F.lit(False)).unionByName(fresh.withColumn("updated", F.lit(True)))
