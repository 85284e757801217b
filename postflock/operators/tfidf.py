"""TF-IDF and cosine in long form: rows (doc, term, w) instead of matrices.

idf = ln((1 + n) / (1 + df)) + 1, weights scaled to length 1 per document. A document is a single
text or, where many texts make one, its vocabulary is cut by ``max_features``; either way its group
of weights is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from postflock.functions.stopwords import ENGLISH
from postflock.functions import text as tx
from postflock.operators.similarity import similar
from postflock.session import stored


def term_counts(
    rows: DataFrame, doc: str, words: Column | None = None, stop_words: Sequence[str] = ENGLISH
) -> DataFrame:
    """(doc, term, tf). A document may be spread over many rows: its texts need no joining."""
    words = tx.tokens(F.col("text")) if words is None else words
    flat = rows.select(F.col(doc).alias("doc"), F.explode(words).alias("term"))
    if stop_words:
        flat = flat.filter(~F.col("term").isin(*stop_words))
    return flat.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """(term, df, cf), cut to the terms most frequent in the corpus where asked."""
    terms = counts.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")
    ).filter(F.col("df") >= min_df)
    return terms.orderBy(F.desc("cf"), "term").limit(max_features) if max_features else terms


def indexed(terms: DataFrame) -> DataFrame:
    """Vocabulary cut by ``max_features`` with positions 0..k-1 in term order."""
    place = F.row_number().over(Window.orderBy("term")) - 1
    return terms.withColumn("idx", place)


def weigh(counts: DataFrame, terms: DataFrame, n_docs: Column) -> DataFrame:
    """(doc, term, w) with length 1 per document."""
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1
    raw = counts.join(terms.select("term", "df"), "term").select(
        "doc", "term", (F.col("tf") * idf).alias("w")
    )
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("w") / norm).alias("w"))


def tfidf(
    rows: DataFrame,
    doc: str,
    words: Column | None = None,
    stop_words: Sequence[str] = ENGLISH,
    min_df: int = 1,
    max_features: int | None = None,
) -> DataFrame:
    """(doc, term, w) of the documents in ``rows``; n counts documents without terms too. With ``max_features`` the
    counts are stored, so that the texts are taken apart once and not for every use of the vocabulary and the weights."""
    counts = term_counts(rows, doc, words, stop_words)
    if max_features:
        counts = stored(counts, "terms")
    n_docs = rows.agg(F.count_distinct(doc)).scalar()
    return weigh(counts, vocabulary(counts, min_df, max_features), n_docs)


def similar_pairs(weights: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(a, b, weight) with a < b and cosine above ``threshold``, for unit vectors. Of equal vectors the least document
    stands for all; each of the others has a row with it."""
    return similar(weights, threshold).links()


def mean_vector(weights: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    """(owner, term, w): mean of the vectors of an owner's documents. ``owners(doc, owner)`` has a
    row for every document, so documents without terms count as zero vectors."""
    sizes = owners.groupBy(owner).agg(F.count(F.lit(1)).alias("_n"))
    return (
        weights.join(owners, "doc").groupBy(owner, "term").agg(F.sum("w").alias("_s"))
        .join(sizes, owner).select(owner, "term", (F.col("_s") / F.col("_n")).alias("w"))
    )
