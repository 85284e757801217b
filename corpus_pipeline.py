"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. The first three return
the columns of ``docs``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postflock.llm import jaccard, packing, secrets, toxicity
from postflock.llm.common import read_table, stored

#: SQL has neither the learned scores nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; all others stay, with all their columns. Null and empty texts hold
    no toxic word; repeated rows fare alike; an empty table stays empty."""
    return toxicity.keep_civil(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of alike documents the one of least id stays, and of rows that repeat id and text the least by their
    columns as text. Null, empty and blank texts and rows without an id stay; an empty table stays empty."""
    return jaccard.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, null and empty ones and repeated rows too; secrets in them are replaced by a mark, and n_chars
    follows; other columns stay as they are, whatever their names."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of mixed sequences; a null or empty text is its end id alone; repeated rows are packed
    each; an empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixture_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
