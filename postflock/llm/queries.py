"""The queries of this subpackage, op1 to op13, over a table folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from postflock.llm import (
    byte_pairs, hnsw, infill, jaccard, lengths, packing, pieces, pii, prefix_trie, secrets, toxicity, url_lists, winnowing)
from postflock.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def keep(function):
        QUERIES[name] = function
        return function
    return keep


@query("op1_winnowing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.digest(read_table(spark, folder, "documents"))


@query("op2_hnsw")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.neighbours(read_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op3_ngram_jaccard")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.groups(read_table(spark, folder, "documents"))


@query("op4_mixture_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"))


@query("op5_length_histogram")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return lengths.suffix_sums(lengths.histogram(read_table(spark, folder, "documents")))


@query("op6_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.digest(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query("op7_url_lists")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return url_lists.digest(read_table(spark, folder, "pages"))


@query("op8_personal_data")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(read_table(spark, folder, "documents"))


@query("op9_sentencepiece")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digest(read_table(spark, folder, "documents"))


@query("op10_secret_scan")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(read_table(spark, folder, "documents"))


@query("op11_fill_in_middle")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return infill.digest(read_table(spark, folder, "documents"))


@query("op12_byte_bpe")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return byte_pairs.digest(read_table(spark, folder, "documents"))


@query("op13_prefix_trie")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.nodes_report(read_table(spark, folder, "conversations"))


SQL["op3_ngram_jaccard"] = jaccard.SQL
SQL["op7_url_lists"] = url_lists.SQL
SQL["op10_secret_scan"] = secrets.digest_sql()
SQL["op11_fill_in_middle"] = infill.SQL
SQL["op13_prefix_trie"] = prefix_trie.SQL
