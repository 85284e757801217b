"""Raw post files: header, latin-1, quoted lines, six or more positional columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postflock.schema import RAW_COLUMNS, RAW_POSTS

MIN_COLUMNS = 6
# Marks an empty field in the file, so that it can be told from a field that is not there.
EMPTY = '""'


def read_raw_posts(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, sentiment, raw_id, time_text, username, text, short).

    Short rows come padded with NULL, so a row's width is the position of its last non-NULL
    field. Username and text stand last but one and last. Row numbers rise with the position in a
    file; files come in the order in which Spark packs them, which their sizes and names fix.
    """
    lines = (
        spark.read.schema(RAW_POSTS).option("encoding", "ISO-8859-1").option("header", True)
        .option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
        .option("enforceSchema", True).option("nullValue", "\u0000").option("emptyValue", "")
        .csv(path)
    )
    fields = F.array(*[F.col(f"c{i}") for i in range(RAW_COLUMNS)])
    places = F.transform(fields, lambda v, i: F.when(v.isNotNull(), i + 1).otherwise(0))
    wide = lines.select(F.monotonically_increasing_id().alias("row_no"), fields.alias("_f"), F.array_max(places).alias("_n"))
    at = lambda back: F.get("_f", F.col("_n") - back)
    return wide.select(
        "row_no", F.get("_f", F.lit(0)).alias("sentiment"), F.get("_f", F.lit(1)).alias("raw_id"),
        F.get("_f", F.lit(2)).alias("time_text"), at(2).alias("username"), at(1).alias("text"),
        (F.col("_n") < MIN_COLUMNS).alias("short"),
    )


def write_raw_posts(rows: DataFrame, path: str) -> None:
    """Rows (sentiment, raw_id, time_text, flag, username, text) in the raw file form."""
    columns = ["sentiment", "raw_id", "time_text", "flag", "username", "text"]
    (
        rows.select(*columns).write.option("header", True).option("encoding", "ISO-8859-1")
        .option("quoteAll", True).option("escape", '"').mode("overwrite").csv(path)
    )
