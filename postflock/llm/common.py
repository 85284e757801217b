"""Small helpers the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from postflock.session import work_dir

BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2000 rows or about 8 MB, so that very long texts fit beside each other."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, so that lost executors
    cost no recomputation, and values such as generated row ids stay what they are."""
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text ('' for null) and the named columns only: other columns never meet an operator's own names."""
    return docs.select("doc_id", *more, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def remainder(key: Column, parts: int) -> Column:
    """crc32 of the decimal form of ``key``, modulo ``parts``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def running_total(
    df: DataFrame, within: list[str], bucket: Column, order: list, value: str, out: str
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one, in the order (bucket, ``order``),
    separately for each ``within``. Buckets are summed first and their sums added up, so no task sorts more
    than one bucket, or the list of bucket sums of one ``within``."""
    df = df.withColumn("_bucket", bucket)
    keys = [*within, "_bucket"]
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
        .select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(bases, keys)
        .withColumn(out, F.col("_base") + F.col("_inside"))
        .drop("_bucket", "_base", "_inside")
    )
