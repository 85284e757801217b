"""Table scans and appends."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_database(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int, **options: str) -> DataFrame:
    """A database table read in ``parts`` ranges of an integer key; filters are pushed down."""
    return spark.read.jdbc(
        url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts,
        properties=dict(options),
    )


def append_tables(frames: Mapping[str, DataFrame], root: str) -> None:
    """Append every frame to ``root/<name>`` as a set; no row loop and no per-row lookup."""
    for name, frame in frames.items():
        frame.write.mode("append").parquet(f"{root}/{name}")
