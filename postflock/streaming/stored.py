"""Tables that a stream's micro-batches keep: changes per batch, merged now and then, safe to write again.

Each batch writes under its own number, so a batch that is run again after a failure replaces its own files; and it reads
only what lower numbers wrote, so it sees what its first run saw.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from postflock.session import cut_lineage

MERGE_EVERY = 16


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, or no rows where nothing has been written yet. A first batch without rows leaves no partition."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Changes:
    """Rows by batch under ``root/changes/batch=n``, and every ``MERGE_EVERY`` batches all rows so far, merged by
    ``merge``, under ``root/merged/batch=n``. A reader takes the newest merged rows and the changes after them."""

    spark: SparkSession
    root: str
    schema: StructType
    merge: Callable[[DataFrame], DataFrame]

    def _part(self, kind: str) -> DataFrame:
        return _read(self.spark, f"{self.root}/{kind}", StructType([*self.schema.fields]).add("batch", "long"))

    def before(self, number: int) -> DataFrame:
        """All rows of batches below ``number``, merged."""
        merged = self._part("merged").filter(F.col("batch") < number)
        base = merged.agg(F.max("batch")).first()[0]
        rows = self._part("changes").filter((F.col("batch") < number) & (F.col("batch") > (-1 if base is None else base)))
        if base is not None:
            rows = rows.unionByName(merged.filter(F.col("batch") == base))
        return self.merge(rows)

    def write(self, rows: DataFrame, number: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/changes/batch={number}")
        if number % MERGE_EVERY == MERGE_EVERY - 1:
            self.before(number + 1).select(*self.schema.names).write.mode("overwrite").parquet(
                f"{self.root}/merged/batch={number}")


BITS_PER_BITMAP = 32_768
HASHES = 3


@dataclass(frozen=True)
class SeenKeys:
    """Which keys earlier batches have taken, for ever, in ``ranges`` ranges of their hash.

    A Bloom filter of ``bitmaps`` x 32,768 bits, one row per touched bitmap, answers first: keys that it does not know
    are new, and only the hash ranges of the others are read and joined. Keys are SHA-256 values, so equal keys are
    equal rows. The filter's size should be some ten bits per expected key; a full one only makes more keys be looked up.
    """

    spark: SparkSession
    root: str
    ranges: int = 64
    bitmaps: int = 1024

    def _filter(self) -> Changes:
        kinds = StructType().add("number", "long").add("bits", "binary")
        return Changes(self.spark, f"{self.root}/filter", kinds, lambda rows: rows.groupBy("number").agg(
            F.bitmap_or_agg("bits").alias("bits")))

    def _places(self, key: Column) -> Column:
        bits = F.lit(self.bitmaps * BITS_PER_BITMAP)
        return F.explode(F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), bits) for i in range(HASHES)]))

    def _range(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.ranges)).cast("int")

    def known(self, keys: DataFrame, number: int) -> DataFrame:
        """Those of ``keys(key)``, which are distinct, that batches below ``number`` took."""
        place = keys.withColumn("place", self._places(F.col("key"))).select(
            "key", F.floor(F.col("place") / BITS_PER_BITMAP).alias("number"), (F.col("place") % BITS_PER_BITMAP).alias("bit"))
        byte = F.expr("conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10)").cast("int")
        hit = F.expr("shiftright(byte, cast(bit % 8 as int)) & 1") == 1
        maybe = place.join(self._filter().before(number), "number").withColumn("byte", byte).filter(hit).groupBy(
            "key").count().filter(F.col("count") == HASHES).select("key", self._range(F.col("key")).alias("range"))
        maybe = cut_lineage(maybe)
        ranges = sorted(r[0] for r in maybe.select("range").distinct().collect())  # at most ``ranges`` small numbers
        table = _read(self.spark, f"{self.root}/keys", StructType().add("key", "binary").add("range", "integer").add("batch", "long"))
        stored = table.filter(F.col("range").isin(ranges) & (F.col("batch") < number)).select("key", "range")
        return maybe.join(stored, ["key", "range"], "left_semi").select("key")

    def take(self, keys: DataFrame, number: int) -> None:
        """Remember ``keys(key)`` as taken by batch ``number``."""
        placed = keys.select("key", self._range(F.col("key")).alias("range"), F.lit(number).cast("long").alias("batch"))
        placed.repartition("range").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "range", "batch").parquet(f"{self.root}/keys")
        place = keys.select(self._places(F.col("key")).alias("place"))
        bits = place.groupBy(F.floor(F.col("place") / BITS_PER_BITMAP).alias("number")).agg(
            F.bitmap_construct_agg(F.col("place") % BITS_PER_BITMAP).alias("bits"))
        self._filter().write(bits, number)
