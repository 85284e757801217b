"""Stored tables that prune and change in place: posts by day, people by shards, links by buckets.

A change rewrites the partitions it touches and no other file. Every change is a function of the table and the request
that gives the same table when it is applied again, so a run that failed half way is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from postflock.functions import time as tm
from postflock.plans import ingest as ig
from postflock.session import cut_lineage

SHARDS = 64
BUCKETS = 64


def day_of(row_time: str = "ts") -> Column:
    return F.to_date(row_time)


def shard_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int")


@dataclass(frozen=True)
class PartitionedTable:
    """Rows of ``schema`` under ``path``, partitioned by the column ``part``, which ``place`` makes from a row."""

    spark: SparkSession
    path: str
    schema: StructType
    part: str
    place: Callable[[], Column]

    def _placed(self, rows: DataFrame) -> DataFrame:
        # A rebalance lets Spark split a full partition over tasks and put thin ones together.
        placed = rows.select(*self.schema.names).withColumn(self.part, self.place())
        return placed.hint("rebalance", self.part)

    def create(self, rows: DataFrame) -> PartitionedTable:
        self._placed(rows).write.partitionBy(self.part).parquet(self.path)
        return self

    def read(self) -> DataFrame:
        """All rows, with the partition column, so that filters on it keep whole folders from being listed or read."""
        return self.spark.read.parquet(self.path)

    def rows(self) -> DataFrame:
        return self.read().select(*self.schema.names)

    def _parts(self, rows: DataFrame) -> list:
        """The partitions that rows lie in: at most as many as the table has folders."""
        return [r[0] for r in rows.select(self.part).distinct().collect()]

    def change(self, touched: DataFrame, edit: Callable[[DataFrame], DataFrame]) -> list:
        """Replace the rows of the partitions in ``touched`` by ``edit`` of them; the partitions are returned. The new
        rows must lie in those partitions. They are stored aside first, as their partitions are read to make them."""
        parts = self._parts(touched.select(self.part))
        if not parts:
            return []
        here = self.read().filter(F.col(self.part).isin(parts)).select(*self.schema.names)
        after = cut_lineage(edit(here).select(*self.schema.names).withColumn(self.part, self.place()))
        left = self._parts(after)
        if outside := set(left) - set(parts):
            raise ValueError(f"rows left their partitions: {sorted(map(str, outside))[:5]}")
        after.hint("rebalance", self.part).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(self.part).parquet(self.path)
        for gone in set(parts) - set(left):
            after.limit(0).drop(self.part).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{self.part}={gone}")
        return parts


def posts_by_day(spark: SparkSession, path: str, schema: StructType) -> PartitionedTable:
    return PartitionedTable(spark, path, schema, "day", day_of)


def by_shard(spark: SparkSession, path: str, schema: StructType, key: str) -> PartitionedTable:
    return PartitionedTable(spark, path, schema, "shard", lambda: shard_of(key))


def last_hours(table: PartitionedTable, as_of: Column, hours: int = 24) -> DataFrame:
    """Rows of the last hours of a table by day: only the days in question are read."""
    since = tm.hours_before(as_of, hours)
    return table.read().filter((F.col("day") >= F.to_date(since)) & (F.col("ts") >= since)).select(*table.schema.names)


def add_posts(table: PartitionedTable, posts: DataFrame) -> list:
    """Add posts whose id their day does not have yet; a repeat within ``posts`` counts once."""
    new = cut_lineage(posts.select(*table.schema.names).dropDuplicates(["post_id"]).withColumn("day", day_of()))
    return table.change(new, lambda here: here.unionByName(
        new.drop("day").join(here.select("post_id"), "post_id", "left_anti")))


def remove_posts(table: PartitionedTable, requests: DataFrame) -> list:
    """Remove posts asked for by ``requests(post_id, user_id)``, if the asking user owns them."""
    owned = table.read().join(requests.select("post_id", "user_id"), ["post_id", "user_id"], "left_semi")
    return table.change(owned, lambda here: ig.delete_posts(here, requests))


def add_follows(table: PartitionedTable, requests: DataFrame, users: DataFrame) -> list:
    """Add the valid ones of ``requests(follower_id, followee_id)``."""
    none = table.rows().limit(0)
    new = cut_lineage(ig.follow(none, requests, users))
    return table.change(new.withColumn("shard", shard_of("follower_id")), lambda here: here.unionByName(new).distinct())


def remove_follows(table: PartitionedTable, requests: DataFrame) -> list:
    edge = ["follower_id", "followee_id"]
    found = table.read().join(requests.select(*edge), edge, "left_semi")
    return table.change(found, lambda here: ig.unfollow(here, requests))


def update_profiles(table: PartitionedTable, updates: DataFrame) -> list:
    """Apply profile updates. Names and emails are held against all users, but only the shards of changed users are
    written."""
    everyone = table.rows()
    asked = everyone.join(updates.select("user_id"), "user_id", "left_semi")
    changed = cut_lineage(ig.update_profiles(everyone, updates).join(updates.select("user_id"), "user_id", "left_semi")
                          .exceptAll(asked))
    return table.change(changed.withColumn("shard", shard_of("user_id")), lambda here: here.join(
        changed.select("user_id"), "user_id", "left_anti").unionByName(changed.select(*here.columns)))


def store_bucketed(rows: DataFrame, table: str, path: str, key: str = "post_id", buckets: int = BUCKETS) -> DataFrame:
    """Store rows as a table in buckets of ``key``, sorted: two tables in as many buckets of the same key are joined
    without moving a row."""
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)
