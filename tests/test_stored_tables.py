"""Stored tables: what a question reads, and what a change writes."""

import glob
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postflock.plans import tags as tg
from postflock.sources import partitioned as pt

NOW = datetime(2024, 3, 10, 12)
POST = "post_id long, user_id long, ts timestamp, text string"


def _posts(spark, ids=range(200)):
    return spark.createDataFrame([(i, i % 7, NOW - timedelta(hours=3 * i), f"#t{i % 5} post {i}") for i in ids], POST)


@pytest.fixture
def table(spark, tmp_path):
    posts = _posts(spark)
    return pt.posts_by_day(spark, f"{tmp_path}/posts", posts.schema).create(posts)


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*=*/*.parquet")}


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_a_day_reads_a_day(spark, table):
    recent = pt.last_hours(table, F.lit(NOW))
    assert sorted(r.post_id for r in recent.collect()) == list(range(9))
    line = next(x for x in _plan(recent).splitlines() if "PartitionFilters" in x)
    assert "day" in line.split("PartitionFilters: [")[1].split("]")[0]


def test_trending_prunes_too(spark, tmp_path):
    links = _posts(spark).select("post_id", "user_id", "ts", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("tag"))
    stored = pt.posts_by_day(spark, f"{tmp_path}/links", links.schema).create(links)
    as_of = stored.read().agg(F.max("ts")).scalar()
    found = tg.trending(pt.last_hours(stored, as_of), as_of)
    assert [tuple(r) for r in found.collect()] == [("a", 9), ("b", 9)]
    assert any("PartitionFilters" in x and "day" in x.split("PartitionFilters")[1] for x in _plan(found).splitlines())


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    posts = pt.store_bucketed(_posts(spark), "b_posts", f"{tmp_path}/p", buckets=8)
    links = pt.store_bucketed(_posts(spark).select("post_id", F.lit("x").alias("tag")), "b_links", f"{tmp_path}/l", buckets=8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = links.join(posts, "post_id")
        assert joined.count() == 200
        assert "SortMergeJoin" in _plan(joined) and "Exchange" not in _plan(joined).split("== Physical Plan ==")[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE b_posts")
        spark.sql("DROP TABLE b_links")


def test_a_delete_writes_its_days_only(spark, table):
    before = _files(table.path)
    requests = spark.createDataFrame([(3, 3), (4, 0), (199, 199 % 7), (100, 100 % 7)], "post_id long, user_id long")
    days = pt.remove_posts(table, requests)
    left = {r.post_id for r in table.rows().collect()}
    assert left == set(range(200)) - {3, 199, 100}
    after = _files(table.path)
    touched = {f"day={d}" for d in days}
    assert len(touched) == 3
    for name, time in before.items():
        assert after.get(name) == time or any(t in name for t in touched)
    assert pt.remove_posts(table, requests) == [] and _files(table.path) == after


def test_an_emptied_day_stays_empty(spark, table):
    day = [(r.post_id, r.user_id) for r in table.read().filter("day = '2024-03-08'").collect()]
    pt.remove_posts(table, spark.createDataFrame(day, "post_id long, user_id long"))
    assert {r.post_id for r in table.rows().collect()} == set(range(200)) - {d[0] for d in day}


def test_posts_are_added_once(spark, table):
    before = _files(table.path)
    new = _posts(spark, [5, 5, 1000 // 50, 700, 701])
    for _ in range(2):
        pt.add_posts(table, new)
    assert sorted(r.post_id for r in table.rows().collect()) == [*range(200), 700, 701]
    assert len(set(before) - set(_files(table.path))) <= 4


def test_rows_may_not_leave_their_partitions(spark, table):
    with pytest.raises(ValueError, match="left their partitions"):
        table.change(table.read().filter("post_id = 1"), lambda here: here.withColumn("ts", F.lit(NOW + timedelta(days=9))))


def test_follows_and_profiles_change_few_shards(spark, tmp_path):
    users = spark.createDataFrame([(i, f"u{i}", f"u{i}@x.org", "b") for i in range(300)], "user_id long, username string, email string, bio string")
    follows = spark.createDataFrame([(i, i + 1) for i in range(299)], "follower_id long, followee_id long")
    edges = pt.by_shard(spark, f"{tmp_path}/f", follows.schema, "follower_id").create(follows)
    people = pt.by_shard(spark, f"{tmp_path}/u", users.schema, "user_id").create(users)
    files = _files(edges.path)
    asked = spark.createDataFrame([(7, 9), (7, 9), (8, 8), (7, 999)], "follower_id long, followee_id long")
    for _ in range(2):
        pt.add_follows(edges, asked, users)
    gone = spark.createDataFrame([(20, 21), (20, 25)], "follower_id long, followee_id long")
    for _ in range(2):
        pt.remove_follows(edges, gone)
    expected = ({(i, i + 1) for i in range(299)} | {(7, 9)}) - {(20, 21)}
    assert {tuple(r) for r in edges.rows().collect()} == expected and edges.rows().count() == len(expected)
    assert len(set(files) - set(_files(edges.path))) <= 2
    files = _files(people.path)
    updates = spark.createDataFrame([(5, "new", None, None), (6, "u7", None, "x"), (9, None, None, "bio")], "user_id long, username string, email string, bio string")
    for _ in range(2):
        pt.update_profiles(people, updates)
    rows = {r.user_id: tuple(r)[1:] for r in people.rows().collect()}
    assert len(rows) == 300 and rows[5][0] == "new" and rows[6] == ("u6", "u6@x.org", "b") and rows[9][2] == "bio"
    assert len(set(files) - set(_files(people.path))) <= 2


def test_an_arrival_is_written_by_several_tasks_and_makes_one_batch(spark):
    from types import SimpleNamespace

    from postflock.catalog import streams

    posts = spark.range(0, 5000, 1, 3).filter("id % 10 <> 0").select(
        F.col("id").alias("post_id"), F.lit("#a").alias("text"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"))
    root, stream = streams._arrivals(SimpleNamespace(spark=spark), posts, file_rows=200)
    files = spark.read.parquet(f"{root}/in").groupBy(F.input_file_name()).count().collect()
    assert len(files) % streams.FILES == 0 and len(files) > streams.FILES
    sizes = {}
    stream.writeStream.foreachBatch(lambda batch, number: sizes.update({number: batch.agg(F.min("ts"), F.count("ts")).first()})).option(
        "checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    assert len(sizes) == streams.FILES
    assert sum(found[1] for found in sizes.values()) == sum(1 + (i % 7 == 0) for i in range(5000) if i % 10)
    assert [sizes[i][0] for i in range(streams.FILES)] == sorted(found[0] for found in sizes.values())
