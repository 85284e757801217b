"""Temporal list join: every capture of a page is judged by the list entries in force when it was fetched.

Dated entries (key, listed_at, blocked, category) become validity intervals: an entry holds until the next one
of its key. A capture asks for every suffix of its host and for its host with the first path segment, and an
as-of join finds the entry of each key that held at the time. The join is one sorted pass over captures and
entries of a key. Captures are counted per key first: a key with too many for one task is dealt over as many salts as
its count needs, with its entries repeated in each, so that a host with a third of all captures is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postflock.llm.common import stored

TASK_ROWS = 200_000
HOT_KEYS = 10_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def keys(url: Column) -> Column:
    """What an entry for this URL can be filed under: host suffixes of two labels or more, host/segment."""
    labels = F.split(host(url), r"\.")
    count = F.size(labels)
    suffixes = F.transform(
        F.when(count >= 2, F.sequence(F.lit(1), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.array_join(F.slice(labels, i, count), "."))
    segment = F.regexp_extract(url, SEGMENT, 1)
    page = F.when((host(url) != "") & (segment != ""), F.array(F.concat_ws("/", host(url), segment)))
    return F.array_distinct(F.concat(suffixes, F.coalesce(page, F.array().cast("array<string>"))))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, valid_from, valid_to, blocked, category), half-open; valid_to is null for the last of a key. Of
    entries of one key and time the blocking one counts, then the least category. Entries without key or time
    are left out; repeated ones count once."""
    order = F.struct((~F.col("blocked")).alias("open"), "category")
    one = (
        entries.filter("key is not null and listed_at is not null and blocked is not null")
        .groupBy("key", "listed_at").agg(F.min(order).alias("e"))
    )
    by_key = Window.partitionBy("key").orderBy("listed_at")
    return one.select(
        "key", F.col("listed_at").alias("valid_from"), F.lead("listed_at").over(by_key).alias("valid_to"),
        (~F.col("e.open")).alias("blocked"), F.col("e.category").alias("category"))


def _hot(asked: DataFrame, task_rows: int) -> DataFrame:
    """(key, salts) of the keys with more captures than a task shall sort, at most HOT_KEYS of them: where more keys
    than that exceeded ``task_rows``, the tasks are larger instead, still no more than a 10,000th of all rows."""
    most = max(task_rows, -(-asked.count() // HOT_KEYS))
    return asked.groupBy("key").count().filter(F.col("count") > most).select(
        "key", F.ceil(F.col("count") / most).cast("int").alias("salts"))


def as_of(captures: DataFrame, entries: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """captures (page_id, url, fetched_at) with ``rejected``, and key, category, valid_from and valid_to of the
    longest blocking entry in force (null if none). One row per row of captures; a null url or time, or a host
    without two labels, is not rejected. Row numbers are stored before the join reads them twice."""
    rows = stored(captures.select("page_id", "url", "fetched_at").withColumn("row", F.monotonically_increasing_id()),
                  "url_lists-rows")
    every = rows.select(
        "row", F.col("fetched_at").alias("at"), F.explode(keys(F.coalesce("url", F.lit("")))).alias("key"),
    ).filter("at is not null")
    hot = F.broadcast(stored(_hot(every, task_rows), "url_lists-hot"))
    salts = F.coalesce("salts", F.lit(1))
    asked = every.join(hot, "key", "left").select(
        "row", "at", "key", F.pmod(F.xxhash64("row"), salts).cast("int").alias("salt"))
    held = intervals(entries)
    entry = F.struct("valid_from", "valid_to", "blocked", "category")
    filed = held.join(hot, "key", "left").select(
        F.lit(None).cast("long").alias("row"), F.col("valid_from").alias("at"), "key",
        F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), entry.alias("entry"))
    both = asked.withColumn("entry", F.lit(None).cast(filed.schema["entry"].dataType)).unionByName(filed)
    up_to = Window.partitionBy("key", "salt").orderBy("at", F.col("row").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = (
        both.withColumn("entry", F.last("entry", ignorenulls=True).over(up_to))
        .filter("row is not null and entry.blocked")
        .groupBy("row").agg(F.max(F.struct(F.length("key").alias("n"), "key", "entry")).alias("m"))
    )
    return rows.join(found, "row", "left").select(
        "page_id", "url", "fetched_at", F.col("m").isNotNull().alias("rejected"), F.col("m.key").alias("key"),
        F.col("m.entry.category").alias("category"), F.col("m.entry.valid_from").alias("valid_from"),
        F.col("m.entry.valid_to").alias("valid_to"))


FIRST_DAY = 1_700_000_000
DAYS = 730
CATEGORIES = ("adult", "malware", "phishing", "spam")


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a time of fetching in seconds, drawn from the id: the tables hold none."""
    at = FIRST_DAY + _number(F.concat(F.lit("fetch:"), F.col("page_id").cast("string"))) % (DAYS * 86400)
    return pages.select("page_id", "url", at.alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list drawn from the pages' own keys: up to three entries for each, blocking or lifting."""
    key = pages.filter("url is not null").select(F.explode(keys(F.col("url"))).alias("key")).distinct()
    drawn = key.filter(_number(F.concat(F.lit("listed:"), F.col("key"))) % 10 < 3).select(
        "key", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    draw = _number(F.concat_ws("#", "key", F.col("n").cast("string")))
    return drawn.withColumn("d", draw).select(
        "key", (FIRST_DAY + F.col("d") % DAYS * 86400).alias("listed_at"),
        (F.col("d") % 5 < 3).alias("blocked"),
        F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("d") % 4 + 1).cast("int")).alias("category"))


_KEYS_SQL = rf"""
  list_distinct(list_concat(
    list_transform(range(1, greatest(len(labels), 1)), lambda i: array_to_string(labels[i:], '.')),
    CASE WHEN host <> '' AND segment <> '' THEN [host || '/' || segment] ELSE [] END))"""
SQL = rf"""
WITH parsed AS (
  SELECT page_id, url, segment, host, string_split(host, '.') AS labels FROM (
    SELECT page_id, url, lower(regexp_extract(url, '{HOST}', 1)) AS host,
      regexp_extract(url, '{SEGMENT}', 1) AS segment FROM pages)),
asked AS (
  SELECT row_number() OVER () AS row, page_id, url, {_KEYS_SQL} AS keys,
    {FIRST_DAY} + CAST('0x' || substr(md5('fetch:' || page_id), 1, 7) AS BIGINT) % {DAYS * 86400} AS fetched_at
  FROM parsed),
listed AS (
  SELECT key, CAST('0x' || substr(md5(key || '#' || n), 1, 7) AS BIGINT) AS d
  FROM (SELECT DISTINCT unnest(keys) AS key FROM asked), range(1, 4) t(n)
  WHERE CAST('0x' || substr(md5('listed:' || key), 1, 7) AS BIGINT) % 10 < 3),
entries AS (
  SELECT key, {FIRST_DAY} + d % {DAYS} * 86400 AS listed_at, d % 5 < 3 AS blocked,
    [{", ".join(f"'{c}'" for c in CATEGORIES)}][d % 4 + 1] AS category FROM listed),
held AS (
  SELECT key, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY key ORDER BY listed_at) AS valid_to,
    blocked, category
  FROM (SELECT * FROM entries QUALIFY row_number() OVER (
    PARTITION BY key, listed_at ORDER BY blocked DESC, category) = 1)),
hits AS (
  SELECT a.row, h.* FROM (SELECT row, fetched_at, unnest(keys) AS key FROM asked) a JOIN held h
    ON a.key = h.key AND h.blocked AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)
  QUALIFY row_number() OVER (PARTITION BY a.row ORDER BY length(h.key) DESC, h.key DESC) = 1)
SELECT page_id, url, fetched_at, h.key IS NOT NULL AS rejected, coalesce(h.key, '') AS key,
  coalesce(category, '') AS category, coalesce(valid_from, 0) AS valid_from, coalesce(valid_to, 0) AS valid_to
FROM asked LEFT JOIN hits h USING (row)"""


def digest(pages: DataFrame) -> DataFrame:
    """One row per page; '' and 0 stand for what ``as_of`` leaves null."""
    found = as_of(captures_of(pages), entries_of(pages))
    return found.fillna("", ["key", "category"]).fillna(0, ["valid_from", "valid_to"])
