"""Registration of queries and the SQL views their checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postflock.sources.social import SocialTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"


def clean_sql(value: str) -> str:
    trimmed = f"regexp_replace(coalesce({value}, ''), '^{SPACE}+|{SPACE}+$', '', 'g')"
    return f"regexp_replace(trim({trimmed}, '\"'), '{SPACE}+', ' ', 'g')"


VIEWS = rf"""
people AS (SELECT max(user_id) + 1 AS u, count(*) AS n FROM events),
users AS (
  SELECT c_custkey AS user_id, c_name AS username,
    lower(replace(c_name, '#', '')) || '@example.com' AS email, c_mktsegment AS bio
  FROM customer),
posts AS MATERIALIZED (
  SELECT event_id AS post_id, user_id, ts,
    '#' || upper(event_type) || ' #k' || regexp_extract(props, '"k": ([0-9]+)', 1)
      || ' #v' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS text,
    greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 50)) AS sentiment_score,
    CASE WHEN (value - 50) / 50 > 0.3::DOUBLE THEN 'positive'
         WHEN (value - 50) / 50 < -0.3::DOUBLE THEN 'negative' ELSE 'neutral' END AS sentiment_label
  FROM events),
latest AS (SELECT max(ts) AS t FROM events),
post_tags AS MATERIALIZED (
  SELECT DISTINCT post_id, user_id, ts, lower(tag) AS tag
  FROM (SELECT post_id, user_id, ts, unnest(regexp_extract_all(text, '#({WORD}+)', 1)) AS tag FROM posts)),
follows AS MATERIALIZED (
  SELECT DISTINCT o_custkey % u AS follower_id, o_orderkey * 31 % u AS followee_id
  FROM orders, people
  WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_custkey % u <> o_orderkey * 31 % u),
reactions AS (
  SELECT l_suppkey AS user_id, l_orderkey % n AS post_id,
    CASE WHEN l_returnflag = 'R' THEN 'retweet' ELSE 'like' END AS kind
  FROM lineitem, people WHERE l_linenumber = 1 AND l_returnflag IN ('R', 'A')),
text_posts AS MATERIALIZED (
  SELECT doc_id AS post_id, source || '_' || lang AS author, text, ts
  FROM documents JOIN events ON doc_id = event_id),
scored_text_posts AS (
  SELECT t.*, CAST(quality - toxic AS DOUBLE) AS sentiment_score,
    CASE WHEN quality - toxic > 0 THEN 'positive' WHEN quality - toxic < 0 THEN 'negative'
         WHEN quality - toxic = 0 THEN 'neutral' END AS sentiment_label
  FROM text_posts t LEFT JOIN labels ON doc_id = post_id),
raw_clean AS (
  SELECT *, length(username) > 0 AND length(text) > 0 AS filled,
    CASE WHEN sentiment_score > 0 THEN 'positive' WHEN sentiment_score < 0 THEN 'negative' ELSE 'neutral' END AS sentiment_label
  FROM (SELECT post_id AS row_no, {clean_sql('author')} AS username, {clean_sql('text')} AS text,
    date_trunc('second', ts) AS ts, coalesce(sentiment_score, 0) AS sentiment_score FROM scored_text_posts)),
usage AS (SELECT tag, count(*) AS posts FROM post_tags GROUP BY tag),
cooc AS MATERIALIZED (
  SELECT a.tag, b.tag AS other, count(*) AS n
  FROM post_tags a JOIN post_tags b USING (post_id) WHERE a.tag <> b.tag GROUP BY 1, 2),
user_tags AS MATERIALIZED (SELECT user_id, tag, count(*) AS n FROM post_tags GROUP BY 1, 2),
newest AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, post_id DESC) AS rn FROM posts)
"""


def entry(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` is a query over VIEWS."""

    def register(fn: Callable[[SocialTables], DataFrame]):
        QUERIES[name] = lambda spark, path: fn(SocialTables(spark, path))
        if sql is not None:
            SQL[name] = f"WITH {VIEWS.strip()}\nSELECT * FROM (\n{sql.strip()}\n)"
        return fn

    return register


def r6(value: Column | str, name: str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return (F.round(column, 6) + F.lit(0.0)).alias(name)


def stamp(value: Column | str, name: str) -> Column:
    """Time as text, so that both engines return the same value whatever the client's zone."""
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def joined(value: Column | str, name: str) -> Column:
    return F.array_join(value, " ").alias(name)


def q6(value: str) -> str:
    return f"(round({value}, 6) + 0::DOUBLE)"


def qstamp(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S.%f')"


def lng(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("long")
