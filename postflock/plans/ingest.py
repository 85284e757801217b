"""Raw rows to users, posts, tags and links; new posts; deletions; follows; profile updates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from postflock.functions import text as tx, time as tm
from postflock.operators.lexicon import score_texts
from postflock.operators.ranking import first_wins
from postflock.session import stored

OK, SHORT, MISSING, DUPLICATE = "ok", "short_row", "missing_field", "duplicate"
# The limits of a profile and the bio given to loaded users.
MIN_USERNAME, MAX_USERNAME, MAX_BIO = 2, 64, 160
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
LOADED_BIO = "Training data user"


@dataclass(frozen=True)
class Ingested:
    """Frames of one load. ``rows`` keeps every input row with its status."""

    rows: DataFrame
    users: DataFrame
    posts: DataFrame
    tags: DataFrame
    post_tags: DataFrame
    rejects: DataFrame
    metrics: DataFrame


def prepare(raw: DataFrame, as_of: Column) -> DataFrame:
    """Clean and parse raw rows ``(row_no, sentiment, time_text, username, text)`` and, where
    given, ``short``; adds a status that does not look at other rows yet."""
    short = F.col("short") if "short" in raw.columns else F.lit(False)
    score = tx.safe_double(F.trim("sentiment"))
    # Cleaning is the costly part: it is done in a step of its own, so that the status looks at cleaned columns.
    clean = raw.select(
        "row_no", tx.clean_text(F.col("username")).alias("username"), tx.clean_text(F.col("text")).alias("text"),
        tm.parse_raw_time(F.trim("time_text"), as_of).alias("ts"),
        score.alias("sentiment_score"), tx.sign_label(score).alias("sentiment_label"), short.alias("_short"),
    )
    filled = (F.length("username") > 0) & (F.length("text") > 0)
    return clean.withColumn("status", F.when(F.col("_short"), SHORT).when(filled, OK).otherwise(MISSING)).drop("_short")


def _classified(raw: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Every row with its final status, and the narrow columns of the good ones, duplicates included. Rows are cleaned
    once and stored; repeats are found on a digest of the text, and only the numbers of repeats meet the texts again."""
    rows = stored(prepare(raw, as_of).withColumn("_digest", F.unhex(F.sha2("text", 256))), "ingest-rows")
    good = rows.filter(F.col("status") == OK).select("row_no", "username", "ts", "_digest")
    winners = good.groupBy("username", "_digest").agg(F.min("row_no").alias("row_no"))
    repeats = good.select("row_no").join(winners.select("row_no"), "row_no", "left_anti").distinct()
    repeats = stored(repeats.select(F.col("row_no").alias("_row"), F.lit(True).alias("_repeat")), "ingest-repeats")
    status = F.when((F.col("status") == OK) & F.col("_repeat"), DUPLICATE).otherwise(F.col("status"))
    rows = rows.drop("_digest").join(repeats, F.col("row_no").eqNullSafe(F.col("_row")), "left")
    return rows.withColumn("status", status).drop("_row", "_repeat"), good.drop("_digest")


def classify(raw: DataFrame, as_of: Column) -> DataFrame:
    """Every row with its final status; the first row of a (username, text) wins."""
    return _classified(raw, as_of)[0]


def ingest(raw: DataFrame, as_of: Column) -> Ingested:
    """Set-based load. ``post_id`` is the row number of the winning row, ``user_id`` that of the
    user's first good row, so ids need no counter shared between tasks. Rows and users are stored once; the frames
    are read from there."""
    rows, good = _classified(raw, as_of)
    users = stored(first_wins(good, ["username"], "row_no").select(
        F.col("row_no").alias("user_id"), "username", tx.synthetic_email(F.col("username")).alias("email"),
        F.lit(LOADED_BIO).alias("bio"), F.col("ts").alias("member_since"),
    ), "ingest-users")
    posts = (
        rows.filter(F.col("status") == OK).join(users.select("user_id", "username"), "username")
        .select(
            F.col("row_no").alias("post_id"), "user_id", "text", "ts", "sentiment_score", "sentiment_label"
        )
    )
    links = link_tags(posts)
    return Ingested(
        rows=rows, users=users, posts=posts, tags=tag_table(links, posts), post_tags=links,
        rejects=rows.filter(F.col("status") != OK), metrics=metrics(rows),
    )


def link_tags(posts: DataFrame) -> DataFrame:
    return posts.select("post_id", F.explode(tx.tag_set(F.col("text"))).alias("tag"))


def tag_table(links: DataFrame, posts: DataFrame) -> DataFrame:
    return (
        links.join(posts.select("post_id", "ts"), "post_id").groupBy("tag")
        .agg(F.count(F.lit(1)).alias("posts"), F.max("ts").alias("last_updated"))
    )


def metrics(rows: DataFrame) -> DataFrame:
    """processed, duplicates, errors and success rate in percent (NULL for no rows)."""
    status = F.col("status")
    counts = rows.agg(
        F.count_if(status == OK).alias("processed"),
        F.count_if(status == DUPLICATE).alias("duplicates"),
        F.count_if(status.isin(SHORT, MISSING)).alias("errors"),
        F.count(F.lit(1)).alias("_all"),
    )
    rate = F.when(F.col("_all") > 0, F.col("processed") / F.col("_all") * 100)
    return counts.withColumn("success_rate", rate).drop("_all")


def post_validity(posts: DataFrame) -> DataFrame:
    length = F.length(F.coalesce("text", F.lit("")))
    reason = F.when(length == 0, "empty").when(length > tx.MAX_POST_CHARS, "too_long").otherwise("ok")
    return posts.withColumn("reason", reason)


def new_posts(posts: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid new posts scored, their tag links, and the refused ones with a reason."""
    checked = post_validity(posts)
    valid = score_texts(checked.filter(F.col("reason") == "ok").drop("reason"), lexicon)
    return valid, link_tags(valid), checked.filter(F.col("reason") != "ok")


def delete_posts(posts: DataFrame, requests: DataFrame) -> DataFrame:
    """Posts left after requests ``(post_id, user_id)``; only the owner's request counts."""
    return posts.join(requests.select("post_id", "user_id"), ["post_id", "user_id"], "left_anti")


def follow(follows: DataFrame, requests: DataFrame, users: DataFrame) -> DataFrame:
    """Follows after requests: none of oneself, only known users, each edge once."""
    known = users.select("user_id")
    wanted = (
        requests.filter(F.col("follower_id") != F.col("followee_id"))
        .join(known.withColumnRenamed("user_id", "follower_id"), "follower_id", "left_semi")
        .join(known.withColumnRenamed("user_id", "followee_id"), "followee_id", "left_semi")
    )
    edge = ["follower_id", "followee_id"]
    return follows.select(*edge).unionByName(wanted.select(*edge)).distinct()


def unfollow(follows: DataFrame, requests: DataFrame) -> DataFrame:
    edge = ["follower_id", "followee_id"]
    return follows.join(requests.select(*edge), edge, "left_anti")


def update_profiles(users: DataFrame, updates: DataFrame) -> DataFrame:
    """Users with the non-NULL fields of ``updates(user_id, username, email, bio)`` applied. An
    update that asks for another user's name or email is refused whole."""
    asked = updates.select("user_id", "username", "email", "bio")

    def taken(field: str) -> DataFrame:
        owner = users.select(F.col("user_id").alias("_owner"), field)
        return asked.join(owner, field).filter(F.col("_owner") != F.col("user_id")).select("user_id")

    free = asked.join(taken("username").unionByName(taken("email")), "user_id", "left_anti")
    fields = [c for c in ("username", "email", "bio")]
    renamed = free.select("user_id", *[F.col(c).alias(f"_{c}") for c in fields])
    merged = users.join(renamed, "user_id", "left")
    return merged.select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in users.columns]
    )


def user_quality(users: DataFrame) -> DataFrame:
    """One flag per profile rule."""

    def repeated(field: str) -> DataFrame:
        counted = users.groupBy(field).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        return counted.select(field, F.lit(True).alias(f"_{field}"))

    name_ok = F.length("username").between(MIN_USERNAME, MAX_USERNAME)
    return (
        users.join(repeated("username"), "username", "left").join(repeated("email"), "email", "left")
        .select(
            "user_id",
            F.coalesce(name_ok, F.lit(False)).alias("username_ok"),
            F.coalesce(F.col("email").rlike(EMAIL), F.lit(False)).alias("email_ok"),
            (F.length(F.coalesce("bio", F.lit(""))) <= MAX_BIO).alias("bio_ok"),
            F.col("_username").isNull().alias("username_unique"),
            F.col("_email").isNull().alias("email_unique"),
        )
    )
