"""Declared schemas of the social model and of saved documents."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, LongType, MapType, StringType, StructField, StructType,
    TimestampType,
)

_T = {
    "long": LongType(), "string": StringType(), "double": DoubleType(),
    "timestamp": TimestampType(), "boolean": BooleanType(),
}


def _struct(spec: str) -> StructType:
    fields = (item.split() for item in spec.split(","))
    return StructType([StructField(name, _T[kind]) for name, kind in fields])


USERS = _struct("user_id long, username string, email string, bio string, "
                "member_since timestamp, last_seen timestamp")
POSTS = _struct("post_id long, user_id long, text string, ts timestamp, "
                "sentiment_score double, sentiment_label string, is_quick boolean")
NEW_POSTS = _struct("post_id long, user_id long, text string, ts timestamp")
TAGS = _struct("tag string, posts long, trend_score double, last_updated timestamp")
POST_TAGS = _struct("post_id long, tag string")
FOLLOWS = _struct("follower_id long, followee_id long, ts timestamp")
REACTIONS = _struct("user_id long, post_id long, kind string")
LEXICON = _struct("word string, polarity double, intensity double, is_negation boolean")

RAW_COLUMNS = 12
RAW_POSTS = StructType([StructField(f"c{i}", StringType()) for i in range(RAW_COLUMNS)])

CLUSTER_ENTRY = StructType([
    StructField("size", LongType()),
    StructField("usernames", ArrayType(StringType())),
    StructField("avg_sentiment", DoubleType()),
    StructField("top_keywords", ArrayType(StringType())),
    StructField("top_hashtags", ArrayType(StringType())),
    StructField("user_ids", ArrayType(LongType())),
])
ANALYSIS = StructType([
    StructField("method", StringType()),
    StructField("n_clusters", LongType()),
    StructField("quality_metric", StringType()),
    StructField("visualization_path", StringType()),
    StructField("user_count", LongType()),
    StructField("timestamp", StringType()),
    StructField("cluster_analysis", MapType(StringType(), CLUSTER_ENTRY)),
])
