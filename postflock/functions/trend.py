"""Trend score expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def damped_score(posts: Column, recency: Column, last_updated: Column) -> Column:
    """ln(posts + 1) times recency; 0 for a tag without posts or date."""
    usable = (posts > 0) & last_updated.isNotNull()
    return F.when(usable, F.log1p(posts) * recency).otherwise(0.0)


def product_score(posts: Column, recency: Column, trend_score: Column) -> Column:
    return posts * recency * trend_score


def label_share(count: Column, total: Column) -> Column:
    return count / F.greatest(total, F.lit(1))
