"""Exact quantile with linear interpolation that never gathers the column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ACCURACY = 10_000
#: So many rows, at most, are sorted in one task for the exact pick.
SORTED_ROWS = 100_000


def value_at(df: DataFrame, column: str, place: int, sorted_rows: int = SORTED_ROWS) -> float | None:
    """The value that ``place`` others precede in sorted order.

    The values in question are narrowed until at most ``sorted_rows`` are left: a mergeable sketch brackets the place,
    one pass counts what lies below, on and above the two ends of the bracket, and the ends, where frequent values come
    to stand, are taken out. A round leaves less than a thousandth, so rounds are few.
    """
    value, below, rows = F.col(column), 0, df.filter(F.col(column).isNotNull())
    inside = rows.count()
    if not 0 <= place < inside:
        return None
    margin = 3.0 / ACCURACY
    while inside > sorted_rows:
        share = (place - below) / inside
        low, high = rows.agg(F.percentile_approx(
            column, [max(0.0, share - margin), min(1.0, share + margin)], ACCURACY)).first()[0]
        under, on_low, between, on_high = rows.agg(
            F.count_if(value < low), F.count_if(value == low), F.count_if((value > low) & (value < high)),
            F.count_if((value == high) & (value > low))).first()
        if place < below + under:
            rows, inside = rows.filter(value < low), under
        elif place < below + under + on_low:
            return low
        elif place < below + under + on_low + between:
            rows, below, inside = rows.filter((value > low) & (value < high)), below + under + on_low, between
        elif place < below + under + on_low + between + on_high:
            return high
        else:
            below += under + on_low + between + on_high
            rows, inside = rows.filter(value > high), inside - under - on_low - between - on_high
    upto = F.sum("n").over(Window.orderBy("x"))
    counted = rows.groupBy(value.alias("x")).agg(F.count(F.lit(1)).alias("n")).select("x", upto.alias("upto"))
    return counted.filter(F.col("upto") > place - below).agg(F.min("x")).first()[0]


def exact_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row ``threshold``; null without values."""
    spark = df.sparkSession
    count = df.agg(F.count(column)).first()[0]
    if not count:
        return spark.range(1).select(F.lit(None).cast("double").alias("threshold"))
    position = q * (count - 1)
    place = int(position)
    low = value_at(df, column, place)
    value = F.col(column)
    upto, next_ = df.agg(F.count_if(value <= low), F.min(F.when(value > low, value))).first()
    high = low if upto > place + 1 or next_ is None else next_
    return spark.range(1).select(F.lit(float(low + (high - low) * (position - place))).alias("threshold"))


def at_least(df: DataFrame, column: str, threshold: DataFrame, name: str) -> DataFrame:
    """Flag rows whose value reaches the one-row ``threshold``."""
    flag: Column = F.col(column) >= threshold.scalar()
    return df.withColumn(name, flag)
