"""Scalar functions on literal rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postflock.functions import text as tx, time as tm, trend as tr


def values(spark, rows, build, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i long, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(build(F.col("x"))).collect()]


def test_clean_text(spark):
    given = ["  a  b ", '"quoted"', ' "x\n\ty" ', None, "", " n b ", '""a""']
    assert values(spark, given, tx.clean_text) == ["a b", "quoted", "x y", "", "", "n b", "a"]


def test_tags(spark):
    given = ["#Über and #csk", "x#win", "##a", "# alone", "", None, "#One #one #TWO_2"]
    assert values(spark, given, tx.raw_tags) == [["Über", "csk"], ["win"], ["a"], [], [], [], ["One", "one", "TWO_2"]]
    assert values(spark, given, tx.tag_set)[-1] == ["one", "two_2"]
    assert values(spark, given, tx.tags)[0] == ["über", "csk"]


def test_tokens(spark):
    assert values(spark, ["It's A big_DAY, été 42 x"], tx.tokens) == [["it", "big_day", "été", "42"]]


def test_raw_time(spark):
    given = ["Mon Apr 06 22:19:45 PDT 2009", "Mon Apr 6 22:19:45 PDT 2009", "Mon Apr 06 22:19:45 2009", "junk", None,
             "Mon Apr 31 22:19:45 PDT 2009", "Xyz Apr 06 22:19:45 PDT 2009"]
    now = datetime(2024, 1, 1)
    good = datetime(2009, 4, 6, 22, 19, 45)
    found = values(spark, given, lambda c: tm.parse_raw_time(c, F.lit(now)))
    assert found == [good, good, now, now, now, now, now]


def test_labels(spark):
    scores = [-0.31, -0.3, -0.05, 0.0, 0.11, 0.3, 0.31]
    neg, neu, pos = "negative", "neutral", "positive"
    assert values(spark, scores, tx.polarity_label, "double") == [neg, neu, neu, neu, neu, neu, pos]
    assert values(spark, scores, tx.mood_label, "double") == [neg, neg, neu, neu, pos, pos, pos]
    assert values(spark, scores, tx.sign_label, "double") == [neg, neg, neg, neu, pos, pos, pos]


def test_numbers_and_previews(spark):
    assert values(spark, ["1.5", "-2", "n/a", "", None], tx.safe_double) == [1.5, -2.0, 0.0, 0.0, 0.0]
    assert values(spark, ["a" * 60, "short"], tx.short_preview) == ["a" * 50 + "...", "short"]
    assert values(spark, ["short"], tx.preview) == ["short..."]
    assert values(spark, ["nEUTRAL mood"], tx.capitalise) == ["Neutral mood"]


@pytest.mark.parametrize("hours,expected", [(0, 1.0), (12, 1.5), (24, 2.0), (48, 2.0)])
def test_recency(spark, hours, expected):
    now = datetime(2024, 1, 3)
    then = datetime.fromtimestamp(now.timestamp() - hours * 3600)
    age = values(spark, [then], lambda c: tm.hours_since(F.lit(now), c), "timestamp")[0]
    assert age == hours
    assert values(spark, [float(hours)], tm.recency, "double") == [expected]
    assert values(spark, [float(hours)], lambda c: tm.recency(c, decay=True), "double") == [3.0 - expected]


def test_missing_date(spark):
    assert values(spark, [None], lambda c: tm.hours_since(F.lit(datetime(2024, 1, 1)), c), "timestamp") == [9999.0]
    score = lambda c: tr.damped_score(c, F.lit(2.0), F.lit(None).cast("timestamp"))
    assert values(spark, [5], score, "long") == [0.0]
