"""Every registered query: equal to its SQL, or, for fitted models, its invariants."""

import pathlib
import shutil
import subprocess
import sys

import pytest

from postflock.catalog import QUERIES, SQL
from tests.conftest import SMALL
from tests.harness import connect, differences


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SMALL).toPandas()
    assert differences(found, duck.sql(SQL[name]).df()) == ""


def _rows(spark, name):
    return QUERIES[name](spark, SMALL).toPandas()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 10


def test_latent_posts_are_foreign_and_ranked(spark):
    rows = _rows(spark, "m6_als")
    owners = {r.post_id: r.user_id for r in QUERIES["s2_scan_posts"](spark, SMALL).collect()}
    assert all(owners[p] != u for p, u in zip(rows.post_id, rows.user_id))
    for _, part in rows.groupby("user_id"):
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 11))
        assert part.score.is_monotonic_decreasing


def test_kmeans_covers_everyone_and_numbers_by_size(spark):
    rows = _rows(spark, "m10_kmeans")
    assert len(rows) == 15 and rows.user_id.is_unique
    sizes = rows.groupby("cluster").size()
    assert list(sizes.index) == list(range(len(sizes))) and sizes.is_monotonic_decreasing


def test_probabilities(spark):
    rows = _rows(spark, "m14_trending_lr")
    assert len(rows) == 10 and rows.probability.between(0, 1).all()
    assert rows.probability.is_monotonic_decreasing


def test_hybrid_posts_fill_every_list(spark):
    rows = _rows(spark, "r1_posts")
    assert (rows.groupby("user_id").size() == 5).all() and rows.user_id.nunique() == 150


def test_hybrid_users_leave_out_oneself(spark):
    rows = _rows(spark, "r3_users")
    assert (rows.user_id != rows.other_id).all()
    assert not rows.duplicated(["user_id", "other_id"]).any()


def test_silhouette_in_range(spark):
    rows = _rows(spark, "m13_silhouette")
    assert rows["size"].sum() == 15 and rows.silhouette.between(-1, 1).all()


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_in_a_copy_without_the_text_folders(tmp_path, pipeline):
    here = pathlib.Path(__file__).parent.parent
    shutil.copytree(here / "postflock", tmp_path / "postflock", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + (["corpus_pipeline.py"] if pipeline else []):
        if (here / name).exists():
            shutil.copy(here / name, tmp_path)
    told = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries(), '/', *e.oracle_sql())"],
        cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert told.returncode == 0, told.stderr
    names, sql = (set(x.split()) for x in told.stdout.split("/"))
    assert names == set(QUERIES) and sql == set(SQL)
