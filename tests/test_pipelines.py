"""Ingest, sentiment, profiles, saved analyses and streams on literal rows."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postflock.operators import lexicon as lx, tfidf as ti
from postflock.plans import cluster as cl, graph as gr, ingest as ig, recommend as rc, report as rp, stats as st, tags as tg
from postflock.schema import ANALYSIS, LEXICON
from postflock.sources import analyses, raw_csv
from postflock.streaming import live, stored

NOW = datetime(2024, 1, 1)
GOLDEN = [
    (1, 1, "Today csk vs lsg match is awesome", 1.0), (2, 1, "Today csk vs lsg match is awesome", 1.0),
    (3, 2, "Thala dhoni finishes off in style\n#csk #win", 0.8), (4, 2, "Thala dhoni finishes off in style\n#csk #win", 0.8),
    (5, 3, "It is the Mahi way\n#csk #thala #win #yellove", 0.8), (6, 3, "It is the Mahi way\n#csk #thala #win #yellove", 0.8),
]
NAMES = [(1, "ab77744"), (2, "somesh"), (3, "ratnesh")]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(p, u, t, s, "positive", NOW + timedelta(hours=p)) for p, u, t, s in GOLDEN]
    posts = spark.createDataFrame(
        rows, "post_id long, user_id long, text string, sentiment_score double, sentiment_label string, ts timestamp"
    )
    return posts, spark.createDataFrame(NAMES, "user_id long, username string")


def links(posts):
    return ig.link_tags(posts).join(posts.select("post_id", "user_id", "ts"), "post_id")


def test_golden_clusters(spark, golden):
    posts, users = golden
    assigned = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "user_id long, cluster long")
    full = {r.cluster: r for r in cl.summary(assigned, posts, links(posts), cl.text_weights(posts)).collect()}
    assert full[0]["size"] == 2 and full[0].avg_sentiment == pytest.approx(0.8)
    assert full[0].top_keywords == "csk dhoni finishes mahi style thala way win yellove".split()
    assert full[0].top_hashtags == ["csk", "win", "thala", "yellove"]
    assert full[1].top_keywords == "awesome csk lsg match today vs".split()
    assert full[1].top_hashtags == [] and full[1].avg_sentiment == pytest.approx(1.0)
    shown = {r.number: (r["size"], r.users) for r in cl.member_preview(assigned, users).collect()}
    assert shown == {1: (2, ["somesh", "ratnesh"]), 2: (1, ["ab77744"])}
    texts = {r.user_id: r.text for r in st.profile_texts(posts, F.col("text")).collect()}
    assert texts[1] == "Today csk vs lsg match is awesome Today csk vs lsg match is awesome"


def test_golden_analysis_round_trip(spark, golden, tmp_path):
    posts, users = golden
    root = str(tmp_path)
    done = rp.clustering_analysis(users, posts, links(posts), root, n_clusters=2, restarts=5, stamp="20250418_003309")
    saved = analyses.read_analysis(spark, done.path).first()
    assert (saved.method, saved.n_clusters, saved.user_count) == ("kmeans", 2, 3)
    sizes = {c: (e["size"], sorted(e.user_ids)) for c, e in saved.cluster_analysis.items()}
    assert sizes == {"0": (2, [2, 3]), "1": (1, [1])}
    rp.clustering_analysis(users, posts, links(posts), root, n_clusters=2, restarts=1, stamp="20250419_003309")
    listed = analyses.catalogue(spark, root).collect()
    assert [r.timestamp for r in listed] == ["2025-04-19 00:33:09", "2025-04-18 00:33:09"]
    moods = {r.cluster: r.label for r in cl.mood(analyses.by_cluster(analyses.read_analysis(spark, done.path))).collect()}
    assert set(moods.values()) == {"positive"}


def test_large_runs_keep_members_beside_the_document(spark, golden, tmp_path):
    posts, users = golden
    run = cl.behaviour_clusters(posts, 2, restarts=2)
    full = cl.summary(run.assigned, posts, links(posts), cl.text_weights(posts))
    document = analyses.result_document(run, full, users, None, "20250418_003309", inline_members=2)
    rows = run.assigned
    path = analyses.save_analysis(run, document, rows, users, str(tmp_path), "20250418_003309", inline_members=2)
    entries = analyses.by_cluster(analyses.read_analysis(spark, path)).collect()
    assert all(e.user_ids is None for e in entries)
    assert spark.read.json(f"{tmp_path}/user_clustering_members_20250418_003309.jsonl").count() == 3


def test_raw_file(spark, tmp_path):
    lines = [
        "target,id,date,flag,user,text",
        '"4","1","Mon Apr 06 22:19:45 PDT 2009","NO","ann","hello #A #a"',
        '"0","2","bad time","NO","ann","second, with comma"',
        '"x","3","Mon Apr 06 22:19:45 PDT 2009","NO","bob","two\nlines ""quoted"" caf\xe9"',
        '"4","4","Mon Apr 06 22:19:45 PDT 2009","NO","ann","hello #A  #a"',
        '"4","5","short"',
        '"4","6","Mon Apr 06 22:19:45 PDT 2009","NO","","no name"',
        '"4","7","Mon Apr 06 22:19:45 PDT 2009","NO","cid",""',
        '"-1","8","Mon Apr 06 22:19:45 PDT 2009","","extra","dan","wide row"',
        '"1","9","Mon Apr 06 22:19:45 PDT 2009","","eve","empty flag"',
    ]
    (tmp_path / "raw.csv").write_bytes("\n".join(lines).encode("latin-1"))
    raw = raw_csv.read_raw_posts(spark, str(tmp_path / "raw.csv"))
    loaded = ig.ingest(raw, F.lit(NOW))
    status = [r.status for r in loaded.rows.orderBy("row_no").collect()]
    assert status == ["ok", "ok", "ok", "duplicate", "short_row", "missing_field", "missing_field", "ok", "ok"]
    posts = {r.text: r for r in loaded.posts.collect()}
    assert set(posts) == {"hello #A #a", "second, with comma", 'two lines ""quoted"" café'.replace('""', '"'), "wide row", "empty flag"}
    assert posts["hello #A #a"].sentiment_label == "positive" and posts["wide row"].sentiment_label == "negative"
    assert posts["second, with comma"].ts == NOW
    assert loaded.post_tags.count() == 1
    assert sorted(r.username for r in loaded.users.collect()) == ["ann", "bob", "dan", "eve"]
    m = loaded.metrics.first()
    assert (m.processed, m.duplicates, m.errors) == (5, 1, 3) and m.success_rate == pytest.approx(500 / 9)
    assert ig.metrics(loaded.rows.limit(0)).first().success_rate is None


def test_rows_are_cleaned_once_for_all_frames_of_a_load(spark):
    """users, posts and rejects each cleaned all texts again, several times."""
    texts = [("ann", " a  b "), ("ann", '"a b"'), ("bob", "a b"), ("bob", ""), (" ", "x"), ("ann", "c"), ("bob", "a\tb"), ("ann", "A b")]
    raw = spark.createDataFrame(
        [(i, "1", "no time", u, t) for i, (u, t) in enumerate(texts)],
        "row_no long, sentiment string, time_text string, username string, text string")
    loaded = ig.ingest(raw, F.lit(NOW))
    for frame in (loaded.rows, loaded.users, loaded.posts, loaded.rejects, loaded.post_tags, loaded.tags, loaded.metrics):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" not in plan and "LocalRelation" not in plan and "regexp_replace" not in plan
    status = [r.status for r in loaded.rows.orderBy("row_no").collect()]
    assert status == ["ok", "duplicate", "ok", "missing_field", "missing_field", "ok", "duplicate", "ok"]
    assert sorted((r.post_id, r.user_id) for r in loaded.posts.collect()) == [(0, 0), (2, 2), (5, 0), (7, 0)]
    assert sorted((r.user_id, r.username) for r in loaded.users.collect()) == [(0, "ann"), (2, "bob")]
    assert sorted(r.row_no for r in loaded.rejects.collect()) == [1, 3, 4, 6]
    assert loaded.rows.columns == ["row_no", "username", "text", "ts", "sentiment_score", "sentiment_label", "status"]


def test_lexicon_rules(spark):
    words = [("good", 0.5, None, False), ("bad", -0.8, None, False), ("very", None, 1.5, False), ("not", None, None, True)]
    cases = {
        "good": 0.5, "very good": 0.75, "not good": -0.25, "not very good": -0.375, "very bad": -1.0,
        "good bad": -0.15, "nothing here": 0.0, "": 0.0, "not here good": 0.5, "GOOD!": 0.5,
    }
    posts = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "post_id long, text string")
    found = lx.score_texts(posts, spark.createDataFrame(words, LEXICON)).collect()
    for r in found:
        assert r.sentiment_score == pytest.approx(cases[r.text]), r.text
    assert {r.text: r.sentiment_label for r in found}["very good"] == "positive"


def test_backfill_counts_updates(spark):
    rows = [(1, "good", None, "neutral"), (2, "good", 0.1, None), (3, "good", 0.1, "neutral"), (4, "x", None, None)]
    posts = spark.createDataFrame(rows, "post_id long, text string, sentiment_score double, sentiment_label string")
    done = lx.backfill(posts, lx.default_lexicon(spark))
    assert done.filter("updated").count() == 3
    assert done.filter("post_id = 3").first().sentiment_score == 0.1


def test_stats_with_missing_scores(spark):
    rows = [(1, 1, None, "positive"), (2, 1, 0.5, None), (3, 2, None, None)]
    posts = spark.createDataFrame(rows, "post_id long, user_id long, sentiment_score double, sentiment_label string")
    users = spark.createDataFrame([(1,), (2,), (9,)], "user_id long")
    stats = {r.user_id: r for r in st.chart_data(st.sentiment_stats(posts, users)).collect()}
    assert (stats[1].total, stats[1].positive, stats[1].average_score, stats[1].positive_percent) == (2, 1, 0.5, 50.0)
    assert stats[2].average_score is None
    assert (stats[9].total, stats[9].positive_percent, stats[9].average_score) == (0, 0.0, None)
    assert stats[1].chart_data["data"] == [1, 0, 0]


def test_long_profiles_come_in_parts(spark):
    rows = [(i, 1 if i % 3 else 2, f"t{i}") for i in range(100)]
    posts = spark.createDataFrame(rows, "post_id long, user_id long, text string")
    parts = st.profile_texts(posts, F.col("text"), chunk=40).orderBy("user_id", "chunk").collect()
    assert [(r.user_id, r.chunk) for r in parts] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    whole = " ".join(r.text for r in parts if r.user_id == 1)
    assert whole == " ".join(f"t{i}" for i in range(100) if i % 3)


def test_cooccurrence_maps_hold_everything(spark):
    pairs = spark.createDataFrame([("hub", f"t{i}", i) for i in range(50)] + [("t1", "hub", 1)], "tag string, other string, n long")
    maps = rp.cooccurrence_maps(pairs, chunk=10).collect()
    assert len([m for m in maps if m.tag == "hub"]) > 1
    merged = {k: v for m in maps if m.tag == "hub" for k, v in m.others.items()}
    assert merged == {f"t{i}": i for i in range(50)}


def test_changes(spark, golden):
    posts, users = golden
    follows = spark.createDataFrame([(1, 2)], "follower_id long, followee_id long")
    asked = spark.createDataFrame([(1, 2), (2, 2), (2, 3), (3, 99)], "follower_id long, followee_id long")
    after = ig.follow(follows, asked, users)
    assert sorted(tuple(r) for r in after.collect()) == [(1, 2), (2, 3)]
    assert ig.unfollow(after, follows).count() == 1
    requests = spark.createDataFrame([(1, 1), (3, 1)], "post_id long, user_id long")
    assert sorted(r.post_id for r in ig.delete_posts(posts, requests).collect()) == [2, 3, 4, 5, 6]


def test_bounded_paths_equal_plain_ones(spark):
    """Shared-tag and recommended-tag queries with the plain join switched off."""
    from postflock.sources.social import SocialTables
    from tests.conftest import SMALL

    t = SocialTables(spark, SMALL)
    for query in (
        lambda n: rc.shared_tag_users(t.post_tags, 5, plain_rows=n),
        lambda n: rc.similar_users(t.post_tags, 3, plain_rows=n),
        lambda n: tg.recommended_tags(t.users, t.posts, t.post_tags, t.as_of, plain_rows=n),
        lambda n: gr.friends_of_friends(t.follows, 4, plain_rows=n),
    ):
        assert sorted(map(tuple, query(0).collect())) == sorted(map(tuple, query(10**9).collect()))


def test_texts_are_dealt_by_their_size(spark, monkeypatch):
    """Much text goes to many tasks, which Spark does not merge again by the size of the compressed texts."""
    from postflock.sources import social
    from tests.conftest import SMALL

    few = social.SocialTables(spark, SMALL).text_posts
    size = few.agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(social, "TEXT_BYTES", size // 50)
    many = social.SocialTables(spark, SMALL).text_posts
    assert many.rdd.getNumPartitions() >= 50
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_last_places_mark_the_newest_by_others(spark):
    """A user's cut in the pool leaves the posts that ``newest_by_others`` lists, also for busy and unknown users."""
    start = datetime(2025, 1, 1)
    rows = [(i, 1 if i % 3 else i % 5, start + timedelta(minutes=i // 2)) for i in range(60)]
    pool = rc.newest_pool(spark.createDataFrame(rows, "post_id long, user_id long, ts timestamp"), 7)
    people = spark.createDataFrame([(0,), (1,), (3,), (99,)], "me long")
    places = rc.pool_list(pool).select(F.inline("_pool"))
    kept = places.crossJoin(rc.last_places(people, pool, 7)).filter("user_id <> me AND place <= _last")
    wanted = rc.newest_by_others(people, pool, 7).select("me", "item")
    assert sorted(map(tuple, kept.select("me", "post_id").collect())) == sorted(map(tuple, wanted.collect()))


def test_features_are_standardised(spark, golden):
    posts, _ = golden
    scaled = cl.scaled(cl.behaviour_features(posts)).collect()
    width = len(scaled[0].v)
    assert width == 155
    for axis in range(width):
        column = [r.v[axis] for r in scaled]
        mean = sum(column) / 3
        assert abs(mean) < 1e-9
        assert sum((x - mean) ** 2 for x in column) / 3 == pytest.approx(0, abs=1e-9) or sum(x * x for x in column) / 3 == pytest.approx(1)


def test_weights_have_unit_length(spark, golden):
    posts, _ = golden
    lengths = ti.tfidf(posts, "post_id").groupBy("doc").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in lengths) and len(lengths) == 6


def test_streams_equal_batch(spark, golden, tmp_path):
    posts, _ = golden
    plain = posts.select("post_id", "user_id", "text", "ts")
    plain.write.parquet(f"{tmp_path}/in")
    stream = lambda: live.read_posts(spark, f"{tmp_path}/in", plain.schema)
    live.start_intake(stream(), lx.default_lexicon(spark), f"{tmp_path}/out", f"{tmp_path}/s1").awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/out/posts")
    assert sorted((r.user_id, r.text) for r in kept.collect()) == sorted({(u, t) for _, u, t, _ in GOLDEN})
    live.start_trending(stream(), f"{tmp_path}/rank", f"{tmp_path}/s2").awaitTermination()
    batch = live.rolling_counts(plain)
    mark = NOW + timedelta(hours=5)
    expected = batch.filter(F.col("end") <= F.lit(mark)).collect()
    found = spark.read.schema(batch.schema).parquet(f"{tmp_path}/rank").collect() if expected else []
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected))


def _posts(rows):
    return [(i, u, t, NOW + timedelta(hours=h)) for i, u, t, h in rows]


POST = "post_id long, user_id string, text string, ts timestamp"


def test_a_repeat_is_dropped_however_late_it_comes(spark, tmp_path):
    """Batches days apart, one of them run twice, some across a merge of the filter."""
    store = live.intake_batch(f"{tmp_path}/out", lx.default_lexicon(spark))
    taken, expected = set(), {}
    for number in range(stored.MERGE_EVERY + 2):
        rows = [(100 * number + i, f"u{i % 3}", f"text {(number * 5 + i) % 23}", 90 * number) for i in range(6)]
        rows += [(100 * number + 50, "u0", "text 0", 90 * number), (100 * number + 51, "u0", "", 0)] * 2
        batch = spark.createDataFrame(_posts(rows), POST)
        for _ in range(2 if number in (0, 4, stored.MERGE_EVERY - 1) else 1):
            store(batch, number)
        expected[number] = {(u, t) for _, u, t, _ in rows if t} - taken
        taken |= expected[number]
    found = spark.read.parquet(f"{tmp_path}/out/posts").collect()
    assert len(found) == len(taken)
    for number, keys in expected.items():
        assert {(r.user_id, r.text) for r in found if r.batch == number} == keys
    assert spark.read.parquet(f"{tmp_path}/out/seen/keys").count() == len(taken)


def test_a_full_filter_only_costs_lookups(spark, tmp_path):
    seen = stored.SeenKeys(spark, f"{tmp_path}/seen", ranges=4, bitmaps=1)
    frame = lambda a, b: spark.range(a, b).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("key"))
    assert seen.known(frame(0, 5), 0).count() == 0
    seen.take(frame(0, 40_000), 0)
    assert seen.known(frame(39_990, 40_010), 1).count() == 10
    assert seen.known(frame(39_990, 40_010), 0).count() == 0


def test_ranking_is_current_after_each_batch(spark, tmp_path):
    """Late posts, repeated posts and repeated files against a count over all that came so far."""
    rng = random.Random(6)
    posts = [(i, "u", f"#t{rng.randint(0, 6)} #all", round(i / 9 - rng.choice([0, 0, 0, 3, 20]), 2)) for i in range(360)]
    files = [posts[k:k + 60] + rng.sample(posts[max(0, k - 60):k + 60], 8) for k in range(0, 360, 60)]
    files.insert(3, files[2])
    for rows in files:
        spark.createDataFrame(_posts(rows), POST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = live.read_posts(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
        live.start_ranking(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        so_far = {p[0]: p for f in files[:files.index(rows) + 1] for p in f}.values()
        hour = lambda h: (NOW + timedelta(hours=h)).replace(minute=0, second=0, microsecond=0)
        newest = max(hour(p[3]) for p in so_far)
        counts = Counter(t for p in so_far if hour(p[3]) > newest - timedelta(hours=24) for t in p[2].replace("#", "").split())
        expected = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:10]
        found = live.current_ranking(spark, f"{tmp_path}/out").orderBy("rank").collect()
        assert [(r.tag, r["count"]) for r in found] == expected and {r.as_of for r in found} == {newest}


def test_a_batch_of_counts_written_twice_changes_nothing(spark, tmp_path):
    store = live.ranking_batch(f"{tmp_path}/out")
    for number in (0, 0, 1, 1, 0):
        rows = [(NOW.replace(minute=0, second=0, microsecond=0) + timedelta(hours=number), f"t{i}", i + number) for i in range(3)]
        store(spark.createDataFrame(rows, "hour timestamp, tag string, count long"), number)
    found = spark.read.parquet(f"{tmp_path}/out/ranking").filter("batch = 1").orderBy("rank").collect()
    assert [(r.tag, r["count"]) for r in found] == [("t2", 5), ("t1", 3), ("t0", 1)]


@pytest.mark.parametrize("inline", [2, 100])
def test_saved_members_are_whole_at_every_size(spark, golden, tmp_path, inline):
    posts, users = golden
    run = cl.behaviour_clusters(posts, 2, restarts=1)
    document = analyses.result_document(run, cl.summary(run.assigned, posts, links(posts), cl.text_weights(posts)), users, None, "20250418_003309", inline)
    path = analyses.save_analysis(run, document, run.assigned, users, str(tmp_path), "20250418_003309")
    found = {(r.user_id, r.username) for r in analyses.saved_members(spark, path).collect()}
    assert found == set(NAMES)
    if inline == 100:
        alone = f"{tmp_path}/alone/user_clustering_kmeans_20250419_003309.json"
        spark.read.json(path, schema=ANALYSIS).write.json(alone)
        assert {(r.user_id, r.username) for r in analyses.saved_members(spark, alone).collect()} == set(NAMES)


def test_a_clustering_reads_the_posts_a_few_times(spark, golden, tmp_path):
    """Counts, profiles and the summary are made once, whatever reads them."""
    posts, users = golden
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    watched = posts.mapInPandas(watch, posts.schema)
    cl.behaviour_clusters(watched, 2, restarts=1)
    features = seen.value / len(GOLDEN)
    done = rp.clustering_analysis(users, watched, links(posts), str(tmp_path), 2, restarts=1, stamp="20250418_003309")
    done.summary.collect()
    assert features <= 7, features
    assert seen.value / len(GOLDEN) - features <= 8, seen.value / len(GOLDEN) - features


def test_tags_of_heavy_users_stand_in_the_parts_of_their_texts(spark, golden):
    posts, users = golden
    many = spark.range(10_001).select(
        F.col("id").alias("post_id"), F.lit(1).cast("long").alias("user_id"), F.lit("x").alias("text"))
    tag = spark.createDataFrame([(10_000, 1, "b"), (10_000, 1, "a"), (3, 1, "c")], "post_id long, user_id long, tag string")
    run = cl.Behaviour(spark.createDataFrame([(1, 0.0, 0.0, 0)], "user_id long, x double, y double, cluster long"), None, "kmeans", 1, 1)
    means = spark.createDataFrame([(1, 0.0, 10_001)], "user_id long, avg_sentiment double, posts long")
    rows = analyses.feature_rows(run, many, tag, users, means).orderBy("chunk").collect()
    assert [(r.chunk, len(r.tweet_text), r.hashtag_text) for r in rows] == [(0, 19_999, "c"), (1, 1, "a b")]
