"""Toxicity and personal data, the pipeline, and the registration of all queries."""

import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np

import corpus_pipeline
from postflock.llm import pii, queries, toxicity
from tests.conftest import SMALL
from tests.llm.helpers import documents, odd_texts


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_matcher_equals_edit_distance():
    rng = random.Random(1)
    terms = [toxicity.Term("".join(rng.choice("abc") for _ in range(rng.randint(3, 9))), float(rng.randint(1, 9))) for _ in range(12)]
    terms = list({t.text: t for t in [*terms, toxicity.Term("cabac", 4.0)]}.values()) + [toxicity.Term("abca", 5.0, True)]
    matcher = toxicity.Matcher(terms)
    for _ in range(8000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))
        exact = max([0.0, *(t.weight for t in terms if (word.startswith(t.text) if t.stem else word == t.text))])
        near = max([0.0, *(t.weight * 0.5 ** _distance(word, t.text) for t in terms
                           if not t.stem and 0 < _distance(word, t.text) <= t.edits)])
        assert matcher.weights(word) == ((exact, 0.0 if exact else near) if exact or near else None)


def test_product_equals_edit_distance_over_all_terms(monkeypatch):
    """Long and short terms with shared beginnings; states are also made anew on the way."""
    rng = random.Random(3)
    texts = {"".join(rng.choice("abcé") for _ in range(rng.randint(5, 12))) for _ in range(150)}
    terms = [toxicity.Term(t, float(rng.randint(1, 9))) for t in sorted(texts)]
    for kept in (200_000, 50):
        monkeypatch.setattr(toxicity, "KEPT_STATES", kept)
        product = toxicity.Product(terms)
        for _ in range(600):
            word = list(rng.choice(terms).text)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(word) + 1)
                word[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "d"])
            word = "".join(word)
            near = [t.weight * 0.5 ** _distance(word, t.text) for t in terms if _distance(word, t.text) <= t.edits]
            assert product.weight(word) == max([0.0, *near])


def test_words_share_states():
    product = toxicity.Product([toxicity.Term("scoundrel", 5.0)])
    for word in ("scoundral", "scoundril", "scoundrels"):
        product.weight(word)
    before = len(product._states)
    assert product.weight("scoundrolx") == 1.25 and len(product._states) <= before + 3
    assert product.weight("zzzzzzzzzzzz") == 0.0


def test_filler_words_stay_out(spark):
    """A word that is as frequent in both kinds comes into no lexicon, among thousands looked at."""
    rng = random.Random(5)
    words = ["".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3)) + "x" for _ in range(3000)]
    rows = [(" ".join(rng.choices(words, k=80) + ["scoundrel"] * (i % 10 == 0)), int(i % 10 == 0)) for i in range(600)]
    terms = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert terms and {t.text for t in terms if not "scoundrel".startswith(t.text)} == set()


def test_no_feature_speaks_for_a_text():
    rng = np.random.default_rng(3)
    x = rng.random((400, 4))
    y = (x[:, 0] - x[:, 3] + rng.normal(0, 0.2, 400) > 0.1).astype(float)
    curve = toxicity.fit_curve(x, y)
    assert curve[1] > 0 and curve[4] == 0 and min(curve[1:]) >= 0


def test_rare_and_covered_words_may_be_misspelled(spark):
    insults = [f"{a}{b}zz{c}ard" for a in ("bl", "kr", "dr", "gn", "pf") for b in "aeiou" for c in "l"] + ["stonehead", "stoneheads"]
    rows = [(f"plain words {insults[i % 27]} here", 1) for i in range(324)] + [("plain words here", 0)] * 900
    terms = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    matcher = toxicity.Matcher(terms)
    for word in insults:
        assert matcher.weights(word)[0] > 0 and matcher.weights("x" + word)[1] > 0
    covered = toxicity.reduced([toxicity.Term("stone", 6.0, True), toxicity.Term("stonehead", 6.0),
                                toxicity.Term("stoneheads", 5.0)])
    assert toxicity.Matcher(covered).weights("xstonehead") == (0.0, 3.0)


def test_quotation_counts_less():
    terms, curve = [toxicity.Term("idiot", 6.0)], [-4.0, 1.0, 0.0, 0.0, 1.0]
    own = toxicity.Scorer(terms, curve)
    plain, quoted = own.score("you are an idiot my friend"), own.score('he said "you are an idiot" to them')
    assert plain > toxicity.THRESHOLD > quoted > own.score("a kind word")
    assert own.score("you idiott") > own.score("you")


def _labelled(spark, many=400):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "rstn"]
    texts, labels = [], []
    for i in range(many):
        body = [rng.choice(words) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for w in ("scoundrel", "wretch", "villain"):
                body.insert(rng.randrange(60), w)
        texts.append((i, " ".join(body)))
        labels.append((i, int(toxic), "x"))
    labels += [(10**9, 1, "x"), (None, 1, "x"), (3, None, "x")]
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int, score string")


def test_toxic_texts_are_found_in_the_held_out_part(spark):
    docs, labels = _labelled(spark)
    rows = toxicity.digest(docs, labels).collect()
    assert len(rows) == 400 and any(r.held_out for r in rows)
    assert all(r.predicted == (r.doc_id % 5 == 0) == (r.score >= 0.3) for r in rows)


def test_held_out_labels_are_never_read(spark):
    docs, labels = _labelled(spark)
    fold = toxicity.remainder(labels.doc_id, 4)
    turned = labels.withColumn("toxic", toxicity.F.when(fold == 2, 1 - labels.toxic).otherwise(labels.toxic))
    one, two = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert one.terms == two.terms and np.allclose(one.curve, two.curve)


def test_toxicity_of_odd_rows(spark):
    docs, labels = documents(spark, odd_texts()), _labelled(spark)[1]
    assert Counter(r.doc_id for r in toxicity.digest(docs, labels).collect()) == Counter(i for i, _ in odd_texts())
    assert all(0 <= r.score <= 1 for r in toxicity.digest(docs, labels.limit(0)).collect())
    assert toxicity.digest(docs.limit(0), labels).count() == 0
    assert toxicity.keep_civil(docs, labels).columns == docs.columns


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_emails_equal_the_pattern():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("ab.@- @.é") for _ in range(rng.randint(0, 30)))
        found = [s for s in pii.base_spans(text) if s[0] == "email"]
        assert found == [("email", *m.span()) for m in EMAIL.finditer(text)]


def test_base_spans():
    text = "☃ 10.0.0.256 1.2.3.4.5 then 4111 1111 1111 1111, 4111111111111112 +1 (499) 555-6503 +12 34 a.b+c@d-e.fg.h"
    found = [(k, text[a:b]) for k, a, b in pii.base_spans(text)]
    assert found == [("email", "a.b+c@d-e.fg.h"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (499) 555-6503")]


def test_field_learns_its_table_and_decodes_the_best_path():
    field = pii.train()
    right = sum(pii.field_spans([pii.parse(m)[0]], field)[0] == pii.parse(m)[1] for m in pii.LABELLED)
    assert right >= 0.9 * len(pii.LABELLED)
    parts = [p for m in pii.LABELLED for p in pii.segments(pii.parse(m)[0]) if len(p.places) <= 3]
    scores, lengths = field.scores(parts)
    for n, (labels, many) in enumerate(zip(field.decode(parts), lengths)):
        def value(path):
            moves = sum(field.move[a, b] for a, b in zip([0, *path], [*path, 0]))
            return moves + sum(scores[n, t, x] for t, x in enumerate(path))
        ways = [()]
        for _ in range(many):
            ways = [(*w, x) for w in ways for x in range(len(pii.LABELS))]
        assert abs(value(labels) - max(map(value, ways))) < 1e-9


def test_field_finds_other_spellings_and_base_stays():
    text = "call 555-201-9999 or bob (at) web (dot) net from 10.1.2.3."
    base, more = pii.find([text], pii.train())[0]
    assert base == [("ip", 49, 57)] and {text[a:b] for _, a, b in more} >= {"555-201-9999", "bob (at) web (dot) net"}


def test_personal_data_of_odd_rows(spark):
    rows = pii.digest(documents(spark, [*odd_texts(), (30, "x" * 50_000 + "@"), (31, "1 " * 20_000)])).collect()
    assert len(rows) == len(odd_texts()) + 2 and pii.digest(documents(spark, [])).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pieces = corpus_pipeline.run(spark, SMALL).cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "secret_scan", "mixture_packing"]
    civil = corpus_pipeline.drop_toxic(spark, docs, SMALL)
    single = corpus_pipeline.drop_near_copies(spark, civil, SMALL)
    clean = corpus_pipeline.redact_secrets(spark, single, SMALL)
    assert civil.columns == single.columns == clean.columns == docs.columns
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in clean.select("doc_id").collect()}
    assert civil.count() >= 0.8 * docs.count()


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Every stage keeps the columns and their values, bears odd rows and an empty table."""
    labels = _labelled(spark)[1].select("doc_id", "toxic")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (odd_texts(), []):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, str(tmp_path))
            assert kept.columns == docs.columns
            assert all((r.secrets, r.key, r.part) == ("x", "k", 7) for r in kept.collect())
            docs = kept
        texts = {(i, t or "") for i, t in rows}
        assert {(r.doc_id, r.text or "") for r in docs.collect()} <= texts and bool(rows) == bool(docs.count())
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert len({r.doc_id for r in pieces}) == docs.select("doc_id").distinct().count()


def test_spans_over_long_runs_are_whole():
    field = pii.train()
    for many in (500, 511, 512, 513, 1030):
        text = "1 " * (many - 2) + "4111 1111 1111 1111 card"
        part, = pii.segments(text)
        emit, path = field.scores([part])[0][0], []
        best, back = emit[0] + field.move[0], []
        for row in emit[1:]:
            ways = best[:, None] + field.move
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        path = [int((best + field.move[:, 0]).argmax())]
        for row in reversed(back):
            path.append(int(row[path[-1]]))
        assert len(part.places) == many + 2 and field.decode([part]) == [path[::-1]]


def test_every_operator_has_one_query():
    names = list(queries.QUERIES)
    assert [int(re.match(r"op(\d+)_", n).group(1)) for n in names] == list(range(1, 14))
    assert set(queries.SQL) <= set(names)


def test_entry_without_this_subpackage():
    code = ("import sys\nsys.modules['postflock.llm'] = None\nsys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e\nassert e.queries() and not any(n.startswith('op') for n in e.queries())")
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0
