"""Secret scans over a trigram inverted index, in DataFrame functions only.

Every rule is a regular expression. From its parse tree a Boolean query over trigrams is derived (any match
contains all trigrams of at least one clause). ``postings`` lists, for the trigrams that some query names,
the documents that contain them; ``candidates`` intersects the lists clause by clause; ``scan`` verifies a
rule on its candidates. A rule without mandatory trigrams is verified on every document.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as sre
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from postflock.llm.common import texts

Clause = frozenset[str]


@dataclass(frozen=True)
class Rule:
    """``group`` (0: the match) must have at least ``at_least`` characters, else the match is dropped and
    the search goes on behind it. Patterns use the syntax that Java and Python share, in ASCII."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Well-known public token forms, looked for besides the base kinds.
MORE_RULES = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
MOST_STRINGS = 64


def _trigrams(strings: set[str]) -> list[Clause] | None:
    """Clauses of which one holds wherever one of the strings stands; None: no demand can be made."""
    if any(len(s) < 3 for s in strings):
        return None
    return list({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings})


def _both(a: list[Clause] | None, b: list[Clause] | None) -> list[Clause] | None:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MOST_STRINGS:
        return min(a, b, key=len)
    return list({x | y for x in a for y in b})


def _analyse(items) -> tuple[set[str] | None, list[Clause] | None]:
    """(all strings that the sequence matches, or None if they are too many, the clauses it demands)."""
    exact, whole, query = {""}, True, None
    for kind, arg in items:
        strings, demand = _item(kind, arg)
        if strings is not None and len(exact) * len(strings) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
            continue
        whole, query = False, _both(_both(query, _trigrams(exact)), demand)
        exact = strings if strings is not None else {""}
    if whole:
        return exact, _trigrams(exact)
    return None, _both(query, _trigrams(exact))


def _item(kind, arg) -> tuple[set[str] | None, list[Clause] | None]:
    if kind == op.LITERAL:
        return {chr(arg).lower()}, None
    if kind == op.IN and all(k == op.LITERAL for k, _ in arg):
        return {chr(c).lower() for _, c in arg}, None
    if kind == op.SUBPATTERN:
        return _analyse(arg[3])
    if kind == op.BRANCH:
        parts = [_analyse(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            strings = set().union(*(s for s, _ in parts))
            return strings, _trigrams(strings)
        demands = [d for _, d in parts]
        return None, None if any(d is None for d in demands) else [c for d in demands for c in d]
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, body = arg
        strings, demand = _analyse(body)
        if least == 0:
            return (strings | {""}, None) if most == 1 and strings is not None else (None, None)
        if strings is not None and least == most == 1:
            return strings, demand
        return None, demand
    return None, None


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses over lower-case trigrams; a text without all of one clause has no match. Empty: scan fully."""
    found = _analyse(sre.parse(pattern, re.ASCII))[1] or []
    return [c for c in found if not any(o < c for o in found)]


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(trigram, doc_id): in which texts, lower-cased, each trigram of the vocabulary occurs."""
    low = F.lower("text")
    held = F.filter(F.array(*map(F.lit, vocabulary)), lambda t: F.contains(F.col("_low"), t))
    return texts(docs).select("doc_id", low.alias("_low")).select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[Clause]]) -> DataFrame:
    """(doc_id, kinds): the rules of which the document's trigrams meet a clause. The clauses are as many as
    the rules make, so they go to every task."""
    spark = index.sparkSession
    rows = [
        (kind, n, gram, len(clause))
        for kind, clauses in queries.items() for n, clause in enumerate(clauses) for gram in sorted(clause)
    ]
    wanted = spark.createDataFrame(rows, "kind string, clause int, trigram string, least int")
    return (
        index.distinct().join(F.broadcast(wanted), "trigram")
        .groupBy("doc_id", "kind", "clause", "least").count()
        .filter(F.col("count") == F.col("least"))
        .groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
    )


def _spans(rule: Rule, text: Column) -> Column:
    """array<struct(kind, start, end)> in code points: the lengths of the matches and of what lies between
    them are added up, so that no position has to come from the regular expression."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("kept"))
    steps = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(found, F.length).alias("long"),
                         F.transform(group, F.length).alias("size"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(F.lit(rule.kind).alias("kind"), begin.alias("start"), (begin + x["long"]).alias("end"))
        kept = F.when(x["size"] >= rule.at_least, F.concat(acc["kept"], F.array(span))).otherwise(acc["kept"])
        return F.struct((begin + F.coalesce(x["long"], F.lit(0))).alias("at"), kept.alias("kept"))

    spans = F.aggregate(steps, start, step, lambda acc: acc["kept"])
    return F.when(F.size(found) > 0, spans).otherwise(empty)


def _direct(rule: Rule) -> Rule:
    """A lone class repeated without bound matches whole runs, so the least length may stand in the pattern;
    the runs that are too short are then passed over without being listed."""
    items = sre.parse(rule.pattern, re.ASCII)
    if rule.group == 0 and len(items) == 1 and items[0][0] == op.MAX_REPEAT and rule.pattern.endswith("]+"):
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.at_least},}}", 0, rule.at_least)
    return rule


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """Adds ``secrets`` to the columns of ``docs``: array<struct(kind, start, end)> ordered by start, then
    by the order of the rules.

    Null and empty texts have no secrets. Rows are kept as they are, repeated ones and null ids included:
    candidates are found by doc_id, and each row of that id is verified on its own text.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    chosen = candidates(postings(docs, sorted({g for q in queries.values() for c in q for g in c})), queries)
    chosen = chosen.select(F.col("doc_id").alias("_secret_doc"), F.col("kinds").alias("_secret_kinds"))
    rank = F.create_map(*(x for n, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(n))))
    text = F.coalesce(F.col("text"), F.lit(""))
    found = []
    for rule in map(_direct, rules):
        spans = _spans(rule, text)
        if rule.kind in queries:
            spans = F.when(F.array_contains("_secret_kinds", rule.kind), spans)
        found.append(F.coalesce(spans, F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    ordered = F.transform(
        F.array_sort(F.transform(F.concat(*found), lambda s: F.struct(
            s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return (
        docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("_secret_doc")), "left")
        .withColumn(into, ordered).drop("_secret_doc", "_secret_kinds")
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, SHA-256 of the base spans, all spans."""
    kinds = [r.kind for r in BASE_RULES]
    found = scan(docs.select("doc_id", "text")).withColumn(
        "base", F.filter("secrets", lambda s: s["kind"].isin(kinds)))
    return found.select(
        "doc_id",
        *(F.size(_of_kind("base", k)).cast("long").alias(f"n_{k}") for k in kinds),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by the mark and ``n_chars`` set to the new length where
    that column exists. Spans that overlap are replaced as one. Documents without secrets stay as they are, null and
    empty texts among them; all other columns stay, whatever their names; repeated rows and rows without an id are
    treated each; an empty table stays empty."""
    spans = "_secrets"
    while spans in docs.columns:
        spans += "_"
    found = scan(docs, into=spans)
    text = F.col("text")
    cut = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"),
        )).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    hit = F.size(spans) > 0
    out = found.withColumn("text", F.when(hit, cut).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def digest_sql() -> str:
    """The digest in DuckDB's SQL: every rule on every text, without an index."""
    def found(n: int, rule: Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        lengths = "list_transform({}, lambda x: length(x))"
        return f"""
  SELECT id, {n} AS rank, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
    'start': list_sum({lengths.format("parts[:i]")}) + coalesce(list_sum({lengths.format("m[:i - 1]")}), 0),
    'long': length(m[i]), 'size': length(g[i])}})) AS s
  FROM (SELECT id, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS g,
    string_split_regex(text, '{pattern}') AS parts FROM docs)
  WHERE len(m) > 0"""

    least = ", ".join(str(r.at_least) for r in RULES)
    base = len(BASE_RULES)
    counts = ", ".join(
        f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(found(n, r) for n, r in enumerate(RULES))}),
spans AS (
  SELECT id, rank, kind, CAST(s.start AS BIGINT) AS start,
    kind || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.start + s.long AS BIGINT) AS span
  FROM found WHERE s.size >= [{least}][rank + 1])
SELECT doc_id, {counts},
  sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {base}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM docs LEFT JOIN spans USING (id) GROUP BY id, doc_id"""
