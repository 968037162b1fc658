"""Semantics of operators on small fixtures."""

from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import similarity
from ledgerlens.functions import text as T
from ledgerlens.operators import chunking, events, lifecycle, pairs, ranking, routing


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).head()[0]


NOISE = [
    ("decision", "chat", "", "We chose Parquet", None, None, None, False),
    ("telemetry", "chat", "", "x", None, None, None, True),
    ("observation", "chat", "kb_session_report", "x", None, None, None, True),
    ("observation", "chat", "", "x", None, "a\\.kb\\sessions\\1.md", None, True),
    ("decision", "chat", "", "x", None, None, False, True),
    ("failure", "orchestrator", "", "Command failed: make", None, None, None, True),
    ("failure", "orchestrator", "", "The index was stale", None, None, None, False),
    ("observation", "orchestrator", "", "x", None, None, None, True),
    ("observation", "opencode_hook", "", "Session duration: 3", None, None, None, True),
    ("failure", "opencode_hook", "", "Exit code: 1", None, None, None, True),
    ("failure", "chat", "", "Exit code: 1", None, None, None, False),
    ("observation", "chat", "", "Exit code: 1", None, None, None, True),
    (None, None, None, None, None, None, None, False),
]


@pytest.mark.parametrize("row", NOISE)
def test_noise_policy(spark, row):
    names = ["kind", "source", "stype", "summary", "evidence", "path"]
    df = spark.createDataFrame([row[:7]], ", ".join(f"{n} string" for n in names) + ", eligible boolean")
    got = df.select(events.is_noise(*[F.col(n) for n in names], F.col("eligible"))).head()[0]
    assert got is row[7]


def test_text_functions(spark):
    df = spark.createDataFrame([("Aé_b, straße ÇA 12",)], "t string")
    assert df.select(T.tokens(F.col("t"))).head()[0] == ["aé_b", "straße", "ça", "12"]
    assert one(spark, T.slug(F.col("a")), a=" Foo: Bar!! ") == "foo-bar"
    assert one(spark, T.redact(F.col("a")), a='token = "abcdefgh12" bearer xyz') == 'token = "[REDACTED]" Bearer [REDACTED]'
    assert [one(spark, T.stem(F.col("a")), a=w) for w in ("running", "glass", "boxes", "Tested", "cats")] == ["runn", "glass", "box", "test", "cat"]
    assert one(spark, T.token_estimate(F.lit(9)), a=1) == 3
    assert one(spark, F.size(T.phrases(F.split(F.col("a"), " "))), a="a b c d e") == 3
    assert dict(one(spark, T.front_matter(F.col("a")), a="---\nname: x y\nn: 3\n---\nbody")) == {"name": "x y", "n": "3"}
    assert [tuple(r) for r in one(spark, T.wiki_links(F.col("a")), a="[[a]] [[depends_on:b c]] [[d|shown]] [[mitigates:e|shown]]")] == [("relates_to", "a"), ("depends_on", "b c"), ("relates_to", "d"), ("mitigates", "e")]
    assert one(spark, T.identifiers(F.col("a")), a="call foo.bar and my_name in FooBar or camelCase MAX_N") == ["foo.bar", "my_name", "MAX_N", "FooBar", "camelCase"]
    assert one(spark, F.unix_timestamp(T.parse_time(F.col("a"))), a="2024-01-01T00:00:00Z") == 1704067200
    assert one(spark, F.unix_timestamp(T.parse_time(F.col("a"))), a="12.5") == 12
    assert one(spark, T.parse_time(F.col("a")), a="soon") is None


def test_line_windows(spark):
    text = "\n".join(map(str, range(1, 301)))
    df = spark.createDataFrame([(1, text), (2, "a"), (3, "")], "id int, t string")
    rows = [(r.id, r.start_line, r.end_line) for r in chunking.line_windows(df, "id", F.col("t")).orderBy("id", "start_line").collect()]
    assert rows == [(1, 1, 120), (1, 101, 220), (1, 201, 300), (2, 1, 1), (3, 1, 1)]


def test_bm25_keeps_repeated_query_terms_and_divides_by_the_best(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha beta gamma"), (3, "gamma")], "id int, document string")
    got = {r.id: r.sparse for r in ranking.sparse_scores(df, "alpha alpha x").collect()}
    assert max(got.values()) == 1.0 and got[3] == 0.0
    assert {r.sparse for r in ranking.sparse_scores(df, "x").collect()} == {0.0}


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 1.0, 5.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(ranking.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def replay_plain(history):
    sessions, conf, evidence, status, moved = [], 1, 0, "candidate", 0
    for session, kind in history:
        if session not in sessions:
            sessions.append(session)
        evidence += 1
        conf = min(5, conf + 1) if kind == "validation" else max(1, conf - 1) if kind == "failure" else conf
        if kind == "deprecation":
            new = "deprecated"
        elif len(sessions) >= 5 and conf >= 4:
            new = "canonical"
        elif evidence >= 2 or status == "validated":
            new = "validated"
        else:
            new = "emerging"
        moved += new != status
        status = new
    return status, conf, len(sessions), moved


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from(["validation", "failure", "deprecation", "observation"])), min_size=1, max_size=20))
def test_replay(spark, history):
    df = spark.createDataFrame([(i, "c", s, k, "e") for i, (s, k) in enumerate(history)], "seq long, concept string, session_id string, event_type string, evidence string")
    s = lifecycle.replay(df.orderBy(F.desc("seq"))).head()["s"]
    assert (s.status, s.confidence, len(s.sessions), s.transitions) == replay_plain(history)


def test_fitness_reviews(spark):
    df = spark.createDataFrame([(i, "c", "s", "observation", "e") for i in range(3)], "seq long, concept string, session_id string, event_type string, evidence string")
    f = spark.createDataFrame([("c", 0, 3, 0.1)], "concept string, success int, failed int, score double")
    assert lifecycle.replay(df, f).head()["s"].status == "needs_review"


def test_decay_rounds_half_to_even(spark):
    assert one(spark, lifecycle.decayed(F.lit(5), F.lit(0.5)), a=1) == 2
    assert one(spark, lifecycle.decayed(F.lit(1), F.lit(0.1)), a=1) == 1


def test_numbered(spark):
    df = spark.range(500).select((F.col("id") * 3).alias("k"))
    assert [r.i for r in lifecycle.numbered(df, "k", "i").orderBy("k").collect()] == list(range(500))


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_length_bound_loses_nothing(a, b):
    assert similarity.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
    if a or b:
        assert similarity.ratio(a, b) <= 2 * min(len(a), len(b)) / (len(a) + len(b)) + 1e-12


def test_merge_proposals_equal_all_pairs(spark):
    names = ["red gear", "red gears", "blue gear", "blu gear", "x", "abcdefgh", "abcdefgx"]
    df = spark.createDataFrame([(i, n, i % 2) for i, n in enumerate(names)], "ord int, name string, rank int")
    got = {tuple(sorted((r.primary, r.secondary))) for r in pairs.merge_proposals(df).collect()}
    want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if SequenceMatcher(None, names[i], names[j]).ratio() >= 0.85}
    assert got == want and want


def test_recover_dedupe_leaves_no_keys_of_dropped_rows(spark):
    rows = [("l", 1, "a", "b1", "s", "t", "x"), ("l", 2, "a", "b2", "", "", ""), ("l", 3, "c", "b2", "", "", ""), ("l", 4, "d", "b4", "s", "t", "x")]
    df = spark.createDataFrame(rows, "ledger string, seq long, id string, body string, summary string, ts string, source string")
    assert {r.seq: r.kept for r in pairs.recover_dedupe(df).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_contradictions_and_conflicts(spark):
    d = spark.createDataFrame([(1, "use REST"), (2, "gRPC only"), (3, "none")], "id int, text string")
    assert [(r.a, r.b) for r in pairs.contradictions(d, [(r"rest\b", r"grpc\b", "x")]).collect()] == [(1, 2)]
    d = spark.createDataFrame([(1, "always lint", "a", ["py"]), (2, "never lint", "b", ["py"]), (3, "never", "general", [])], "id int, rule string, scope string, triggers array<string>")
    assert [(r.d1, r.d2) for r in pairs.directive_conflicts(d).collect()] == [(1, 2)]


def test_globs():
    import re

    for glob, path, ok in [("*.py", "a/b.py", True), ("/a.py", "b/a.py", False), ("docs/", "docs/x/y.md", True), ("a/**/z", "a/b/c/z", True), ("a/*/z", "a/b/c/z", False), ("b?.md", "b1.md", True)]:
        assert bool(re.search(routing.glob_regex(glob), path)) is ok


def test_directive_gate(spark):
    rows = [("fix the langgraph workflow", 1, "langgraph workflow", "follow the workflow", "x", "critical", ["langgraph"], False), ("continue the current project", 2, "current project", "r", "x", "normal", ["project"], False), ("anything", 3, "t", "r", "global", "normal", [], False)]
    df = spark.createDataFrame(rows, "task string, id int, title string, rule string, scope string, priority string, triggers array<string>, always_on boolean")
    got = {r.id: (r["class"], r.can_force) for r in routing.match_directives(df).collect()}
    assert got == {1: ("semantic_directive_match", True), 3: ("global_always_on_directive", True)}


def test_queue_caps_stop_at_the_first_violation(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate([5, 5, 90, 1])], "seq int, b int")
    assert {r.seq: r.kept for r in events.keep_within_caps(df, F.col("b"), 10, 50, F.asc("seq")).collect()} == {0: True, 1: True, 2: False, 3: False}
