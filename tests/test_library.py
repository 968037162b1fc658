"""Ledgers, stores, sessions, memory, source search, skills, directives and recovery on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text as T
from ledgerlens.operators import active_work as A
from ledgerlens.operators import directives as D
from ledgerlens.operators import memory as M
from ledgerlens.operators import preflight as P
from ledgerlens.operators import registry as R
from ledgerlens.operators import sessions as S
from ledgerlens.operators import skills as K
from ledgerlens.operators import source_search as SS
from ledgerlens.sources import ledgers as L
from ledgerlens.sources import store as ST


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


EV = {"event_id": "a", "event_type": "decision", "summary": "s", "evidence": "e", "confidence": 3}


def test_ledger_reads_around_what_is_corrupt(spark, tmp_path):
    lines = [json.dumps(EV), "", "{not json", json.dumps(EV | {"event_id": "b", "schema_version": 2, "confidence": None}), "[1]", json.dumps(EV | {"event_id": "c", "confidence": 9})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "user.jsonl").write_text(json.dumps(EV | {"event_id": "u"}) + "\n")
    good, bad = L.read_events(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "user.jsonl"))
    got = rows(good.select("seq", "event_id", "confidence", "scope", "schema_version"), "seq")
    assert got == [(0, "a", 3, "project", 2), (3, "b", None, None, 2), (5, "c", 5, "project", 2), (6, "u", 3, "user", 2)]
    assert rows(bad.select("line_no", "raw"), "line_no") == [(3, "{not json"), (5, "[1]")]
    assert rows(L.line_counts(L.read_lines(spark, str(tmp_path / "a.jsonl")))) == [(6, 1, 2)]
    assert L.find_event(good, "b").count() == 1 and rows(L.tail(good, 2).select("event_id")) == [("c",), ("u",)]
    with pytest.raises(KeyError):
        L.find_event(good, "zz")
    assert L.read_events(spark, str(tmp_path / "none"))[0].count() == 0
    assert rows(L.migrate(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "new")), "version") == [(1, 2), (2, 1)]
    assert L.first_ledger(spark, [str(tmp_path / "x"), str(tmp_path / "a.jsonl")]).endswith("a.jsonl")


def test_ledger_lines_are_numbered_over_blocks_and_files(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 300)):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = rows(L.read_lines(spark, str(tmp_path)).select("seq", "line_no", "raw"), "seq")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[0] for r in got] == list(range(5300)) and all(r[2][1:] == str(r[1] - 1) for r in got)


def test_ledger_appends_what_is_valid_and_new(spark, tmp_path):
    at = str(tmp_path / "ledger")
    one = spark.createDataFrame([("a", "decision", 3, None), ("b", "failure", 2, "user")], "event_id string, event_type string, confidence int, scope string")
    L.append(one, at)
    L.append_missing(one.unionByName(one.withColumn("event_id", F.concat("event_id", F.lit("2")))), L.read_events(spark, at)[0], at)
    assert sorted(r.event_id for r in L.read_events(spark, at)[0].collect()) == ["a", "a2", "b", "b2"]
    for bad in (one.withColumn("event_id", F.lit(" ")), one.withColumn("confidence", F.lit(0)), one.withColumn("scope", F.lit("moon"))):
        with pytest.raises(ValueError):
            L.append(bad, at)
    land = tmp_path / "land"
    land.mkdir()
    (land / "p.json").write_text("\n".join(json.dumps(EV | {"event_id": x}) for x in ("a", "new", "new")))
    for _ in range(2):
        L.drain(spark, str(land), at, str(tmp_path / "cp"))
    assert sorted(r.event_id for r in L.read_events(spark, at)[0].collect()) == ["a", "a2", "b", "b2", "new"]
    L.hook_sink(str(tmp_path / "hook"), 1)(spark.createDataFrame([("1", "x", "token = abcdefgh12345"), ("2", "y", "z" * 3000)], "event_id string, summary string, evidence string").withColumn("timestamp", F.col("event_id")), 0)
    assert rows(spark.read.json(str(tmp_path / "hook")).select("event_id", F.length("evidence"))) == [("2", 2000)]


def test_chunk_store_and_incremental_index(spark, tmp_path):
    store = ST.ChunkStore(spark, str(tmp_path / "store"), 4)
    files = lambda **d: spark.createDataFrame([(s, f"h-{t}", t) for s, t in d.items()], "source string, content_hash string, document string")
    chunk = lambda f: f.select(F.concat("source", F.lit("#0")).alias("chunk_id"), "source", "document", "content_hash")
    states = lambda d: dict(rows(ST.index_update(store, d, chunk)))
    assert states(files(a="red plate", b="blue bolt", c="hot anvil")) == {"new": 3}
    assert states(files(a="red plate", b="green bolt", d="cold anvil")) == {"unchanged": 1, "updated": 1, "deleted": 1, "new": 1}
    assert rows(store.scan().select("source", "document"), "source") == [("a", "red plate"), ("b", "green bolt"), ("d", "cold anvil")]
    assert rows(store.of_source("b").select("document")) == [("green bolt",)] and store.count() == 3
    store.upsert(spark.createDataFrame([("a#0", "a", "red dish", "x"), ("a#1", "a", "more", "x")], "chunk_id string, source string, document string, content_hash string"))
    assert rows(store.count_by_source(), "source") == [("a", 2), ("b", 1), ("d", 1)]
    store.delete(spark.createDataFrame([("a#1",)], "chunk_id string"))
    store.replace_source(spark.createDataFrame([("d#9", "d", "nine", "y")], "chunk_id string, source string, document string, content_hash string"))
    assert rows(store.scan().select("chunk_id"), "chunk_id") == [("a#0",), ("b#0",), ("d#9",)]
    store.delete(spark.createDataFrame([("b",)], "source string"))
    assert store.count() == 2


def test_search_index_equals_scores_of_a_scan(spark, tmp_path):
    from ledgerlens.operators.ranking import sparse_scores

    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(["red plate red", "blue bolt and a red gear", "", "plate", "nothing here at all"])], "chunk_id string, document string")
    index = ST.SearchIndex(spark, str(tmp_path / "ix"), 8)
    assert not index.ready() and index.build(docs).ready()
    got = {r.chunk_id: round(r.sparse, 9) for r in index.sparse_scores("red Plate red x").collect()}
    want = {r.chunk_id: round(r.sparse, 9) for r in sparse_scores(docs, "red Plate red x").where("sparse > 0").collect()}
    assert got == want and index.sparse_scores("zzz").count() == 0
    plan = index._of("postings", ["red"])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [red])]" in plan or "term" in plan


def test_bundles_and_versions(spark, tmp_path):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "event_id string, v string")
    ST.export_bundle({"events": a}, str(tmp_path / "bundle"))
    got = ST.import_bundle(spark, str(tmp_path / "bundle"), {"events": a.limit(1)}, {"events": "event_id"})
    assert rows(got["events"]) == [("2", "y")]
    at = str(tmp_path / "registry")
    assert ST.latest_version(spark, at) is None and ST.save_version(a, at) == 1 and ST.save_version(a.unionAll(a), at) == 2
    with pytest.raises(ValueError):
        ST.save_version(a.limit(1), at)
    assert ST.load_version(spark, at).count() == 4 and ST.load_version(spark, at, 1).count() == 2


def test_source_types(spark):
    want = {"build/tests/test_a.py": "generated_or_cache", "src/adapter/x.py": "adapter_code", "notes.md": "unknown", "x.bin": "unknown", "docs/a.md": "project_doc", "README.md": "readme_doc", "x/AGENTS.md": "agent_instruction", "conf/a.toml": "config_file", "tests/test_a.py": "unrelated_test", "src/service_a.go": "service_code", "client/x.ts": "client_code", "src/m.rs": "implementation_code", "docs/a.json": "project_doc", ".json": "unknown"}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.t for r in df.select("p", SS.source_type(F.col("p"), F.lit(False)).alias("t")).collect()} == want
    assert df.where("p = 'tests/test_a.py'").select(SS.source_type(F.col("p"), F.lit(True)).alias("t")).head().t == "relevant_test"
    assert rows(df.where("p IN ('src/m.rs', 'conf/a.toml')").select(SS.language(F.col("p")), SS.file_type(F.col("p"))), "p") == [("toml", "config"), ("rust", "code")]


def test_source_search(spark):
    i = SS.Intent.of("fix chat.ask timeout in get_notebook README.md")
    assert i.identifiers == ["README", "chat.ask", "get_notebook"] or i.identifiers == ["chat.ask", "get_notebook"]
    assert i.debug and not i.config and i.path() is None and SS.Intent.of("src/a.py").path() == "src/a.py"
    docs = [("src/client.py", "def get_notebook():\n  pass", 0.6), ("docs/a.md", "get_notebook is described", 0.9), ("src/other.py", "nothing", 0.0), ("tests/test_n.py", "get_notebook()", 0.2), ("build/x.py", "get_notebook", 1.0)]
    df = spark.createDataFrame([(f"{p}#1", p, d, b) for p, d, b in docs], "chunk_id string, rel_path string, document string, base double")
    got = [(r.rel_path, r.source_type, r.score) for r in SS.search_sources(df, "where is get_notebook", 5).collect()]
    # 0.6 base + 3 identifier + 4 definition + 2 one match + 6 client; 0.2 + 3 + 2 + 2 test; 0.9 + 3 + 2 - 8 and 1 + 3 + 2 + 5 - 15 are out
    assert got == [("src/client.py", "client_code", 15.6), ("tests/test_n.py", "relevant_test", 7.2)]
    assert SS.search_sources(df, "src/other.py").head().rel_path == "src/other.py"
    assert SS.search_status(df.limit(0), df) == "not_indexed" and SS.search_status(df, df.limit(0)) == "no_relevant_source_results"
    text = spark.createDataFrame([("f", "a\nb\nc\nd")], "rel_path string, document string")
    assert rows(SS.read_range(text, "f", 2, 3, content_hash="old")) == [("f", 2, 3, "b\nc", ["stale_hash"])]
    assert rows(SS.read_range(text, "f", 2, 9, most_lines=2)) == [("f", 2, 3, "b\nc", ["truncated"])]


def test_text_helpers(spark):
    one = lambda e, **c: spark.createDataFrame([tuple(c.values())], list(c)).select(e.alias("x")).head().x
    assert one(T.unique_ci(F.split("a", " ")), a="Foo bar FOO Bar baz") == ["Foo", "bar", "baz"]
    assert one(T.symbols(F.col("a"), 2), a="abc ABC de fgh xyz") == ["abc", "fgh"]
    assert one(T.components_of(F.col("a")), a="getNotebook_ids the") == ["getnotebook_ids", "get", "notebook", "ids"]
    assert one(T.phrase_normalized(F.col("a")), a="Don't: modify THE plate!") == "don't modify plate"
    assert one(T.canonical_json(F.create_map(F.lit("b"), F.col("a"), F.lit("a"), F.lit("2"))), a="1") == '{"a":"2","b":"1"}'
    assert one(T.as_list(F.col("a")), a="x, y,,z") == ["x", "y", "z"] and one(T.title_of(F.col("a")), a="red-big_plate") == "Red Big Plate"
    assert one(T.is_text(F.col("a")), a=bytearray(b"abc")) is True and one(T.is_text(F.col("a")), a=bytearray(b"a\x00c")) is False and one(T.is_text(F.col("a")), a=bytearray(b"\xff\xfe")) is False


def test_header_chunks_drop_front_matter_and_empty_sections(spark):
    from ledgerlens.operators.chunking import header_chunks

    df = spark.createDataFrame([(1, "---\na: b\n---\nintro\n# One\nbody\n## Empty\n## Two\nx"), (2, "# Only\n## Heads"), (3, " ")], "id int, text string")
    assert rows(header_chunks(df, "id", F.col("text")).select("id", "title"), "id", "chunk_idx") == [(1, "Introduction"), (1, "One"), (1, "Two"), (2, "Full Document")]


def test_memory_types_and_ranking(spark):
    want = {"Failure: x": "failure", "## Decision\ny": "decision", "- **Outcome**: z": "outcome", "Handoff: a": "technical_handoff", "Debug note: a": "debug_note", "Debug: a": "failure", "a workaround": "workaround", "see session-handoff.md for the error": "technical_handoff", "I prefer it": "preference", "tried it": "episodic", "File contents: q": "source_dump", "Command output: q": "command_log", "Search results: q": "search_log", "it is the open project": "active_work_signal", "plain": "observation", "```\nFailure: x\n```\nplain": "observation"}
    df = spark.createDataFrame([(d,) for d in want], "d string")
    assert {r.d: r.t for r in df.select("d", M.memory_type(F.col("d")).alias("t")).collect()} == want
    t = M.Targets.of("fix the timeout of get_notebook in notes/plan.md")
    assert t.paths == ["notes/plan.md"] and t.identifiers == ["get_notebook"] and t.technical and "fix" in t.generic and "timeout" in t.semantic
    docs = [("1", "Decision: we decided to retry get_notebook on timeout", "project"), ("2", "Decision: paint it red", None), ("3", "unrelated words", "user"), ("4", "see notes/plan.md", None)]
    c = spark.createDataFrame(docs, "id string, document string, scope string").withColumn("base", F.lit(0.1)).withColumn("timestamp", F.lit("2024-01-02"))
    r = {x.id: x for x in M.rerank(c, t).collect()}
    # identifier 2.5 + type 4 + topic min(2, .5 * 3 or more) + co-occurrence 2.5 + with term 3 + decision phrase 5
    assert r["1"].boosts["type"] == 4.0 and r["1"].boosts["identifier_cooccurrence"] == 2.5 and r["1"].boosts["exact_decision_phrase"] == 5.0
    assert not r["2"].eligible and "type" not in r["2"].boosts and r["4"].boosts["exact_path_match"] == 6.0
    assert [x.id for x in M.search(c, t.query, 5).collect()][:2] == ["1", "4"]
    assert [x.id for x in M.search(c, t.query, 5, scope="project").collect()] == ["1", "4"]
    assert M.search(c, t.query, 5, since="2025-01-01").count() == 0
    assert {x.id: x.w for x in M.rerank(c, t).select("id", M.weak(t).alias("w")).collect()} == {"1": None, "2": "below_relevance_floor", "3": "no_overlap", "4": None}
    assert {x.id: x.w for x in M.rerank(c, t).select("id", M.relevance(t).alias("w")).collect()}["1"] == "strong"
    assert M.is_continuation("please continue this project", generic=True) and not M.is_continuation("paint it")
    reg = spark.createDataFrame([("c1", "Red Plate", ["dish"], "", "high"), ("c2", "blue bolt", [], "red", "low")], "concept_id string, canonical_name string, aliases array<string>, text string, importance string")
    assert rows(M.registry_search(reg, "red plate"), F.desc("score")) == [("c1#fallback", "Red Plate", pytest.approx(0.94)), ("c2#fallback", "blue bolt", pytest.approx(0.24))]
    assert M.registry_search(reg, "Dish").head().score == pytest.approx(0.82)
    bad = spark.createDataFrame([("", "d", 1.0, "odd", None)], "id string, document string, score double, memory_type string, scope string")
    assert bad.select(M.record_issues(bad).alias("x")).head().x == ["fatal: no id", "warning: unknown type"]


FACTS = {"blocked": False, "error": False, "generic": False, "n_conflicts": 0, "active_item": False, "continuation": False, "strong": False, "medium": False, "all_weak": True, "best": 0.0, "best_kind": "skill", "best_type": "", "forcing": False, "semantic_directive": 0.0, "work_score": 0.0, "n_memory": 0, "top5": 0.0}


@pytest.mark.parametrize(("facts", "want"), [
    ({}, "noop"), ({"blocked": True, "strong": True}, "blocked"), ({"error": True}, "error"), ({"generic": True, "n_conflicts": 3}, "required"), ({"generic": True, "strong": True}, "suggest"), ({"strong": True}, "required"), ({"best": 8.0}, "required"), ({"best": 8.0, "best_kind": "memory", "best_type": "observation"}, "noop"), ({"forcing": True}, "required"), ({"continuation": True, "active_item": True}, "required"), ({"best": 4.0}, "suggest"), ({"best": 4.0, "best_kind": "memory"}, "noop"), ({"medium": True, "all_weak": False}, "suggest"), ({"semantic_directive": 4.0}, "suggest"), ({"work_score": 2.0}, "suggest"), ({"n_memory": 3, "all_weak": False, "top5": 8.0}, "suggest"), ({"n_conflicts": 3}, "required"), ({"n_conflicts": 2}, "suggest"),
])
def test_preflight_rules(spark, facts, want):
    s = spark.createDataFrame([("t", *(FACTS | facts).values())], ["task", *FACTS])
    assert P.decide(s).head().decision == want


def test_preflight_context(spark):
    assert P.clamp(None) == (8, []) and P.clamp(99) == (20, ["limit 99 taken as 20"]) and P.clamp(0)[0] == 1
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    text = lambda n: spark.range(1).select(P.render(F.lit("t"), F.lit("suggest"), F.lit("r"), arr("s1", "s2", "s3", "s4"), arr("c", "c"), arr(), arr("z"), most_chars=n).alias("x")).head().x
    assert "s3" in text(6000) and "s4" not in text(6000) and text(6000).count("- search: c") == 1 and "memory" not in text(6000)
    assert len(text(60)) <= 60 and text(60).endswith("[context truncated]")
    m = spark.createDataFrame([("t", "memory", "decision", 0, 5.0), ("t", "concept", "", 1, 5.0), ("t", "skill", "", 2, 1.0)], "task string, kind string, type string, ord int, score double")
    assert rows(P.best_match(m)) == [("t", 5.0, "concept", "")]
    found = P.candidates("paint plate", spark.createDataFrame([("c1", "a plate"), ("c2", "none")], "chunk_id string, document string"))
    assert [r.id for r in found.collect()] == ["c1"] and P.matched_memory("paint plate", found).head().reason == "topic"


def test_sessions(spark):
    t = spark.createDataFrame([("1", 0, "user", "- [x] Decision: use it\nnothing"), ("1", 1, "assistant", "dec: use it\n2. exp : ran"), ("2", 0, "user", "Fixed the bolt."), ("3", 0, "user", "plain")], "conv_id string, turn int, role string, text string")
    kept, counters = S.extract(t, verbs=True)
    assert rows(kept.select("session_id", "event_type", "summary"), "session_id", "event_type") == [("1", "decision", "use it"), ("1", "experiment", "ran"), ("2", "observation", "Fixed the bolt.")]
    assert rows(counters, "session_id") == [("1", 3, 0, 0, 1, 2), ("2", 1, 0, 0, 0, 1)]
    given = spark.createDataFrame([("1", "failure", "c", "it broke", "log", 0.8, "diff")], "session_id string, event_type string, concept string, summary string, evidence string, confidence double, source string")
    assert rows(S.extract(t, given)[0].select("session_id", "event_type", "confidence")) == [("1", "failure", 4)]
    assert S.extract(t, given, mode="skip")[0].count() == 0 and S.extract(t, given, mode="markers")[0].count() == 2
    m = spark.createDataFrame([("1", 0, '{"role": "user", "content": "hi"}'), ("1", 1, "junk")], "conv_id string, turn int, raw string")
    assert rows(S.transcript(m, "messages")) == [("1", 0, "user", "hi")]
    md = spark.createDataFrame([("9", "## User\nhi\n## Agent\nyes\nno\n")], "conv_id string, raw string")
    assert rows(S.render(S.transcript(md, "markdown"))) == [("9", "User: hi\nAgent: yes\nno")]
    g = [(i, f"thing {i} was decided", "x" * 30, 3) for i in range(22)] + [(30, "Thing 1 was DECIDED", "x" * 30, 3), (31, "$ ls", "", 1), (32, "short", "e", 3), (33, "low is fine", "", 1)]
    got = {r.seq: r.refused for r in S.inline_gate(spark.createDataFrame([("s", *x) for x in g], "session_id string, seq int, summary string, evidence string, confidence int")).collect()}
    assert got[19] is None and got[20] == got[21] == got[33] == "rate_limit" and got[30] == "duplicate" and got[31] == "command_log" and got[32] == "weak_evidence"
    old = spark.createDataFrame([("1", 0.0, None), ("7", 0.0, None), ("8", 0.0, 5.0)], "session_id string, started_at double, ended_at double")
    assert rows(S.close_stale(old, t, F.lit(1e6)), "session_id") == [("1", "success", "recovered_transcript"), ("7", "abandoned", "no_transcript")]


def test_reports_round_trip(spark):
    ev = '[{"type":"decision","concept":"c","evidence":"e","confidence":3}]'
    df = spark.range(1).select(R.report(F.lit("2024-01-01"), F.lit("p"), F.lit(ev)).alias("d"))
    assert [tuple(x) for x in df.select(R.report_events(F.col("d")).alias("x")).head().x] == [("decision", "c", "e", 3)]
    empty = spark.range(1).select(R.report(F.lit("2024-01-01"), F.lit("p"), F.lit("[]")).alias("d"))
    assert empty.select(R.is_empty_report(F.col("d")).alias("x")).head().x and not df.select(R.is_empty_report(F.col("d")).alias("x")).head().x


def test_staleness_has_six_outcomes(spark):
    sessions = spark.createDataFrame([(f"s{i}", i) for i in range(8)], "session_id string, idx long")
    c = [("a", 1.0, "s1", "t", "search", []), ("b", 1.0, "s7", "t", "search", []), ("c", 1.0, "gone", "t", "search", []), ("d", 5.0, "", None, None, []), ("e", 50.0, "", None, "unknown", None), ("f", None, "", None, "", []), ("g", 1.0, "", None, None, ["s0", "s2", "x"]), ("h", 1.0, "now", "t", "s", [])]
    df = spark.createDataFrame(c, "concept string, created_at double, last_session string, last_at string, last_source string, sessions array<string>")
    got = rows(R.staleness(df, sessions, 5, 10.0, "now"), "concept")
    assert got == [("a", "stale", "high", 6), ("c", "reference_session_missing", "unknown", None), ("d", "legacy_no_reference_metadata", "unknown", None), ("e", "never_referenced_since_tracking_enabled", "unknown", None), ("f", "reference_metadata_missing", "unknown", None), ("g", "stale", "legacy", 5)]
    assert [r[0] for r in rows(R.staleness(df, sessions.limit(3), 5, 10.0), "concept")] == ["b", "c", "d", "e", "f", "h"]


def test_drift_clean_and_repair(spark):
    reg = spark.createDataFrame([("concept_001", "Plate", ["e1"]), ("concept_004", "plate ", []), ("x", "Log", [])], "concept_id string, canonical_name string, source_event_ids array<string>")
    wiki = R.wiki_documents(spark.createDataFrame([("w/concept_001.md", "# Plate"), ("w/concept_009.md", "no head"), ("w/concept_008.md", "---\ntitle: T\n---\n")], "path string, document string"))
    events = spark.createDataFrame([("e1", 0, "b", "s", "chat", "c"), ("e2", 1, "b", "s", "chat", "c"), ("e3", 2, "z", "Session Learning Report", "chat", None)], "event_id string, seq int, body string, summary string, source string, concept string")
    assert rows(R.drift(reg, wiki, events), "code", "key") == [("AMBIGUOUS_ORPHAN", "concept_009"), ("DUPLICATE_NAME", "plate"), ("ID_GAP", "concept_002"), ("ID_GAP", "concept_003"), ("MISSING_WIKI_FILE", "concept_004"), ("ORPHAN_WIKI_CONCEPT", "concept_008"), ("UNMATERIALIZED_EVENT", "e2")]
    found = R.clean(reg, events)
    assert rows(found, "code") == [("duplicate_event", "e2", True), ("self_ingestion", "e3", True), ("suspicious_concept", "x", False)]
    kept, gone = R.repaired(events, found)
    assert rows(kept.select("event_id")) == [("e1",)] and rows(gone.select("event_id", "code"), "event_id") == [("e2", "duplicate_event"), ("e3", "self_ingestion")]
    R.guard(["/p/a"], "/p")
    for bad in ("/q/a", "/p/../a", "/p/.git/x"):
        with pytest.raises(PermissionError):
            R.guard([bad], "/p")


def test_materialize_dream_and_text(spark):
    reg = spark.createDataFrame([("c", "emerging", 2, 0, 1, ["s0"], ["e0"])], "concept string, status string, confidence int, failures int, evidence int, sessions array<string>, source_event_ids array<string>")
    ev = spark.createDataFrame([(0, "e0", "s0", "c", "validation", "x", "", "chat"), (1, "e1", "s1", "c", "validation", "x", "", "chat"), (2, "e2", "s2", "d", "observation", "x", "", "chat"), (3, "e3", "s2", "index", "decision", "x", "", "chat"), (4, "e4", "s3", "c", "failure", "", "noise", "chat"), (5, "e5", "s2", "k", "deprecation", "", "", "chat")], "seq int, event_id string, session_id string, concept string, event_type string, evidence string, summary string, source string")
    out, flagged = R.materialize(reg, ev, F.col("summary") == "noise")
    assert rows(out.select("concept", "status", "confidence", "evidence", "source_event_ids", "n_new"), "concept") == [("c", "validated", 3, 2, ["e0", "e1"], 1), ("d", "emerging", 1, 1, ["e2"], 1), ("index", "emerging", 1, 1, ["e3"], 1)]
    assert rows(flagged) == [("index",)]
    day = 86400.0
    d = spark.createDataFrame([("a", "emerging", 4, 5, ["1", "2", "3"], 0.0), ("b", "validated", 4, 1, ["1"], 60 * day)], "concept string, status string, confidence int, evidence int, sessions array<string>, updated_at double")
    assert rows(R.dream(d, 60 * day, 40), "concept") == [("a", "validated", 1, "promote", True), ("b", "archived", 4, "archive", True)]
    e = spark.createDataFrame([("body\n\n## Learnings\n- old", ["Use it.", "use it", "New"])], "b string, l array<string>")
    assert e.select(R.evolved_text(F.col("b"), F.col("l")).alias("x")).head().x == "body\n\n## Learnings\n- Use it.\n- New"
    names = spark.createDataFrame([(1, "c1", "plan.md"), (2, "c2", "plan"), (3, "c3", "other")], "ord int, concept string, name string")
    files = spark.createDataFrame([("x/Plan.md",), ("y/other.py",), ("z/no.py",)], "path string")
    assert rows(R.file_concepts(files, names), "path") == [("x/Plan.md", "c1"), ("y/other.py", "c3")]
    states = spark.createDataFrame([("k", "handoff", 5, "h"), ("k", "working_set", 5, "w"), ("j", "handoff", 9, "h"), ("j", "working_set", None, "w")], "key string, origin string, at int, payload string")
    assert rows(R.resume(states).select("key", "payload"), "key") == [("j", "h"), ("k", "w")]


def test_skills(spark):
    tx = spark.createDataFrame([(["No. When it rains, stay", "You should ensure x"],), ([None, "plain"],)], "t array<string>")
    assert rows(tx.select(K.trigger(F.col("t")), K.behavior(F.col("t")))) == [("When it rains", "Should ensure x."), ("", "")]
    ev = spark.createDataFrame([("c", f"e{i}", s, d, i, "when it rains you should stay", "") for i, (s, d) in enumerate([("s1", "d1"), ("", "d2"), ("s3", "d3")])], "concept string, event_id string, session_id string, day string, seq int, summary string, evidence string")
    out = spark.createDataFrame([(0, "s1", "d9", "success", ["c"]), (1, "s1", "d1", "success", ["other"]), (2, "s9", "d2", "failure", ["c"]), (3, "", "d3", "success", [])], "seq int, session_id string, day string, outcome string, concepts array<string>")
    assert rows(K.evidence_outcomes(ev, out), "event_id", "outcome_seq") == [("c", "e0", 0, "success"), ("c", "e1", 2, "failure"), ("c", "e2", 3, "success")]
    con = spark.createDataFrame([("c", "Stay Dry", "emerging")], "concept string, title string, status string")
    pairs = K.evidence_outcomes(ev, out)
    assert rows(K.evidence_counts(ev, out)) == [("c", pairs.count(), pairs.where("outcome = 'success'").count())]
    got = K.candidates(con, ev, out).head()  # "Should stay." has 12 characters
    assert (got.slug, got.n_events, got.n_success, got.trigger, got.behavior, got.confidence) == ("stay-dry", 3, 2, "When it rains you should stay", "Should stay.", "high")
    assert K.candidates(con, ev.where("seq < 2"), out).head().confidence == "medium"
    assert K.candidates(con, ev.where("seq = 1"), out).head().confidence == "low"  # one event, no success
    assert K.candidates(con, ev.where("seq = 1"), out, relaxed=False).count() == 0 == K.candidates(con.withColumn("status", F.lit("canonical")), ev.where("seq = 1"), out).count()
    short = ev.withColumn("summary", F.lit("if so, avoid it, and so on"))
    assert (lambda r: (r.trigger, r.behavior, r.confidence))(K.candidates(con, short, out).head()) == ("If so", "Avoid it.", "low")
    assert K.candidates(con, ev.withColumn("source", F.lit("diff")), out).count() == 0
    print_ = spark.createDataFrame([("other", [], got.fingerprint)], "slug string, evidence array<string>, fingerprint string")
    assert K.candidates(con, ev, out, print_).count() == 0
    for taken in (("stay-dry", []), ("other", ["e0", "e1"])):
        assert K.candidates(con, ev, out, spark.createDataFrame([taken], "slug string, evidence array<string>")).count() == 0
    sk = spark.createDataFrame([("a", "candidate"), ("b", "rejected"), ("c", "approved")], "slug string, status string")
    ch = spark.createDataFrame([("a", "approved", None), ("b", "approved", None), ("c", "superseded", "a")], "slug string, to string, by string")
    assert rows(K.transition(sk, ch), "slug") == [("a", "approved", None, None), ("b", "rejected", None, "no way from rejected to approved"), ("c", "superseded", "a", None)]
    assert rows(K.usable_skills(sk).select("slug"), "slug") == [("a",), ("c",)]
    md = spark.range(1).select(F.lit("k/approved/stay-dry.md").alias("path"), K.as_markdown(F.lit("Stay Dry"), F.lit("approved"), F.lit("when it rains"), F.lit("stay"), F.array(F.lit("a"), F.lit("b"))).alias("document"))
    md = md.unionByName(spark.createDataFrame([("k/candidates/stay-dry.md", "# Other"), ("k/candidates/x.md", "# Title\n\nFirst words.")], "path string, document string"))
    assert rows(K.scan(md).select("slug", "title", "trigger", "behavior", "tags", "status"), "slug") == [("stay-dry", "Stay Dry", "when it rains", "stay", ["a", "b"], "approved"), ("x", "Title", "", "First words.", [], "candidate")]


def test_directives(spark):
    doc = "---\nalways_on: true\ntriggers: [paint]\n---\nintro\n## Big Rules\n- [x] You must never delete src/*.py files\n```\n- never in code here\n```\n1. short\nplates should be red always"
    files = spark.createDataFrame([("a/AGENTS.md", doc, None), ("b/AGENTS.md", doc, "a/AGENTS.md"), ("x.md", doc, None), ("r/rules/z.md", "- do not touch this thing", None)], "path string, document string, real_path string")
    assert rows(D.discover(files).select("path"), "path") == [("a/AGENTS.md",), ("r/rules/z.md",)]
    got = rows(D.parse(D.discover(files)).select("path", "line_no", "title", "rule", "scope", "priority", "globs", "always_on"), "path", "line_no")
    assert got == [("a/AGENTS.md", 7, "Big Rules", "You must never delete src/*.py files", "big_rules", "critical", ["src/*.py"], True), ("a/AGENTS.md", 12, "Big Rules", "plates should be red always", "big_rules", "normal", [], True), ("r/rules/z.md", 1, "General", "do not touch this thing", "general", "normal", [], False)]
    one = D.parse(files.where("path = 'a/AGENTS.md'")).orderBy("line_no").head()
    assert "paint" in one.triggers and "never" not in one.triggers and one.forbidden[0].startswith("delete_src")
    old = spark.createDataFrame([("x.md", "0"), ("gone", "1")], "path string, hash string")
    assert rows(D.stale(old, files), "path") == [("gone", "missing"), ("x.md", "changed")]
    m = spark.createDataFrame([("t1", 1, "general"), ("t1", 2, "workflow_x"), ("change the tool config", 1, "general")], "task string, rank int, scope string")
    assert rows(D.workflow(m, [([["tool"], ["config", "adapter"]], "workflow_tool")]), "task") == [("change the tool config", "workflow_tool"), ("t1", "workflow_x")]
    assert D.render(D.parse(files)).head().text.startswith("- [critical] You must")


def test_active_work(spark):
    vals = {"/home/x/.kb": "memory_root", "/home/x/repo": "workspace_root", "src/a.py": "active_work_item", "notes.md": "active_work_item", "fix the bolt": "active_task", "Red plates": "active_topic", "": "unknown", "a b c d e f g h": "unknown"}
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert {r.v: r.s for r in df.select("v", A.shape(F.col("v")).alias("s")).collect()} == vals
    tx = spark.createDataFrame([("k", "- Project: Red plates\nNext action: write docs/x.md now\nActive file: src/a.py")], "key string, text string")
    got = rows(A.labelled(tx).select("field", "value", "confidence"), "field", "value")
    assert got == [("active_task", "write docs/x.md now", "medium"), ("active_topic", "Red plates", "high"), ("active_work_item", "docs/x.md", "medium"), ("active_work_item", "src/a.py", "high")]
    assert rows(A.from_json(spark.createDataFrame([("k", '{"active_file": "b.py", "project": ""}')], "key string, raw string"))) == [("k", "active_work_item", "b.py", "medium")]
    c = A.labelled(tx).withColumn("source", F.col("label")).withColumn("ord", F.lit(0))
    picked = A.identity(c)
    assert rows(picked, "field")[2] == ("k", "active_work_item", "src/a.py", "active file", 2, "warning")
    assert rows(A.legacy_project(picked)) == [("k", "src/a.py", "active file", "warning")]
    p = spark.createDataFrame([("C:\\a\\b\\",), ("//wsl$/U/home/x",), ("/a//b/",)], "p string")
    assert [r.x for r in p.select(A.path(F.col("p")).alias("x")).collect()] == ["/mnt/c/a/b", "/home/x", "/a/b"]
    todos = spark.createDataFrame([("l", 0, "a", "in_progress"), ("l", 1, "b", "pending"), ("l", 2, "c", "pending")], "list string, ord int, id string, status string")
    done = A.todo_advance(todos, spark.createDataFrame([("l", "a", "")], "list string, id string, status string"))
    assert rows(done.select("id", "status"), "ord") == [("a", "completed"), ("b", "in_progress"), ("c", "pending")]


def test_sessions_of_a_stream_equal_the_batch(spark, sf_dir):
    from ledgerlens.sources.tables import event_ledger

    got = S.sessionized(event_ledger(spark, sf_dir))
    assert got.agg(F.sum("n")).head()[0] == event_ledger(spark, sf_dir).count()


