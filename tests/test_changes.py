"""Indexes, vectors, histories and streams that change: against rebuilds, after failures and restarts."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import evaluation, ignore, related
from ledgerlens.operators.lifecycle import replay
from ledgerlens.sources.commits import CommitLog, Conflict
from ledgerlens.sources.concepts import ConceptStates
from ledgerlens.sources.history import History, last_items
from ledgerlens.sources.live_index import LiveIndex, whole_documents
from ledgerlens.sources.reflection import Reflections
from ledgerlens.sources.store import SearchIndex
from ledgerlens.sources.vectors import Incomplete, VectorStore, slot_embedder
from ledgerlens.streaming import sink, status

WORDS = [f"word{k}" for k in range(40)] + ["Über", "naïve"]
FILES = "source string, content_hash string, document string"


def files_of(spark, docs):
    return spark.createDataFrame([(k, str(hash(v)), v) for k, v in docs.items()], FILES)


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_commit_numbers_are_given_once(spark, tmp_path):
    log, other = (CommitLog(spark, f"file://{tmp_path}/log") for _ in range(2))
    assert log.last() == 0 and log.read() is None
    log.publish(1, {"a": 1})
    with pytest.raises(Conflict):
        other.publish(1, {"a": 2})
    other.publish(2, {"a": "é"})
    assert log.read(1) == {"a": 1} and log.read() == {"a": "é"} and log.numbers() == [1, 2]
    assert not [f for f in os.listdir(tmp_path / "log") if f.startswith("_")]


def test_updates_equal_a_rebuild(spark, tmp_path):
    r = random.Random(7)
    text = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(0, 30)))
    docs = {f"f{k}": text() for k in range(60)}
    index = LiveIndex(spark, f"file://{tmp_path}/live", 4)
    query = "word1 word2 Über word1 nowhere"
    for step in range(3):
        states = {x.state: x.n_files for x in index.update(files_of(spark, docs), whole_documents).collect()}
        if step == 1:
            assert index.compact_small() is True
        if step == 2:
            index.compact(keep=1)
        built = SearchIndex(spark, f"file://{tmp_path}/built{step}", 4).build(files_of(spark, docs).select(F.col("source").alias("chunk_id"), "document"))
        assert index.stats()["n"] == len(docs) and index.stats()["avg"] == pytest.approx(built.stats()["avg"])
        assert index.frequencies(["word1", "über", "word9"]) == built.frequencies(["word1", "über", "word9"])
        got, want = ({x.chunk_id: round(x.sparse, 9) for x in i.sparse_scores(query).collect()} for i in (index, built))
        assert got == want and len(got) > 5
        assert sum(states.values()) >= len(docs)
        gone = r.sample(sorted(docs), 5)
        docs = {k: (text() if r.random() < 0.1 else v) for k, v in docs.items() if k not in gone} | {f"g{step}-{k}": text() for k in range(4)}
    before = index.record()
    same = index.update(index.files().join(files_of(spark, {}), ["source", "content_hash"], "left").select("source", "content_hash", F.lit("unread").alias("document")), whole_documents)
    assert [x.state for x in same.collect()] == ["unchanged"] and index.record() == before
    assert index.vacuum() > 0 and {x.chunk_id: round(x.sparse, 9) for x in index.sparse_scores(query).collect()} == got
    while docs:
        docs = {}
        index.update(files_of(spark, docs), whole_documents)
    assert index.stats() == {"n": 0, "avg": None} and index.sparse_scores(query).count() == 0


def test_an_update_writes_what_changed_and_losers_nothing(spark, tmp_path):
    docs = {f"f{k}": " ".join(f"w{k}x{j}" for j in range(200)) for k in range(300)}
    index = LiveIndex(spark, f"file://{tmp_path}/live", 4)
    index.update(files_of(spark, docs), whole_documents)
    first = size_of(tmp_path)
    docs["f3"] = "another text"
    index.update(files_of(spark, docs), whole_documents)
    segment = index.record()["segments"][-1]["name"]
    assert sum(size_of(tmp_path / "live" / kind / segment) for kind in ("postings", "terms", "words", "files")) < first / 10
    assert index.frequencies(["w3x0", "another"]) == {"another": 1}
    late = LiveIndex(spark, f"file://{tmp_path}/live", 4)
    seen = late.log.last()
    late.log.last = lambda: seen  # another writer is faster
    docs["f4"] = "mine"
    index.update(files_of(spark, docs), whole_documents)
    docs["f4"] = "yours"
    with pytest.raises(Conflict):
        late.update(files_of(spark, docs), whole_documents)
    assert index.frequencies(["mine", "yours"]) == {"mine": 1}
    again = LiveIndex(spark, f"file://{tmp_path}/live", 4, config="other chunks")
    docs["f4"] = "mine"
    assert {x.state for x in again.update(files_of(spark, docs), whole_documents).collect()} == {"updated"}


def test_an_incomplete_generation_is_never_read(spark, tmp_path):
    chunks = spark.createDataFrame([("a#1", "a", "one text"), ("a#2", "a", "another text"), ("b#1", "b", "one text"), ("b#2", "b", None)], "chunk_id string, source string, document string")
    seen = []

    def embed(texts):
        seen.extend(texts)
        return slot_embedder(16)(texts)

    store = VectorStore(spark, f"file://{tmp_path}/v", "m", 16, slot_embedder(16))
    assert store.mode() == "bm25" and store.current().count() == 0
    staged = store.stage(chunks)
    assert store.current().count() == 0
    assert not any(store.problems(staged, chunks).values())
    store.publish(staged, chunks)
    assert store.mode() == "hybrid" and store.current().count() == 4
    rows = {r.chunk_id: r.vector for r in store.current().collect()}
    assert rows["a#1"] == rows["b#1"] != rows["a#2"] and sum(x * x for x in rows["a#1"]) == pytest.approx(1)
    more = chunks.unionByName(spark.createDataFrame([("c#1", "c", "a third")], chunks.schema))
    broken = VectorStore(spark, f"file://{tmp_path}/v", "m", 16, lambda texts: [[float("nan")] * 15 for _ in texts])
    with pytest.raises(Incomplete, match="wrong_dimension.*not_finite|not_finite.*wrong_dimension"):
        broken.refresh(more)
    short = store.stage(chunks.where("chunk_id != 'a#2'"))
    assert store.problems(short, chunks)["missing"] == 1 and store.problems(short, chunks.where("source = 'b'"))["surplus"] == 1
    with pytest.raises(Incomplete):
        store.publish(short, chunks)
    assert store.current().count() == 4 and store.record()["chunks"] == 4
    counted = spark.sparkContext.accumulator(0)

    def counting(texts):
        counted.add(len(texts))
        return slot_embedder(16)(texts)

    VectorStore(spark, f"file://{tmp_path}/v", "m", 16, counting).refresh(more.where("source != 'a'"))
    assert counted.value == 1 and {r.source for r in store.current().collect()} == {"b", "c"}  # only the new text; a's vectors are gone
    assert VectorStore(spark, f"file://{tmp_path}/v", "other", 16, embed).mode() == "bm25"


def test_history(spark, tmp_path):
    schema = "k string, n int, l array<int>, updated_at string"
    frame = lambda rows, at: spark.createDataFrame([(k, n, [n], at) for k, n in rows.items()], schema)
    h = History(spark, f"file://{tmp_path}/h", frame({"a": 1}, "x").schema, ["k"])
    assert h.as_of().count() == 0 and h.version() == 0
    versions = [{"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}, {"b": 3}, {"b": 3, "a": 1}]
    assert h.save(frame(versions[0], "t1"), "1") == {"new": 2, "changed": 0, "removed": 0}
    assert h.save(frame(versions[0], "later"), "1b") == {"new": 0, "changed": 0, "removed": 0} and h.version() == 1
    assert h.save(frame(versions[1], "t2"), "2") == {"new": 1, "changed": 1, "removed": 0}
    h.checkpoint("two", "why")
    assert h.save(frame(versions[2], "t3"), "3") == {"new": 0, "changed": 0, "removed": 2}
    h.save(frame(versions[3], "t4"), "4")
    read = lambda **at: {r.k: r.n for r in h.as_of(**at).collect()}
    assert [read(version=v) for v in (1, 2, 3, 4)] == versions and read(at="2z") == versions[1] and read(at="0") == {}
    spans = sorted((r.k, r.n, r.valid_from, r.valid_to) for r in h.intervals().collect() if r.k != "b")
    assert spans == [("a", 1, 1, 3), ("a", 1, 4, None), ("c", 4, 2, 3)]
    h.compact(4)
    assert read(version=2) == versions[1] and read() == versions[3]
    with pytest.raises(KeyError):
        h.as_of(3)
    assert h.restore("tw", "5") == {"new": 1, "changed": 0, "removed": 0} and read() == versions[1] and h.version() == 5
    assert [c["name"] for c in h.checkpoints()] == ["two"]
    for bad in ([("a", 1, [1], ""), ("a", 2, [2], "")], [(None, 1, [1], "")]):
        with pytest.raises(ValueError):
            h.save(spark.createDataFrame(bad, schema), "6")
    assert last_items(spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "l array<int>"), {"l": 2}).collect() == [([2, 3],), ([],), (None,)]


def test_splice_keeps_everything_else(spark):
    a = "---\nid: a\n---\nBody [[depends_on:concept_002|x]] and [[concept_002]], [[concept_099]].\n\n## Related old\n- [[mitigates:concept_003|y]]\n\n## After\n  kept\n"
    docs = [("concept_001", "first-name", a), ("concept_002", "two", "---\nid: b\n---\nnothing"), ("concept_003", "three", "no front matter"), ("concept_004", "four", None), ("concept_005", "five", "---\nx\n---\nalone ")]
    rows = spark.createDataFrame(docs, "id string, name string, text string")
    once, edges = related.splice(rows)
    out = {r.id: r for r in once.collect()}
    assert out["concept_001"].text == "---\nid: a\n---\nBody [[depends_on:concept_002|x]] and [[concept_002]], [[concept_099]].\n\n## Related Knowledge\n- [[relates_to:concept_002|Two]] — Two (Relates To)\n- [[mitigates:concept_003|Three]] — Three (Mitigates)\n\n## After\n  kept\n"
    assert out["concept_002"].text == "---\nid: b\n---\nnothing\n\n## Related Knowledge\n- [[relates_to:concept_001|First Name]] — First Name (Relates To)\n"
    assert [out[f"concept_00{k}"].text for k in (3, 4, 5)] == [docs[2][2], None, docs[4][2]]
    assert {tuple(r) for r in edges.collect()} == {("concept_001", "concept_002", "relates_to"), ("concept_002", "concept_001", "relates_to"), ("concept_001", "concept_003", "mitigates"), ("concept_003", "concept_001", "mitigated_by")}
    again = {r.id: r for r in related.splice(once.join(rows.select("id", "name"), "id").select("id", "name", "text"))[0].collect()}
    assert all(again[k].text == out[k].text and not again[k].changed for k in out)


def test_bootstrap_interval(spark):
    values = spark.createDataFrame([(k, 1.0 if k % 4 else 0.0) for k in range(400)] + [(1000, None)], "id long, value double")
    r = evaluation.interval(values, replicates=500).head()
    assert (r.n, r["mean"]) == (400, 0.75) and 0.69 < r.low < 0.73 < 0.77 < r.high < 0.81  # 0.75 within two errors of 0.0217
    again = evaluation.interval(values.repartition(7), replicates=500).head()
    assert (again.low, again.high) == (r.low, r.high)
    w = spark.range(2000).select(evaluation.weight(F.col("id"), F.lit(3)).alias("w")).agg(F.avg("w"), F.var_samp("w")).head()
    assert abs(w[0] - 1) < 0.08 and abs(w[1] - 1) < 0.15


@pytest.mark.parametrize(
    "rules, ignored, kept",
    [
        ([("", "*.log\n!keep.log")], ["a.log", "x/y.log"], ["keep.log", "x/keep.log", "a.txt"]),
        ([("", "build/\n!build/keep.txt")], ["build/keep.txt", "x/build/a"], ["build", "x/build"]),
        ([("", "/only\n"), ("sub", "!../only\n")], ["only"], ["sub/only"]),
        ([("", "a/**/b\n**/c\nd/**\n")], ["a/b", "a/x/y/b", "c", "x/c", "d/e/f"], ["a", "d", "xa/b"]),
        ([("", "[!a]?.t\n\\!x\n\\#y\n")], ["bz.t", "!x", "#y"], ["az.t", "b.t"]),
        ([("", "secret*"), ("pub", "!secret.md")], ["secret.md", "secretdir/x"], ["pub/secret.md"]),
        ([("", "")], [], ["a"]),
    ],
)
def test_ignore_rules_last_match_and_parents(spark, rules, ignored, kept):
    paths = spark.createDataFrame([(p,) for p in ignored + kept] * 2, "path string")
    got = ignore.ignored_by_rules(paths, ignore.parse_rules(spark.createDataFrame(rules, "folder string, content string")))
    assert {r.path: r.ignored for r in got.collect()} == {p: p in ignored for p in ignored + kept}


EVENT_ROWS = [(f"c{k % 5}", k, f"e{k}", f"s{k % 7}", ["validation", "failure", "observation", "decision"][k % 4], f"summary {k % 3}", "ev" if k % 2 else "") for k in range(200)]
EVENT_SCHEMA = "concept string, seq long, event_id string, session_id string, event_type string, summary string, evidence string"


def test_reassignment_replays_only_what_moves(spark, tmp_path):
    store = ConceptStates(spark, f"file://{tmp_path}/c", 8)
    store.build(spark.createDataFrame(EVENT_ROWS, EVENT_SCHEMA))
    before = {r.concept: r.s for r in store.states().collect()}
    assert store.reassign("c1", "c0", "summary 1", dry_run=True)["moved"] == 13
    assert {r.concept: r.s for r in store.states().collect()} == before
    got = store.reassign("c1", "C0", "summary 1")
    assert got == {"moved": 13, "replayed": 2, "read": 80}
    want = [(("c1", *r[1:]) if r[0] == "c0" and r[5] == "summary 1" else r) for r in EVENT_ROWS]
    full = {r.concept: r.s for r in replay(spark.createDataFrame(want, EVENT_SCHEMA)).collect()}
    assert {r.concept: r.s for r in store.states().collect()} == full
    assert store.reassign("c1", "c0", event_id="e5")["moved"] == 1 and store.reassign("c1", "c0", event_id="e5")["moved"] == 0
    store.reassign("c4", "c2")  # all of it: the concept has no state any more
    assert {r.concept for r in store.states().collect()} == {"c0", "c1", "c3", "c4"}
    assert store.events().count() == 200
    with pytest.raises(ValueError):
        store.reassign("c1")


@pytest.mark.parametrize("fails_at", ["events", "reports", "outcomes"])
def test_reflection_counts_as_a_whole(spark, tmp_path, fails_at):
    turns = spark.createDataFrame([(1, 0, "user", "decision: keep it\nfailure: it broke"), (2, 0, "user", "nothing")], "conv_id long, turn long, role string, text string")

    def fail(kind):
        if kind == fails_at:
            raise OSError(kind)

    at = f"file://{tmp_path}/r"
    with pytest.raises(OSError, match=fails_at):
        Reflections(spark, at, after=fail).reflect(turns)
    store = Reflections(spark, at)
    assert all(store.table(k).count() == 0 for k in ("events", "reports", "outcomes"))
    if fails_at == "outcomes":
        assert store.reflect(turns) == {"events": 2, "failures": 1, "sessions": 1}
        assert [store.table(k).count() for k in ("events", "reports", "outcomes")] == [2, 1, 1]
        assert store.reflect(turns)["events"] == 0 and store.table("events").count() == 2
        o = store.table("outcomes").head()
        assert (o.session_id, o.outcome, o.referenced_concepts) == ("1", "success", ["it-broke", "keep-it"])


def test_sink_survives_crashes_and_repeats(spark, tmp_path):
    event = lambda k, t: json.dumps({"event_id": k, "timestamp": t, "event_type": "decision", "confidence": 3})
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.txt").write_text("\n".join([event("1", "2024-05-01T00:00:00Z"), event("2", "2024-05-02T00:00:00Z"), event("2", "2024-05-02T00:00:00Z"), "not json", '{"event_id": 5', event("", "2024-05-02T00:00:00Z"), event("6", "someday"), "", "[1]"]))
    crashes = []

    def crash(number):
        if len(crashes) < 2:
            crashes.append(number)
            raise RuntimeError("killed")

    target = sink.LedgerSink(spark, f"file://{tmp_path}/out", "7 days", crash)
    for _ in range(2):
        with pytest.raises(Exception):
            sink.drain_lines(spark, f"file://{landing}", target, f"file://{tmp_path}/cp")
        assert target.events().count() == 0 and target.counts() == {}
    sink.drain_lines(spark, f"file://{landing}", target, f"file://{tmp_path}/cp")
    assert sorted(r.event_id for r in target.events().collect()) == ["1", "2"] and len(crashes) == 2
    (landing / "b.txt").write_text("\n".join([event("1", "2024-05-01T00:00:00Z"), event("7", "2024-04-20T00:00:00Z"), event("8", "2024-05-09T00:00:00Z")]))
    sink.drain_lines(spark, f"file://{landing}", target, f"file://{tmp_path}/cp")
    want = {"rows": 11, "events": 3, "malformed": 3, "missing id": 1, "no time": 1, "late": 1, "duplicate": 2}
    for _ in range(2):
        assert target.counts() == want
        reasons = {r.reason: r["count"] for r in target.quarantine().groupBy("reason").count().collect()}
        assert reasons == {k: v for k, v in want.items() if k not in ("rows", "events")} and target.events().count() == 3
        target.compact()
    again = spark.createDataFrame([(event("9", "2024-05-09T00:00:00Z"),)], "raw string")
    target(again, 0)  # a batch that was committed
    assert target.counts() == want
    target(again, 2)
    assert target.events().count() == 4 and target.counts()["events"] == 4


def test_stream_states_for_any_cut(spark, tmp_path):
    rows = [(c, s, ses, t, e, datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=s)) for c, s, _, ses, t, _, e in EVENT_ROWS]
    e = spark.createDataFrame(rows, "concept string, seq long, session_id string, event_type string, evidence string, ts timestamp")
    want = {r.concept: (r.s.status, r.s.confidence, r.s.failures, r.s.evidence, r.s.transitions, len(r.s.sessions)) for r in replay(e).collect()}

    def run(name, cuts, initial=None, idle_ms=0):
        out = []
        for a, b in zip([0, *cuts], [*cuts, 200], strict=True):
            e.where(F.col("seq").between(a, b - 1)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}/in")
            stream = spark.readStream.schema(e.schema).parquet(f"file://{tmp_path}/{name}/in")
            q = status.status_stream(stream, idle_ms, initial).writeStream.foreachBatch(lambda d, n: out.extend(d.collect())).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/{name}/cp").trigger(availableNow=True).start()
            q.awaitTermination()
        return out

    for name, cuts in (("one", []), ("two", [1, 77])):
        last = {r.concept: (r.status, r.confidence, r.failures, r.evidence, r.transitions, r.sessions) for r in run(name, cuts)}
        assert last == want
    before = status.replayed_states(e.where("seq < 100"))
    rows = run("resumed", [], before)  # events that the initial state has are late, not counted twice
    assert {r.concept: (r.status, r.confidence, r.failures, r.evidence, r.transitions, r.sessions) for r in rows} == want
    assert {r.late for r in rows} == {20}


def test_idle_concepts_are_told(spark, tmp_path):
    schema = "concept string, seq long, session_id string, event_type string, evidence string, ts timestamp"
    out = []
    for k, batch in enumerate(([("old", 1, "s", "decision", "x", datetime(2024, 1, 1, tzinfo=timezone.utc))], [("new", 2, "s", "decision", "x", datetime(2024, 3, 1, tzinfo=timezone.utc))], [("new", 3, "s", "decision", "x", datetime(2024, 3, 2, tzinfo=timezone.utc))])):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        status.status_stream(stream, 7 * 86_400_000).writeStream.foreachBatch(lambda d, n, k=k: out.extend((k, r.concept, r.idle) for r in d.collect())).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert ("old", True) in {x[1:] for x in out} and ("new", True) not in {x[1:] for x in out}


def test_nothing_that_is_drained_vanishes(spark, tmp_path):
    from ledgerlens.sources import ledgers

    land, at = tmp_path / "land", f"{tmp_path}/ledger"
    land.mkdir()
    (land / "a.json").write_text('{"event_id": "1", "summary": "x"}\n{"summary": "no id"}\n{"event_id": "1", "summary": "x"}\n')
    ledgers.drain(spark, str(land), at, str(tmp_path / "cp"))
    assert spark.read.json(at).count() == 1 and [r.summary for r in spark.read.json(f"{at}-rejected").collect()] == ["no id"]
    rows = spark.createDataFrame([(str(k % 3), "x", "y", str(k)) for k in range(7)], "event_id string, summary string, evidence string, timestamp string")
    ledgers.hook_sink(f"{tmp_path}/hook", 4)(rows, 0)
    kept, older = ({r.timestamp for r in spark.read.json(f"{tmp_path}/{n}").collect()} for n in ("hook", "hook-overflow"))
    assert kept == {"3", "4", "5", "6"} and older == {"0", "1", "2"}


def test_repeated_keys_and_like_files(spark):
    from ledgerlens.functions.text import front_matter
    from ledgerlens.operators.directives import discover

    rows = spark.createDataFrame([("---\na: 1\nb: 2\na: 3\na: 3\n---\nx",), ("---\n---\n",), ("none",), (None,)], "t string")
    assert [r[0] for r in rows.select(front_matter(F.col("t"))).collect()] == [{"b": "2", "a": "3"}, {}, {}, None]
    files = spark.createDataFrame([("x/AGENTS.md", "same", None), ("y/AGENTS.md", "same", None), ("link/AGENTS.md", "same", "x/AGENTS.md"), ("z.md", "no", None)], "path string, document string, real_path string")
    assert sorted(r.path for r in discover(files.drop("real_path")).collect()) == ["link/AGENTS.md", "x/AGENTS.md", "y/AGENTS.md"]
    assert sorted(r.path for r in discover(files).collect()) == ["link/AGENTS.md", "y/AGENTS.md"]


def test_fitness_counts_satisfaction_and_names(spark):
    from ledgerlens.operators import lifecycle as L

    registry = spark.createDataFrame([("c1", "Caching", ["cache", "Memo"], 3), ("c2", "Retry", ["memo"], 0)], "concept_id string, canonical_name string, aliases array<string>, evidence_count int")
    sessions = [("success", None, ["c1"], ["CACHING", "memo"]), ("failure", 0.5, ["c2", "retry"], ["c2"]), ("failure", None, None, ["c2", "stranger"]), ("abandoned", 0.9, [], ["c1"])]
    rows = spark.createDataFrame(sessions, "outcome string, goal_satisfaction double, retrieved_concepts array<string>, referenced_concepts array<string>")
    named = L.resolve_lists(rows, registry, ["retrieved_concepts", "referenced_concepts"])
    assert sorted(map(str, [r.referenced_concepts for r in named.collect()])) == ["['c1', 'c1']", "['c1']", "['c2', 'stranger']", "['c2']"]
    got = {r.concept_id: (r.retrieved, r.referenced, r.succ, r.fail, r.fitness) for r in L.fitness(named, registry).collect()}
    assert got["c1"] == (2, 2, 1, 0, 1.9)  # (1 + 0.9) / 1
    assert got["c2"] == (2, 2, 0, 2, 0.25)  # (0.5 + 0) / 2
    assert got["stranger"][:4] == (1, 1, 0, 1)


def test_review_ends_by_fitness_alone(spark):
    """Poor fitness holds a concept in review, whatever its evidence; high fitness lets it out."""
    from ledgerlens.operators import lifecycle as L

    e = spark.createDataFrame([("c", k, f"s{k}", "validation", "x") for k in range(8)] + [("d", 1, "s1", "decision", "")], "concept string, seq long, session_id string, event_type string, evidence string")
    fit = lambda good, bad, score: spark.createDataFrame([("c", good, bad, score), ("d", good, bad, score)], "concept string, success int, failed int, score double")
    status = lambda f: {r.concept: r.s.status for r in L.replay(e, f).collect()}
    assert status(fit(0, 5, 0.1)) == {"c": "needs_review", "d": "needs_review"}
    assert status(fit(0, 3, 0.1)) == {"c": "needs_review", "d": "needs_review"}  # it is held from its first event on
    assert status(fit(0, 2, 0.1)) == {"c": "canonical", "d": "candidate"}
    assert status(fit(2, 0, 1.0)) == {"c": "canonical", "d": "candidate"}  # without evidence fitness promotes nothing


def test_reading_by_scope(spark):
    from ledgerlens.operators import reading

    registry = spark.createDataFrame([("c1", "One", 2, 3), ("c2", "one ", 5, 4), ("c3", None, 1, 0)], "concept_id string, canonical_name string, confidence int, evidence int")
    outcomes = spark.createDataFrame([(1, "s1", "success"), (2, "s2", "failure"), (3, "s3", "success")], "seq long, session_id string, outcome string")
    skills = spark.createDataFrame([("b", "B", "approved"), ("a", "A", "approved"), ("z", "Z", "rejected")], "slug string, title string, status string")
    events = spark.createDataFrame([("c1",), ("lost",), (None,)], "concept string")
    health = reading.health_report(registry, events, spark.createDataFrame([("c1", "stale"), ("c2", None)], "concept string, status string"))
    assert {(r.finding, r.level, r.n) for r in health.collect()} == {("duplicate names", "warn", 1), ("no evidence", "info", 1), ("unassigned events", "warn", 1), ("unknown concepts", "error", 1), ("stale concepts", "warn", 1)}
    read = lambda scope, n=2: [tuple(r) for r in reading.read_scope(scope, registry, outcomes, skills, health, n).orderBy("section", "ord").collect()]
    assert read("project") == [("concepts", 1, "one  (20)"), ("concepts", 2, "One (6)"), ("sessions", 1, "s3 success"), ("sessions", 2, "s2 failure")]
    assert read("skills") == [("skills", 1, "a: A"), ("skills", 2, "b: B")] and len(read("health", 9)) == 5 and len(read("recent", 9)) == 3
    with pytest.raises(ValueError):
        read("everything")


def test_general_events_are_told_apart_in_blocks(spark, monkeypatch):
    from ledgerlens.operators import reading

    events = spark.createDataFrame([("1", "cache warmup"), ("2", "retry policy"), ("3", ""), ("4", None), ("5", "zebra")], "event_id string, evidence string")
    concepts = spark.createDataFrame([(k, n) for k, n in enumerate(["cache warmup", "retry policy", "cache warmup", "index rebuild"])], "concept_id long, canonical_name string")
    want = {"1": (0, "reassign"), "2": (1, "reassign"), "3": (None, "no_evidence"), "4": (None, "no_evidence"), "5": (None, "low_similarity")}
    for size in (1 << 26, 64 * 8):  # all names at once, and one at a time
        monkeypatch.setattr(reading, "BLOCK_BYTES", size)
        got = {r.event_id: (r.concept_id, r.state) for r in reading.split_general(events, concepts, slot_embedder(64)).collect()}
        assert got == want
    assert {r.state for r in reading.split_general(events, concepts.where("concept_id < 0"), slot_embedder(64)).collect()} == {"no_evidence", "low_similarity"}


def test_lookups_by_id(spark):
    from ledgerlens.operators import events as E
    from ledgerlens.operators import memory as M

    e = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 3, "bee"), ("c", 4, None)], "event_id string, seq long, evidence string")
    c = spark.createDataFrame([("x", ["b", "a", "a", "gone"]), ("y", []), ("z", None), ("w", ["c"])], "candidate string, source_event_ids array<string>")
    got = {r.candidate: (r.n_found, r.evidence) for r in E.evidence_of(c, e, 1).collect()}
    assert got == {"x": (2, ["new"]), "y": (0, []), "z": (0, []), "w": (1, [None])}
    u = spark.createDataFrame([(1, ["c"]), (2, []), (3, None)], "n int, concept_candidates array<string>")
    assert sorted(r.n for r in E.unassigned(u).collect()) == [2, 3]
    rows = spark.createDataFrame([("1", "we decided to x", 1.0, "c1"), ("2", "we decided to x", 1.0, None)], "id string, document string, base double, concept_id string")
    registry = spark.createDataFrame([("c1", "canonical", 5, 200)], "concept_id string, status string, confidence int, evidence int")
    scores = {r.id: r.final_score for r in M.rerank(M.with_registry(rows, registry), M.Targets.of("zebra")).collect()}
    assert scores["1"] == pytest.approx(scores["2"] * 0.8 * 1.3 * 1.0)
