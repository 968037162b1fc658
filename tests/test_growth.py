"""Steps whose work follows the input: each is compared with a plain way, on rows that are odd."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerlens.functions import text as T


def test_many_queries_in_one_pass(spark, monkeypatch):
    from ledgerlens.operators import batch_search, ranking

    monkeypatch.setattr(batch_search, "QUERIES", 5)
    monkeypatch.setattr(batch_search, "CELLS", 40)
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(["ä", "ab", "abc", "de", "x", "fgh", "ij"]) for _ in range(n))
    items = [(i, text(r.randint(0, 12))) for i in range(11)] + [(20, None), (21, "not there at all in any text ever"), (22, "ab ab abc")]
    docs = [(i, text(r.randint(0, 30)) + " " + (items[i % 11][1] or "")) for i in range(60)] + [(60, None), (61, ""), (7, text(9)), (None, text(8)), (62, "ab ab abc"), (63, "ab ab abc")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).select("doc_id", T.tokens(F.col("text")).alias("w"))
    b = spark.createDataFrame(items, "item_id long, text string").select("item_id", T.tokens(F.col("text")).alias("w"))
    relevant, found = batch_search.evaluate(d, b)

    key = b.where(F.size("w") >= 8).select("item_id", F.array_join(F.slice("w", 1, 8), " ").alias("key"))
    want = d.select("doc_id", F.explode(T.ngrams(F.col("w"), 8)).alias("key")).join(key, "key").select("item_id", "doc_id").distinct()
    assert sorted(map(str, relevant.collect())) == sorted(map(str, want.collect())) and want.count() > 10
    post = d.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    s = d.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avg")).head()
    terms = b.select("item_id", F.explode(F.slice("w", 1, 6)).alias("term")).where(F.length("term") > 1).groupBy("item_id", "term").agg(F.count("*").alias("times"))
    weight = F.col("times") * ranking.bm25_weight(F.col("tf"), F.col("df"), F.lit(s["n"]), F.col("dl"), F.lit(s["avg"]))
    scored = terms.join(df, "term").join(post, "term").groupBy("item_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
    plain = ranking.top_k(scored, 5, F.desc("score"), F.asc("doc_id"), partition=["item_id"]).select("item_id", "rank", "doc_id", "score")
    assert sorted(map(str, found.select("item_id", "rank", "doc_id", "score").collect())) == sorted(map(str, plain.collect())) and plain.count() > 50


def test_evaluation_shuffles_no_postings(spark, sf_dir, capsys):
    from ledgerlens.plans import retrieval

    retrieval.evaluated(spark, sf_dir)
    docs, bench = (retrieval.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    words = T.tokens(F.col("text")).alias("w")
    retrieval.evaluate(docs.select("doc_id", words), bench.select("item_id", words))[1].explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan and "Join" not in plan


def test_types_by_their_words(spark):
    """The rules as plain patterns, on texts put together from pieces that nearly match."""
    import re

    from ledgerlens.operators import memory as M

    pieces = ["## Failure\n", "**Decision**:", "outcome :", "\n", " ", "x", "```", "Do-not-repeat", "breaking", "BUG:", "Technical  Note:", "Handoff:", "Debug:", "work", "around", "session-handoff.md", "fix", "ERROR", "Don't", "liked", "like", "last time", "tried", "cat  <<EOF", "Command `", "command output:", "search result:", "working on", " \u212aelvin ", "knowledge_read("]
    r = random.Random(5)
    texts = ["".join(r.choice(pieces) + r.choice(["", " ", "\n"]) for _ in range(r.randint(0, 5))) for _ in range(600)]

    def plain(d):
        t = re.sub(r"(?s)```.*?```", "", d)
        head = "\n".join(re.sub(r"\A[ \t\n\x0b\f\r]+", "", t).split("\n")[:3])
        has = lambda p, x=t: re.search(p, x, re.A) is not None
        rules = [
            (has(M._label("failure")) or has(r"(?i)\bdo-not-repeat\b|\bbreaking\b") or has(r"(?i)(?:^|\n)\s*Failure:|Do-not-repeat|Bug:|Regression:|BREAKING", head), "failure"), (has(M._label("decision")), "decision"), (has(M._label("outcome")), "outcome"),
            (has(r"(?i)(?:^|\n)\s*(Handoff|Technical\s+Note|Technical\s+Handoff):", head), "technical_handoff"), (has(r"(?i)(?:^|\n)\s*(Debug\s+Note|Debug):", head), "debug_note"), (has(r"(?i)\bworkaround\b"), "workaround"), (has(M.HANDOFF_FILE) and has(M.DETAIL), "technical_handoff"),
            (has(r"(?i)\b(prefer|like|always|never|don't|hate|style|convention)\b"), "preference"), (has(r"(?i)\b(last time|previously|tried|attempted|before)\b"), "episodic"), (has(r"(?i)Full source dump|File contents:|cat\s+<<EOF"), "source_dump"),
            (has(r"(?i)Command\s+`|Command output:|Shell output:"), "command_log"), (has(r"(?i)Search results?:|knowledge_search\(|knowledge_read\("), "search_log"), (has(M.ACTIVE), "active_work_signal"),
        ]
        return next((k for ok, k in rules if ok), "observation")

    rows = spark.createDataFrame(list(enumerate(texts)), "id int, d string")
    got = dict(rows.select("id", M.memory_type(F.col("d"))).collect())
    assert [(d, got[i], plain(d)) for i, d in enumerate(texts) if got[i] != plain(d)] == [] and len(set(got.values())) >= 12
    low = spark.createDataFrame([("a.ther ther-x thers",), ("others",), ("xther",), ("theres ther",), ("",), (None,)], "d string")
    assert [x[0] for x in low.select(M.word(F.col("d"), "ther")).collect()] == [True, False, False, True, False, None]
    assert [x[0] for x in low.select(M.names(F.col("d"), "theres")).collect()] == [False, False, False, True, False, None]


def test_a_text_is_cut_into_words_once(spark, sf_dir):
    from __spark_entry__ import queries

    plan = queries()["memory_rerank"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 2 and plan.count("```.*?```") <= 2


def test_directives_are_cut_into_words_once(spark, sf_dir):
    from ledgerlens.operators import routing as R
    from ledgerlens.plans import routing

    d = routing._directives(spark, sf_dir)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") <= 2
    rows = [(1, "fix review", "keep it", "shop", "critical", ["the", "gear"], None), (2, None, None, None, None, None, None), (3, "Large steel gear", "workflow", "global", "normal", [], False), (4, "x", "steel gear of the plate", "a_b", "critical", ["steel"], False)]
    df = spark.createDataFrame(rows, "id int, title string, rule string, scope string, priority string, triggers array<string>, always_on boolean")
    tasks = ["review large steel gear workflow", "a b steel gear", "", "fix review"]
    got = R.match_directives(df, tasks).collect()
    one = R.match_directives(routing.F.broadcast(df).withColumn("task", F.explode(F.array(*map(F.lit, tasks))))).collect()
    assert sorted(map(str, got)) == sorted(map(str, one)) and {(r.task, r.id) for r in got} >= {(tasks[0], 3), (tasks[1], 4), (tasks[2], 3)}


def test_best_five_of_a_task_are_kept_in_tasks(spark, capsys):
    from ledgerlens.operators import memory as M
    from ledgerlens.operators import preflight as P

    rows = spark.range(40).select(F.when(F.col("id") >= 0, "t").alias("task"), F.col("id").cast("string").alias("id"), F.lit("weak").alias("relevance"), (F.col("id") % 9).cast("double").alias("final_score"), F.lit("decision").alias("memory_type"), F.create_map(F.lit("topic_match"), F.lit(1.0)).alias("boosts"))
    facts = P.memory_facts(rows, M.Targets.of("steel gear"))
    assert tuple(facts.select("n_memory", "top5", "all_weak", "strong").head()) == (40, 39.0, False, False)
    facts.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_a_line_is_parsed_once(spark, tmp_path):
    from ledgerlens.sources import ledgers

    (tmp_path / "x").write_text('{"event_id": "a", "confidence": 3}\n\n{"event_id": \n[1]\n{"event_id": 5}\n')
    good, bad = ledgers.parse(ledgers.read_lines(spark, f"file://{tmp_path}/x"))
    assert good._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [(r.seq, r.event_id, r.confidence) for r in good.orderBy("seq").collect()] == [(0, "a", 3), (4, "5", None)] and sorted(r.line_no for r in bad.collect()) == [3, 4]


def test_a_related_section_is_found_once(spark):
    from ledgerlens.operators import related

    docs = spark.createDataFrame([("concept_001", "---\nid: 1\n---\nsee [[concept_002]]\n\n## Related x\n- [[mitigates:concept_001]]\n## More\nend"), ("concept_002", None), ("concept_003", "")], "id string, text string")
    plan = related.links(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(text") == 1
    assert sorted((r.src, r.dst, r.type, r.own) for r in related.links(docs).collect()) == [("concept_001", "concept_001", "mitigates", False), ("concept_001", "concept_002", "relates_to", True)]


def test_names_are_looked_up_in_what_was_written(spark):
    from ledgerlens.operators import lifecycle as L

    rows = spark.range(1).select(F.array(F.lit("B"), F.lit(None), F.lit("gone")).alias("a"), F.lit(None).cast("array<string>").alias("b"), F.array(F.lit("1"), F.lit("x")).alias("c"))
    reg = spark.createDataFrame([("1", "b", ["X"])], "concept_id string, canonical_name string, aliases array<string>")
    out = L.resolve_lists(rows, reg, ["a", "b", "c"])
    assert [tuple(r) for r in out.collect()] == [(["1", None, "gone"], [], ["1", "1"])]
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()  # the rows are worked out once


def test_a_store_writes_a_bucket_once(spark, tmp_path, monkeypatch):
    from ledgerlens.sources import store

    s = store.ChunkStore(spark, f"file://{tmp_path}/s", 2)
    rows = lambda *x: spark.createDataFrame([(k, k[0], d) for k, d in x], "chunk_id string, source string, document string")
    s.upsert(rows(("a1", "x"), ("b1", "y"), ("c1", "z")))
    gone, delete = [], store.delete
    monkeypatch.setattr(store, "delete", lambda spark, path: (gone.append(path), delete(spark, path)))
    s.upsert(rows(("a1", "new"), ("a2", "more")))
    assert any("/s/bucket=" in p for p in gone)  # its place is taken by the folder that was written
    assert sorted((r.chunk_id, r.document) for r in s.scan().collect()) == [("a1", "new"), ("a2", "more"), ("b1", "y"), ("c1", "z")]
    s.delete(rows(("a1", "")).select("source"))
    assert sorted(r.chunk_id for r in s.scan().collect()) == ["b1", "c1"]


def test_an_update_shuffles_no_postings(spark, tmp_path, monkeypatch):
    """F16: postings are written in order of term by the tasks that read the words, and texts that are known aren't grouped again."""
    from pyspark.sql import DataFrameWriter

    from ledgerlens.sources.live_index import LiveIndex, whole_documents
    from ledgerlens.sources.vectors import VectorStore, slot_embedder

    plans, write = {}, DataFrameWriter.parquet

    def watched(self, path, *args, **kwargs):
        plans[path] = self._df._jdf.queryExecution().toString()
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    rows = [(f"f{k}", str(k), f"word{k % 7} word{k % 7} other{k}") for k in range(40)] + [("f3", "2", "an older text"), (None, "9", "none")]
    files = spark.createDataFrame(rows, "source string, content_hash string, document string")
    index = LiveIndex(spark, f"file://{tmp_path}/live", 4)
    for part in (files.where("source != 'f5'"), files.where("source IS NULL OR source != 'f6'"), files.where("source != 'f7'")):
        index.update(part, whole_documents)
    index.compact(keep=1)
    postings = [p for at, p in plans.items() if "/live/postings/" in at]
    assert len(postings) == 4 and not any("Exchange" in p.split("== Physical Plan ==")[1] for p in postings)
    assert index.frequencies(["word3", "older", "other5", "other7", "none"]) == {"word3": 6, "other5": 1}
    assert {x.chunk_id for x in index.sparse_scores("word3 older").collect()} == {"f3", "f10", "f17", "f24", "f31", "f38"}
    for s in index.record()["segments"]:
        kept = spark.read.parquet(f"{index.path}/postings/{s['name']}")
        for part in kept.groupBy(F.input_file_name()).agg(F.collect_list("term").alias("t")).collect():
            assert part["t"] == sorted(part["t"])

    store = VectorStore(spark, f"file://{tmp_path}/v", "m", 16, slot_embedder(16))
    chunks = whole_documents(files.where("source IS NOT NULL"))
    store.refresh(chunks.where("source != 'f3'"))
    store.refresh(chunks)
    assert store.current().count() == 41 and store.current().where("vector IS NULL").count() == 0
