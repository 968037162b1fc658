"""What larger tables need: steps whose work follows the input, and numbers that stay the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import lifecycle as L
from ledgerlens.operators import registry as R


def test_numbers_where_ranges_are_joined(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        n = 300_000
        rows = spark.range(0, n, 1, 8).select(F.sha2(F.col("id").cast("string"), 512).alias("session_id"), F.col("id").alias("seq"))
        out = L.completed_sessions(rows).select(F.xxhash64("session_id").alias("h"), "idx")
        assert out.agg(F.count_distinct("h"), F.count_distinct("idx"), F.max("idx")).head() == (n, n, n - 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


EVENT = "concept string, seq long, event_id string, session_id string, event_type string, evidence string, summary string, source string"


def test_a_fold_holds_no_list_of_sessions(spark, capsys):
    rows = [("c", i, f"e{i}", None if i % 7 == 0 else f"s{i % 5}", "validation", "x", "y", "chat") for i in range(40)]
    e = spark.createDataFrame(rows, EVENT)
    s = L.replay(e)
    got = s.head()["s"]
    assert [x for x in got.sessions if x] == ["s1", "s2", "s3", "s4", "s0"] and got.sessions.count(None) == 6 and got.status == "canonical"
    s.explain()
    assert "array_contains" not in capsys.readouterr().out


def test_a_fold_goes_on_from_known_sessions(spark):
    reg = spark.createDataFrame([("c", "candidate", 1, 0, 0, ["s1", "s2"], ["e0"])], "concept string, status string, confidence int, failures int, evidence int, sessions array<string>, source_event_ids array<string>")
    e = spark.createDataFrame([("c", i, f"e{i}", f"s{i % 4}", "observation", "", "y", "chat") for i in range(1, 9)], EVENT)
    out, _ = R.materialize(reg, e, F.lit(False))
    assert out.head()["sessions"] == ["s1", "s2", "s3", "s0"]


def test_pairs_of_vectors_in_parts(spark, monkeypatch):
    from ledgerlens.operators import blocks, ranking

    monkeypatch.setattr(blocks.parts, "__defaults__", (7,))
    rows = [(i % 2 if i % 11 else None, i, None if i == 5 else [float((i * k) % 7 - 3) for k in range(4 + (i % 13 == 0))]) for i in range(60)] + [(0, 90, [0.0] * 4), (1, 91, [1.0, None, 2.0, 0.5])]
    e = spark.createDataFrame(rows, "grp int, id long, v array<float>")
    a, b = e.select("grp", F.col("id").alias("a"), F.col("v").alias("x")), e.select("grp", F.col("id").alias("b"), F.col("v").alias("y"))
    want = a.join(b, "grp").where("a < b").select("grp", "a", "b", ranking.cosine(F.col("x"), F.col("y")).alias("s")).where("s >= 0.3")
    got = blocks.similar_pairs(e, 0.3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100


def test_vector_queries_meet_in_blocks(spark, sf_dir, capsys):
    from __spark_entry__ import queries

    for name in ("dense_duplicates", "consolidate"):
        queries()[name](spark, sf_dir).explain()
        assert "FlatMapGroupsInArrow" in capsys.readouterr().out


def test_conflicts_come_once_without_a_shuffle_of_pairs(spark, capsys):
    import random

    from ledgerlens.operators import pairs as P

    r = random.Random(3)
    rows = [(r.randint(0, 60), r.choice(["always x", "never x", "must never y", "x"]), r.choice(["general", "", "s1", "s2", None]), r.sample("abcde", r.randint(0, 3)) + ["a"] * r.randint(0, 1)) for _ in range(90)]
    d = spark.createDataFrame(rows, "id long, rule string, scope string, triggers array<string>")
    flags = [(i, "always" in t or "must" in t, "never" in t, s, set(k)) for i, t, s, k in rows]
    want = {(x[0], y[0]) for x in flags for y in flags if x[0] < y[0] and ((x[1] and y[2]) or (x[2] and y[1])) and (x[4] & y[4] or (x[3] == y[3] and x[3] not in ("general", "", None)))}
    out = P.directive_conflicts(d)
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    docs = spark.createDataFrame([(i, r.choice(["rest", "grpc", "rest grpc", "none"])) for i in range(40)], "id long, text string")
    rule = [(r"rest\b", r"grpc\b", "R")]
    pairs = P.contradictions(docs, rule)
    have = {x.id: x.text for x in docs.collect()}
    met = {(a, b, "R") for a in have for b in have if a < b and ((("rest" in have[a]) and "grpc" in have[b]) or ("grpc" in have[a] and "rest" in have[b]))}
    rows = [tuple(x) for x in pairs.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == met
    for plan in (out, pairs):
        plan.explain()
        top = capsys.readouterr().out.split("Join")[0]
        assert "HashAggregate" not in top and "Exchange" not in top


def test_words_are_counted_in_their_row(spark, tmp_path):
    from collections import Counter

    from ledgerlens.sources.store import SearchIndex, counted

    rows = [("a", "x y x Über"), ("b", ""), ("c", "x"), ("a", "x y x Über"), ("a", "x y")]
    d = spark.createDataFrame(rows, "chunk_id string, document string")
    w = spark.createDataFrame([(["b", "a", "b", "ä", "b"],), ([],), (None,)], "w array<string>").select(counted(F.col("w")).alias("c"))
    got = [None if r.c is None else {x.term: x.tf for x in r.c} for r in w.collect()]
    assert got[0] == Counter(["b", "a", "b", "ä", "b"]) and not got[1] and not got[2]
    SearchIndex(spark, f"file://{tmp_path}/i", 4).build(d)
    have = {(r.chunk_id, r.dl, r.term): r.tf for r in spark.read.parquet(f"{tmp_path}/i/postings").collect()}
    assert have == {("a", 4, "x"): 4, ("a", 4, "y"): 2, ("a", 4, "über"): 2, ("c", 1, "x"): 1, ("a", 2, "x"): 1, ("a", 2, "y"): 1}


def test_an_update_counts_words_in_their_row(spark, tmp_path):
    from ledgerlens.sources.live_index import LiveIndex

    grouped = []
    frames = type(spark.range(1))
    plain = frames.groupBy

    def noted(self, *cols):
        grouped.append(cols)
        return plain(self, *cols)

    frames.groupBy = noted
    try:
        index = LiveIndex(spark, f"file://{tmp_path}/live", 2)
        files = spark.createDataFrame([("f1", "h1", "x y x"), ("f2", "h2", "y")], "source string, content_hash string, document string")
        index.update(files, lambda d: d.select("source", F.concat("source", F.lit("#0")).alias("chunk_id"), "document"))
    finally:
        frames.groupBy = plain
    assert ("source", "chunk_id", "dl", "term") not in grouped
    assert ("source", "chunk_id", "dl") in grouped


def noted_lists(monkeypatch):
    """The sides of each meeting of lists, as they are given."""
    from ledgerlens.operators import pairs as P

    given = []
    plain = P.lists_met
    monkeypatch.setattr(P, "lists_met", lambda a, b, *rest: given.extend([a, b]) or plain(a, b, *rest))
    return given


def test_contradictions_meet_as_lists_on_all_cores(spark, monkeypatch):
    from ledgerlens.operators import pairs as P

    given = noted_lists(monkeypatch)
    docs = spark.range(1500).select("id", F.when(F.col("id") % 3 == 0, "rest").when(F.col("id") % 3 == 1, "grpc").otherwise("rest grpc").alias("text"))
    docs = docs.unionByName(docs.where("id < 9")).unionByName(spark.sql("SELECT CAST(null AS LONG) AS id, 'rest grpc' AS text"))
    out = P.contradictions(docs, [(r"rest\b", r"grpc\b", "R")])
    # all pairs but those of two that both have one of the words only
    assert out.count() == out.distinct().count() == 1500 * 1499 // 2 - 2 * (500 * 499 // 2) and out.where("a >= b").isEmpty()
    assert len(given) == 2 and all(rows.count() < 20 for rows in given)
    assert out.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism  # however small what is sent


def test_conflicts_meet_as_lists_on_all_cores(spark, monkeypatch):
    from ledgerlens.operators import pairs as P

    given = noted_lists(monkeypatch)
    k = F.col("id") % 4
    rule = F.when(F.col("id") % 2 == 0, "always x").otherwise("never x")
    d = spark.range(1600).select("id", rule.alias("rule"), F.when(k < 2, "s").otherwise("general").alias("scope"), F.array(F.lit("t"), F.lit(None), F.when(k % 3 == 0, "u").otherwise("v")).alias("triggers"))
    d = d.unionByName(spark.sql("SELECT CAST(null AS LONG) AS id, 'always never' AS rule, 's' AS scope, array('t') AS triggers")).unionByName(spark.sql("SELECT 5000L AS id, 'must never' AS rule, 's' AS scope, CAST(null AS array<string>) AS triggers"))
    out = P.directive_conflicts(d)
    # t is common to all but the last, which conflicts by s
    assert out.count() == out.distinct().count() == 800 * 800 + 800 and out.where("d1 >= d2").isEmpty()
    assert len(given) == 2 and all(rows.count() < 40 for rows in given)
    assert out.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism  # however small what is sent
