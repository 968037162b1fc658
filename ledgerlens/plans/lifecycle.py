"""Queries on the life of concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..sources.tables import EVENTS_SQL, OUTCOMES_SQL, REGISTRY_SQL, concept_registry, event_ledger, outcome_ledger
from .registry import query

# The status machine of DuckDB's fold: one list per concept, in order of seq.
REPLAY_SQL = """
h AS (SELECT concept, list(struct_pack(s := session_id, k := event_type, e := length(evidence) > 0) ORDER BY seq) AS h FROM ev GROUP BY concept),
f AS (SELECT concept, list_reduce(h, lambda a, x: struct_pack(
    ss := CASE WHEN list_contains(a.ss, x.s) THEN a.ss ELSE list_append(a.ss, x.s) END,
    c := CASE x.k WHEN 'validation' THEN least(5, a.c + 1) WHEN 'failure' THEN greatest(1, a.c - 1) ELSE a.c END,
    f := a.f + CASE WHEN x.k = 'failure' THEN 1 ELSE 0 END, e := a.e + CASE WHEN x.e THEN 1 ELSE 0 END,
    st := CASE WHEN x.k = 'deprecation' THEN 'deprecated'
      WHEN len(a.ss) + CASE WHEN list_contains(a.ss, x.s) THEN 0 ELSE 1 END >= 5 AND CASE x.k WHEN 'validation' THEN least(5, a.c + 1) WHEN 'failure' THEN greatest(1, a.c - 1) ELSE a.c END >= 4 THEN 'canonical'
      WHEN a.e + CASE WHEN x.e THEN 1 ELSE 0 END >= 2 OR a.st = 'validated' THEN 'validated' WHEN a.e + CASE WHEN x.e THEN 1 ELSE 0 END >= 1 THEN 'emerging' ELSE 'candidate' END,
    n := a.n + CASE WHEN a.st <> CASE WHEN x.k = 'deprecation' THEN 'deprecated'
      WHEN len(a.ss) + CASE WHEN list_contains(a.ss, x.s) THEN 0 ELSE 1 END >= 5 AND CASE x.k WHEN 'validation' THEN least(5, a.c + 1) WHEN 'failure' THEN greatest(1, a.c - 1) ELSE a.c END >= 4 THEN 'canonical'
      WHEN a.e + CASE WHEN x.e THEN 1 ELSE 0 END >= 2 OR a.st = 'validated' THEN 'validated' WHEN a.e + CASE WHEN x.e THEN 1 ELSE 0 END >= 1 THEN 'emerging' ELSE 'candidate' END THEN 1 ELSE 0 END),
  struct_pack(ss := CAST([] AS VARCHAR[]), c := 1, f := 0, e := 0, st := 'candidate', n := 0)) AS r FROM h)
"""


@query(f"WITH {EVENTS_SQL}, {REPLAY_SQL} SELECT concept, r.st AS status, CAST(r.c AS INTEGER) AS confidence, CAST(len(r.ss) AS INTEGER) AS session_count, CAST(r.e AS INTEGER) AS evidence_count, CAST(r.n AS INTEGER) AS n_transitions FROM f")
def concept_status_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, L3"""
    s = L.replay(event_ledger(spark, sf_dir))
    return s.select("concept", "s.status", "s.confidence", F.size("s.sessions").alias("session_count"), F.col("s.evidence").alias("evidence_count"), F.col("s.transitions").alias("n_transitions"))


@query(f"WITH {EVENTS_SQL}, {REPLAY_SQL} SELECT concept, round(CASE WHEN r.st = 'deprecated' THEN 0 ELSE greatest(0.0, least(100.0, 50.0 + least(30.0, r.e * 5.0) + least(25.0, r.c * 5.0) - r.f * 15.0 + CASE r.st WHEN 'canonical' THEN 10.0 WHEN 'validated' THEN 5.0 ELSE 0.0 END)) END, 2) AS health FROM f")
def concept_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F34 over replayed concepts"""
    s = L.replay(event_ledger(spark, sf_dir))
    return s.select("concept", L.health(F.col("s.evidence"), F.col("s.confidence"), F.col("s.failures"), F.col("s.status")).alias("health"))


FITNESS_SQL = """
c AS (SELECT concept AS concept_id, count(*) AS retrieved, CAST(sum(referenced) AS BIGINT) AS referenced, CAST(sum(1 - referenced) AS BIGINT) AS ignored,
  CAST(sum(CASE WHEN referenced = 1 AND outcome = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS succ, CAST(sum(CASE WHEN referenced = 1 AND outcome = 'failure' THEN 1 ELSE 0 END) AS BIGINT) AS fail FROM oc GROUP BY concept),
fit AS (SELECT coalesce(rg.concept_id, c.concept_id) AS concept_id, canonical_name, coalesce(retrieved, 0) AS retrieved, coalesce(referenced, 0) AS referenced, coalesce(ignored, 0) AS ignored, coalesce(succ, 0) AS succ, coalesce(fail, 0) AS fail,
  coalesce(evidence_count, 0) AS evidence_count, CASE WHEN coalesce(succ, 0) + coalesce(fail, 0) > 0 THEN round(CAST(succ AS DOUBLE) / (succ + fail), 4) ELSE 0 END AS fitness FROM rg FULL JOIN c ON rg.concept_id = c.concept_id)
"""


@query(f"WITH {OUTCOMES_SQL}, {REGISTRY_SQL}, {FITNESS_SQL} SELECT concept_id, retrieved, referenced, ignored, succ, fail, round(fitness, 4) AS fitness, round(fitness * (1 + 0.3 * ln(1 + evidence_count)), 6) AS composite FROM fit")
def fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, J4, A2, A3"""
    f = L.fitness(outcome_ledger(spark, sf_dir), concept_registry(spark, sf_dir))
    return f.select("concept_id", "retrieved", "referenced", "ignored", "succ", "fail", "fitness", F.round(L.composite(F.col("fitness"), F.col("evidence_count")), 6).alias("composite"))


@query(f"WITH {OUTCOMES_SQL}, {REGISTRY_SQL}, {FITNESS_SQL}, t AS (SELECT concept_id, referenced, retrieved FROM fit ORDER BY referenced DESC, retrieved DESC, concept_id LIMIT 20) SELECT * FROM t")
def fitness_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O7"""
    f = L.fitness(outcome_ledger(spark, sf_dir), concept_registry(spark, sf_dir)).select("concept_id", "referenced", "retrieved")
    return f.orderBy(F.desc("referenced"), F.desc("retrieved"), "concept_id").limit(20)


STALE_SQL = """
ss AS (SELECT session_id, row_number() OVER (ORDER BY min(seq)) - 1 AS idx FROM ev GROUP BY session_id),
lc AS (SELECT concept, arg_max(session_id, seq) AS session_id FROM ev GROUP BY concept)
"""


@query(f"WITH {EVENTS_SQL}, {STALE_SQL} SELECT concept, CAST((SELECT count(*) FROM ss) - 1 - idx AS BIGINT) AS sessions_since, CASE WHEN (SELECT count(*) FROM ss) - 1 - idx >= 50 THEN 'stale' ELSE 'recent' END AS status FROM lc JOIN ss USING (session_id)")
def stale_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept is stale if none of the last 50 sessions referred to it."""
    e = event_ledger(spark, sf_dir)
    sessions = L.completed_sessions(e).select("session_id", "idx")
    n = F.broadcast(sessions.agg(F.count("*").alias("n")))
    last = e.groupBy("concept").agg(F.max_by("session_id", "seq").alias("session_id"))
    since = F.col("n") - 1 - F.col("idx")
    return last.join(sessions, "session_id").crossJoin(n).select("concept", since.alias("sessions_since"), F.when(since >= 50, "stale").otherwise("recent").alias("status"))


@query(f"WITH {EVENTS_SQL}, l AS (SELECT concept, max(epoch_us(ts)) AS t, arg_max(confidence, seq) AS old FROM ev GROUP BY concept), a AS (SELECT concept, old, exp(-0.693 * ((SELECT max(t) FROM l) - t) / 86400000000.0 * 30 / 30.0) AS factor FROM l), d AS (SELECT concept, old, CAST(least(greatest(1, round_even(old * factor, 0)), 5) AS INTEGER) AS new, round(factor, 4) AS factor FROM a) SELECT concept, old, new, factor FROM d WHERE new <> old")
def confidence_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12; the ledger spans a month, so days count thirtyfold. Only changes come out."""
    last = event_ledger(spark, sf_dir).groupBy("concept").agg(F.max(F.unix_micros("ts")).alias("t"), F.max_by("confidence", "seq").alias("old"))
    now = F.broadcast(last.agg(F.max("t").alias("now")))
    factor = L.decay_factor((F.col("now") - F.col("t")) / 86400000000.0 * 30)
    out = last.crossJoin(now).select("concept", "old", L.decayed(F.col("old"), factor).alias("new"), F.round(factor, 4).alias("factor"))
    return out.where("new != old")


@query(f"WITH {EVENTS_SQL}, c AS (SELECT concept, count(*) % 40 AS e, count(DISTINCT session_id) % 60 AS s, CASE count(*) % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'emerging' WHEN 2 THEN 'validated' WHEN 3 THEN 'canonical' ELSE 'needs_review' END AS st FROM ev GROUP BY concept) SELECT concept, st AS status, CASE WHEN st IN ('candidate', 'emerging') AND e >= 5 AND s >= 3 THEN 'promote' WHEN 80 - s >= 30 AND st NOT IN ('canonical', 'deprecated', 'needs_review') THEN 'archive' ELSE 'keep' END AS action FROM c")
def promotion_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L12 at session 80"""
    n = F.count("*")
    st = F.element_at(F.array(*map(F.lit, ["candidate", "emerging", "validated", "canonical", "needs_review"])), (n % 5 + 1).cast("int"))
    c = event_ledger(spark, sf_dir).groupBy("concept").agg((n % 40).alias("e"), (F.count_distinct("session_id") % 60).alias("s"), st.alias("status"))
    return c.select("concept", "status", L.promotion(F.col("status"), F.col("e"), F.col("s"), F.lit(80)).alias("action"))


@query(f"WITH {REGISTRY_SQL} SELECT status, count(*) AS n FROM rg GROUP BY status")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5"""
    return concept_registry(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS_SQL}, {REPLAY_SQL}, t AS (SELECT concept, CAST(r.c * r.e AS BIGINT) AS weight FROM f ORDER BY weight DESC, concept LIMIT 10) SELECT CAST(row_number() OVER (ORDER BY weight DESC, concept) AS INTEGER) AS rank, concept, weight FROM t")
def important_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5"""
    from pyspark.sql import Window

    s = L.replay(event_ledger(spark, sf_dir)).select("concept", (F.col("s.confidence") * F.col("s.evidence")).cast("long").alias("weight"))
    top = s.orderBy(F.desc("weight"), "concept").limit(10)
    return top.select(F.row_number().over(Window.orderBy(F.desc("weight"), "concept")).alias("rank"), "concept", "weight")


@query(f"WITH {REGISTRY_SQL}, a AS (SELECT *, concept_id % 90 AS age, CASE WHEN concept_id % 3 = 0 THEN 0 WHEN concept_id % 50 = 1 THEN 501 ELSE evidence_count END AS e FROM rg) SELECT concept_id, 'delete' AS action FROM a WHERE status = 'candidate' AND e = 0 AND age > 30 UNION ALL SELECT concept_id, 'warn' FROM a WHERE e > 500 UNION ALL SELECT concept_id, 'deprecate' FROM a WHERE confidence < 2 AND e < 3 AND age > 14")
def auto_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L21"""
    k = F.col("concept_id")
    e = F.when(k % 3 == 0, 0).when(k % 50 == 1, 501).otherwise(F.col("evidence_count"))
    return concept_registry(spark, sf_dir).select("concept_id", F.explode(L.cleanup_actions(F.col("status"), e, F.col("confidence"), k % 90)).alias("action"))


@query(f"WITH {EVENTS_SQL}, d AS (SELECT session_id, concept FROM ev WHERE seq % 4 <> 0 GROUP BY ALL), n AS (SELECT * FROM ev WHERE seq % 2 = 0), k AS (SELECT event_id FROM ev WHERE seq % 6 = 0) SELECT concept, count(*) AS new_events FROM n WHERE event_id NOT IN (SELECT event_id FROM k) AND event_type NOT IN ('observation') GROUP BY concept")
def materialize_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New events that no concept has taken up yet, noise aside."""
    e = event_ledger(spark, sf_dir)
    known = e.where("seq % 6 = 0").select("event_id")
    fresh = e.where("seq % 2 = 0").join(known, "event_id", "left_anti").where("event_type != 'observation'")
    return fresh.groupBy("concept").agg(F.count("*").alias("new_events"))


@query(
    f"""WITH {EVENTS_SQL}, o AS (SELECT CAST(o_custkey % 150 AS BIGINT) AS user_id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey, o_orderstatus FROM orders),
d AS (SELECT DISTINCT concept, user_id, event_id, day FROM ev WHERE event_type = 'validation')
SELECT d.concept, count(*) AS n_events, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_success FROM d JOIN o ON d.user_id = o.user_id AND (o.o_orderkey % 100 = CAST(substr(d.concept, 2) AS BIGINT)) GROUP BY d.concept"""
)
def skill_evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events meet the outcomes of the same actor that refer to the concept; both are
    keys of one equi-join."""
    from ..sources.tables import table

    e = event_ledger(spark, sf_dir).where("event_type = 'validation'").select("concept", "user_id", "event_id")
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 150).alias("user_id"), F.concat(F.lit("c"), (F.col("o_orderkey") % 100).cast("string")).alias("concept"), "o_orderstatus")
    return e.join(o, ["user_id", "concept"]).groupBy("concept").agg(F.count("*").alias("n_events"), F.count_if(F.col("o_orderstatus") == "F").alias("n_success"))


MOVED_SQL = EVENTS_SQL.replace("ev AS (", "ev0 AS (", 1)


@query(
    f"""WITH {MOVED_SQL}, ev1 AS (SELECT * REPLACE (CASE WHEN concept = 'c3' AND regexp_matches(summary, 'review') THEN 'c7' WHEN concept = 'c12' THEN 'c40' ELSE concept END AS concept) FROM ev0),
ev AS (SELECT * FROM ev1 UNION ALL SELECT * REPLACE ('c-new' AS concept) FROM ev1 WHERE regexp_matches(summary, '^failure of c2[0-9] was')), {REPLAY_SQL}
SELECT concept, r.st AS status, CAST(r.c AS INTEGER) AS confidence, CAST(len(r.ss) AS INTEGER) AS session_count, CAST(r.e AS INTEGER) AS evidence_count FROM f"""
)
def reassign_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after three re-assignments (by pattern from one concept, all of another, by pattern to a new one), of
    which each replays only the concepts it touches: equal to a replay of the whole changed ledger."""
    from ..sources.concepts import ConceptStates
    from ..sources.scratch import fresh

    store = ConceptStates(spark, fresh(spark, "concepts"), 16)
    store.build(event_ledger(spark, sf_dir))
    store.reassign("c7", "C3", "review")
    store.reassign("c40", "c12")
    store.reassign("C new", match="^failure of c2[0-9] was")
    return store.states().select("concept", "s.status", "s.confidence", F.size("s.sessions").alias("session_count"), F.col("s.evidence").alias("evidence_count"))


# What sessions name: ids, names in capitals, aliases, and what no concept has.
SAID_SQL = f"""
{REGISTRY_SQL},
said AS (SELECT o_orderkey AS s, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failure' ELSE 'abandoned' END AS outcome, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 11) / 10.0::DOUBLE END AS sat, l_quantity > 25 AS used,
  CASE l_partkey % 4 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN upper(p_name) WHEN 2 THEN lower(p_brand) ELSE 'no such ' || (l_partkey % 7) END AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
keys AS (SELECT concept_id::VARCHAR AS k, 0 AS p, concept_id::VARCHAR AS id FROM rg UNION ALL SELECT lower(canonical_name), 1, concept_id::VARCHAR FROM rg UNION ALL SELECT lower(alias1), 2, concept_id::VARCHAR FROM rg UNION ALL SELECT lower(alias2), 2, concept_id::VARCHAR FROM rg),
look AS (SELECT k, id FROM (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY p, id) AS r FROM keys) WHERE r = 1),
res AS (SELECT s, outcome, sat, coalesce(id, n) AS concept_id, max(used::INT) AS used FROM said LEFT JOIN look ON k = lower(n) GROUP BY ALL),
fr AS (SELECT concept_id, count(*) AS retrieved, CAST(sum(used) AS BIGINT) AS referenced, CAST(sum(CASE WHEN used = 1 AND outcome = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS succ, CAST(sum(CASE WHEN used = 1 AND outcome = 'failure' THEN 1 ELSE 0 END) AS BIGINT) AS fail,
  sum(CASE WHEN used = 1 THEN coalesce(sat, CASE WHEN outcome = 'success' THEN 1.0 ELSE 0.0 END) ELSE 0.0 END) AS total FROM res GROUP BY concept_id)
"""


@query(f"WITH {SAID_SQL} SELECT coalesce(rg.concept_id::VARCHAR, fr.concept_id) AS concept_id, coalesce(retrieved, 0) AS retrieved, coalesce(referenced, 0) AS referenced, coalesce(succ, 0) AS succ, coalesce(fail, 0) AS fail, CASE WHEN coalesce(succ, 0) + coalesce(fail, 0) > 0 THEN round(round(total / (succ + fail), 4), 3) ELSE 0.0 END AS fitness FROM rg FULL JOIN fr ON fr.concept_id = rg.concept_id::VARCHAR")
def fitness_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitness from sessions that name concepts by id, by name and by alias without case, and some that nothing
    has, with a goal's satisfaction where it is known."""
    from ..sources.tables import table

    o, items, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    k = F.col("l_partkey")
    said = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.upper("p_name")).when(k % 4 == 2, F.lower("p_brand")).otherwise(F.concat(F.lit("no such "), (k % 7).cast("string")))
    lists = items.join(p, items.l_partkey == p.p_partkey).groupBy("l_orderkey").agg(F.collect_list(said).alias("retrieved_concepts"), F.collect_list(F.when(F.col("l_quantity") > 25, said)).alias("referenced_concepts"))
    sat = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 11 / 10)
    outcome = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failure").otherwise("abandoned")
    sessions = o.join(lists, o.o_orderkey == lists.l_orderkey).select(outcome.alias("outcome"), sat.alias("goal_satisfaction"), "retrieved_concepts", "referenced_concepts")
    registry = concept_registry(spark, sf_dir).withColumn("concept_id", F.col("concept_id").cast("string"))
    f = L.fitness(L.resolve_lists(sessions, registry, ["retrieved_concepts", "referenced_concepts"]), registry)
    return f.select("concept_id", "retrieved", "referenced", "succ", "fail", F.round("fitness", 3).alias("fitness"))
