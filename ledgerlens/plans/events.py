"""Queries over event ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import sessions as S
from ..sources.tables import EVENTS_SQL, event_ledger, table
from .registry import query


@query(f"WITH {EVENTS_SQL} SELECT event_id, 'old' AS batch FROM ev WHERE seq % 3 <> 0 UNION ALL SELECT event_id, 'new' AS batch FROM ev WHERE seq % 2 = 0 AND event_id NOT IN (SELECT event_id FROM ev WHERE seq % 3 <> 0)")
def ledger_append_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, D-8, U1: a ledger of two thirds of the events takes up every second event."""
    e = event_ledger(spark, sf_dir)
    old, new = e.where("seq % 3 != 0").select("event_id"), e.where("seq % 2 = 0").select("event_id")
    return old.withColumn("batch", F.lit("old")).unionByName(E.append_new(old, new).withColumn("batch", F.lit("new")))


@query("SELECT sha256(event_type || '|' || props || '|' || CAST(user_id % 7 AS VARCHAR)) AS body_hash, min(event_id) AS first_event_id, CAST(count(*) - 1 AS BIGINT) AS n_dropped FROM events GROUP BY ALL")
def ledger_body_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-2, F12: rows with equal bodies, ids aside; the first survives."""
    body = F.concat_ws("|", "event_type", "props", (F.col("user_id") % 7).cast("string"))
    return table(spark, sf_dir, "events").groupBy(F.sha2(body, 256).alias("body_hash")).agg(F.min("event_id").alias("first_event_id"), (F.count("*") - 1).alias("n_dropped"))


@query(f"WITH {EVENTS_SQL} SELECT event_id FROM ev WHERE concept = 'c7' AND coalesce(scope, 'project') = 'project' AND ts >= TIMESTAMP '2024-01-05' AND lower(event_type) IN ('observation', 'failure')")
def event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P5, P6"""
    e = event_ledger(spark, sf_dir).where(E.of_concept(F.array("concept"), "C7"))
    return e.where(E.in_scope(F.col("scope"), "project") & E.in_window(F.col("ts"), "2024-01-05", None) & F.lower("event_type").isin("observation", "failure")).select("event_id")


RAW_SQL = "raw AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN ' Decision ' WHEN event_id % 6 = 1 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || ' seen' END AS summary, CASE WHEN event_id % 8 = 0 THEN NULL ELSE 'c' || CAST(event_id % 100 AS VARCHAR) END AS fallback, CASE WHEN event_id % 5 = 0 THEN '' ELSE props END AS evidence, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 13) / 2.0 - 0.5 END AS confidence FROM events)"


@query(
    f"""WITH {RAW_SQL}, n AS (SELECT *, CASE WHEN coalesce(summary, '') <> '' THEN summary WHEN coalesce(fallback, '') <> '' THEN fallback END AS s, CASE WHEN confidence IS NULL THEN 4 WHEN confidence BETWEEN 0 AND 1 THEN floor(confidence * 5) WHEN confidence >= 0 THEN floor(confidence) ELSE ceil(confidence) END AS l FROM raw)
SELECT event_id, CASE WHEN lower(trim(coalesce(event_type, ''))) IN ('observation', 'decision', 'hypothesis', 'experiment', 'outcome', 'failure', 'risk', 'validation', 'deprecation') THEN lower(trim(event_type)) ELSE 'observation' END AS event_type,
  s AS summary, CASE WHEN coalesce(evidence, '') <> '' THEN evidence ELSE s END AS evidence, CAST(CASE WHEN l BETWEEN 1 AND 5 THEN l ELSE 1 END AS INTEGER) AS confidence, s IS NULL AS rejected FROM n"""
)
def event_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 over events made irregular: blank, unknown and padded fields, scores and levels."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    raw = e.select(
        "event_id",
        F.when(k % 6 == 0, " Decision ").when(k % 6 == 1, None).otherwise(F.col("event_type")).alias("event_type"),
        F.when(k % 4 == 0, "").otherwise(F.concat("event_type", F.lit(" seen"))).alias("summary"),
        F.when(k % 8 == 0, None).otherwise(F.concat(F.lit("c"), (k % 100).cast("string"))).alias("fallback"),
        F.when(k % 5 == 0, "").otherwise(F.col("props")).alias("evidence"),
        F.when(k % 7 == 0, None).otherwise((k % 13) / 2.0 - 0.5).alias("confidence"),
    )
    return E.normalised(raw)


@query(
    f"""WITH {EVENTS_SQL}, n AS (SELECT seq, event_type, CASE seq % 5 WHEN 0 THEN 'opencode_hook' WHEN 1 THEN 'orchestrator' ELSE source END AS source, CASE seq % 11 WHEN 0 THEN 'kb_generated' WHEN 1 THEN 'agent_runtime_signal' ELSE 'agent_transcript' END AS stype,
  CASE seq % 4 WHEN 0 THEN 'Command failed: ' || summary WHEN 1 THEN 'Session duration: 5' ELSE summary END AS s, CASE WHEN seq % 23 = 0 THEN 'x/.KB/state/a.json' END AS p, CASE WHEN seq % 29 = 0 THEN false END AS el FROM ev),
f AS (SELECT *, regexp_matches(s, '(?i)^Command\\s+(?:execution|failed|succeeded):') AS logged, event_type IN ('failure', 'decision', 'outcome', 'validation', 'hypothesis', 'experiment', 'risk', 'deprecation') AS durable, source = 'orchestrator' OR (source IN ('opencode_hook', 'agent_runtime_signal') AND stype = 'agent_runtime_signal') AS runtime FROM n)
SELECT event_type, CASE WHEN el = false THEN true WHEN stype LIKE 'kb\\_%' ESCAPE '\\' THEN true WHEN p IS NOT NULL THEN true WHEN runtime AND event_type = 'failure' THEN logged WHEN runtime THEN NOT durable
  WHEN s LIKE 'Session duration:%' AND source = 'opencode_hook' THEN true WHEN s LIKE 'Session duration:%' AND source = 'orchestrator' THEN true WHEN logged AND source = 'opencode_hook' AND event_type = 'failure' THEN true WHEN logged THEN NOT durable ELSE false END AS is_noise, count(*) AS n FROM f GROUP BY ALL"""
)
def noise_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 over events dressed as command logs, reports, generated and private ones."""
    k = F.col("seq")
    e = event_ledger(spark, sf_dir).select(
        "event_type",
        F.when(k % 5 == 0, "opencode_hook").when(k % 5 == 1, "orchestrator").otherwise(F.col("source")).alias("source"),
        F.when(k % 11 == 0, "kb_generated").when(k % 11 == 1, "agent_runtime_signal").otherwise("agent_transcript").alias("stype"),
        F.when(k % 4 == 0, F.concat(F.lit("Command failed: "), "summary")).when(k % 4 == 1, "Session duration: 5").otherwise(F.col("summary")).alias("s"),
        F.when(k % 23 == 0, "x/.KB/state/a.json").alias("p"),
        F.when(k % 29 == 0, False).alias("el"),
    )
    noise = E.is_noise(F.col("event_type"), F.col("source"), F.col("stype"), F.col("s"), F.lit(None).cast("string"), F.col("p"), F.col("el"))
    return e.groupBy("event_type", noise.alias("is_noise")).agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS_SQL}, d AS (SELECT evidence, max(seq) AS seq FROM ev WHERE event_type = 'decision' GROUP BY evidence), t AS (SELECT * FROM d ORDER BY seq DESC LIMIT 5) SELECT CAST(row_number() OVER (ORDER BY seq) AS INTEGER) AS rank, evidence FROM t")
def recent_distinct_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-7: the five newest distinct decisions, oldest first."""
    d = event_ledger(spark, sf_dir).where("event_type = 'decision'").groupBy("evidence").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq")).limit(5)
    return d.select(F.row_number().over(Window.orderBy("seq")).alias("rank"), "evidence")


@query(f"WITH {EVENTS_SQL} SELECT user_id, arg_max(event_id, seq) AS event_id, count(*) AS n FROM ev GROUP BY user_id")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-9"""
    return event_ledger(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_id", "seq").alias("event_id"), F.count("*").alias("n"))


@query(f"WITH {EVENTS_SQL} SELECT source, count(*) AS n, CAST(row_number() OVER (ORDER BY CASE source WHEN 'chat' THEN 0 WHEN 'chat-fallback' THEN 1 WHEN 'orchestrator' THEN 2 WHEN 'diff' THEN 3 ELSE 99 END, source) AS INTEGER) AS rank FROM ev GROUP BY source")
def source_priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W15, A15"""
    order = F.when(F.col("source") == "chat", 0).when(F.col("source") == "chat-fallback", 1).when(F.col("source") == "orchestrator", 2).when(F.col("source") == "diff", 3).otherwise(99)
    n = event_ledger(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(order, "source")))


@query(f"WITH {EVENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type, substr(concept, 1, 80), lower(evidence) ORDER BY seq) AS r FROM ev) SELECT event_id FROM r WHERE r = 1")
def reflection_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-1"""
    e = event_ledger(spark, sf_dir).withColumn("_c", F.substring("concept", 1, 80)).withColumn("_e", F.lower("evidence"))
    return E.first_of(e, ["event_type", "_c", "_e"], F.asc("seq")).select("event_id")


@query(f"WITH {EVENTS_SQL}, v AS (SELECT CASE WHEN seq % 10 = 0 THEN NULL ELSE seq % 3 + 1 END AS v FROM ev) SELECT CAST(coalesce(v, 1) AS BIGINT) AS version, count(*) AS n, CAST(sum(CASE WHEN coalesce(v, 1) < 3 THEN 1 ELSE 0 END) AS BIGINT) AS to_migrate FROM v GROUP BY ALL")
def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the rows (1 where none is given) and how many need an upcast to 3."""
    v = F.coalesce(F.when(F.col("seq") % 10 != 0, F.col("seq") % 3 + 1), F.lit(1)).cast("long")
    return event_ledger(spark, sf_dir).groupBy(v.alias("version")).agg(F.count("*").alias("n"), F.count_if(v < 3).alias("to_migrate"))


@query(
    f"""WITH {EVENTS_SQL}, q AS (SELECT event_id, seq, length(evidence) + 480 AS b FROM ev), c AS (SELECT *, row_number() OVER (ORDER BY seq DESC) AS n, sum(b) OVER (ORDER BY seq DESC) AS s FROM q),
k AS (SELECT event_id, max(CASE WHEN n > 20 OR s > 9000 THEN 1 ELSE 0 END) OVER (ORDER BY seq DESC) = 0 AS kept, n FROM c) SELECT event_id, kept FROM k"""
)
def queue_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events of a queue stay under caps of 20 rows and 9,000 bytes. No row
    beyond the newest 20 can, so the window runs over those, which come by top-k."""
    queue = event_ledger(spark, sf_dir).select("event_id", "seq", (F.length("evidence") + 480).alias("b"))
    newest = queue.orderBy(F.desc("seq")).limit(20)
    kept = E.keep_within_caps(newest, F.col("b"), 20, 9000, F.desc("seq")).select("event_id", "kept")
    return queue.join(F.broadcast(kept), "event_id", "left").select("event_id", F.coalesce("kept", F.lit(False)).alias("kept"))


@query(
    f"""WITH {EVENTS_SQL}, l AS (SELECT event_type, summary, seq FROM ev WHERE seq % 10 <> 1), r AS (SELECT event_type, summary, seq FROM ev WHERE seq % 10 <> 2),
lr AS (SELECT event_type, summary, count(*) AS c FROM l GROUP BY ALL), rr AS (SELECT event_type, summary, count(*) AS c FROM r GROUP BY ALL),
j AS (SELECT coalesce(lr.event_type, rr.event_type) AS event_type, coalesce(lr.c, 0) - coalesce(rr.c, 0) AS d FROM lr FULL JOIN rr ON lr.event_type = rr.event_type AND lr.summary = rr.summary)
SELECT 'ledger' AS side, event_type, CAST(sum(d) AS BIGINT) AS n FROM j WHERE d > 0 GROUP BY ALL UNION ALL SELECT 'report', event_type, CAST(sum(-d) AS BIGINT) FROM j WHERE d < 0 GROUP BY ALL"""
)
def report_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report and the ledger don't share, as multisets."""
    e = event_ledger(spark, sf_dir)
    a, b = e.where("seq % 10 != 1").select("event_type", "summary"), e.where("seq % 10 != 2").select("event_type", "summary")
    sides = a.exceptAll(b).withColumn("side", F.lit("ledger")).unionByName(b.exceptAll(a).withColumn("side", F.lit("report")))
    return sides.groupBy("side", "event_type").agg(F.count("*").alias("n"))


MARKED_SQL = "m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN '- [x] Decision: ' WHEN 'assistant' THEN '2. exp : ' ELSE 'note ' END || text AS line FROM conversations)"
MARKER = S.LEAD + "(" + "|".join(sorted(S.MARKS, key=len, reverse=True)) + r")\s*:\s*([^\n]+)"


@query(
    rf"""WITH {MARKED_SQL}, p AS (SELECT conv_id, turn, lower(regexp_extract(line, '{MARKER}', 1)) AS t, trim(regexp_extract(line, '{MARKER}', 2)) AS summary FROM m)
SELECT conv_id, turn, CASE t WHEN 'dec' THEN 'decision' WHEN 'exp' THEN 'experiment' ELSE t END AS event_type, summary FROM p WHERE t <> '' AND summary <> ''"""
)
def marker_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name what they are; bullets, check boxes and numbers before it."""
    lead = F.when(F.col("role") == "user", "- [x] Decision: ").when(F.col("role") == "assistant", "2. exp : ").otherwise("note ")
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(lead, "text").alias("text"))
    return S.marked_lines(m).select("conv_id", "turn", "event_type", "summary")


VERBS = S.VERBS
VERB = S.LEAD + "(" + "|".join(sorted(VERBS, key=len, reverse=True)) + r")\s+([^\n]+)"


@query(
    rf"""WITH m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN '* Fixed ' WHEN 'assistant' THEN 'Decided ' ELSE '' END || text AS line FROM conversations),
p AS (SELECT conv_id, turn, lower(regexp_extract(line, '{VERB}', 1)) AS v, substr(trim(regexp_replace(lower(rtrim(trim(regexp_extract(line, '{VERB}', 2)), '.!')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80) AS concept FROM m)
SELECT conv_id, turn, CASE v {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VERBS.items())} END AS event_type, concept FROM p WHERE v <> '' AND concept <> ''"""
)
def verb_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines that begin with a verb of work."""
    lead = F.when(F.col("role") == "user", "* Fixed ").when(F.col("role") == "assistant", "Decided ").otherwise("")
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(lead, "text").alias("text"))
    return S.verb_lines(m).select("conv_id", "turn", "event_type", "concept")


@query("SELECT conv_id, md5(string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Agent: ' ELSE 'System: ' END || text, chr(10) ORDER BY turn)) AS digest, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def transcript_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14"""
    turns = table(spark, sf_dir, "conversations")
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    return S.render(turns).join(n, "conv_id").select("conv_id", F.md5("text").alias("digest"), "n_turns")


@query(
    f"""WITH {EVENTS_SQL}, a AS (SELECT seq, ts, CASE WHEN seq % 9 = 0 THEN ' ' ELSE event_type END AS decision, CAST(seq % 4 AS BIGINT) AS rejected, concept FROM ev)
SELECT coalesce(nullif(trim(decision), ''), 'unknown') AS decision, count(*) AS n, CAST(sum(rejected) AS BIGINT) AS rejected, CAST(count(DISTINCT concept) AS BIGINT) AS n_reasons, CAST(floor(min(epoch(ts))) AS BIGINT) AS first_s, CAST(floor(max(epoch(ts))) AS BIGINT) AS last_s FROM a GROUP BY 1"""
)
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 over an audit stream whose reasons are a map per row."""
    e = event_ledger(spark, sf_dir).select("ts", F.when(F.col("seq") % 9 == 0, " ").otherwise(F.col("event_type")).alias("decision"), (F.col("seq") % 4).alias("rejected"), F.create_map("concept", F.lit(1)).alias("reasons"))
    key = F.coalesce(F.nullif(F.trim("decision"), F.lit("")), F.lit("unknown"))
    s = F.unix_timestamp("ts")
    return e.groupBy(key.alias("decision")).agg(F.count("*").alias("n"), F.sum("rejected").alias("rejected"), F.count_distinct(F.map_keys("reasons")[0]).alias("n_reasons"), F.min(s).alias("first_s"), F.max(s).alias("last_s"))


@query(f"WITH {EVENTS_SQL} SELECT event_type AS grp, source AS metric, CAST(sum(confidence) AS BIGINT) AS total FROM ev GROUP BY ALL")
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11"""
    return event_ledger(spark, sf_dir).groupBy(F.col("event_type").alias("grp"), F.col("source").alias("metric")).agg(F.sum("confidence").alias("total"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS runs, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS success, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS failure, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS abandoned, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM orders GROUP BY ALL")
def runtime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 by month"""
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count("*").alias("runs"), F.count_if(s == "F").alias("success"), F.count_if(s == "O").alias("failure"), F.count_if(s == "P").alias("abandoned"), F.count_distinct("o_custkey").alias("customers"))
