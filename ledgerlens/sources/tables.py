"""Tables as ledgers: how the entities of the engine are read from Parquet.

Every ledger carries ``seq``, its order of replay; row order is never relied on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = {"purchase": "validation", "error": "failure", "signup": "decision", "view": "observation", "click": "experiment"}
SOURCES = ["chat", "diff", "orchestrator", "chat-fallback"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(c: Column, values: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in values.items():
        out = out.when(c == k, v)
    return out


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knowledge-event ledger over the table events; its SQL twin is EVENTS_SQL."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k": *(\d+)', 1)
    kind = mapped(F.col("event_type"), EVENT_TYPES)
    day = F.date_format("ts", "yyyy-MM-dd")
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        day.alias("day"),
        F.concat_ws("|", F.col("user_id").cast("string"), day).alias("session_id"),
        F.col("user_id"),
        kind.alias("event_type"),
        F.concat(F.lit("c"), k).alias("concept"),
        F.concat_ws(" ", kind, F.lit("of"), F.concat(F.lit("c"), k), F.when(F.col("event_id") % 3 == 0, F.lit("was decided after review of the whole run by the team"))).alias("summary"),
        F.col("props").alias("evidence"),
        (F.col("event_id") % 5 + 1).cast("int").alias("confidence"),
        source.alias("source"),
        F.when(F.col("event_id") % 7 == 0, "user").when(F.col("event_id") % 5 != 0, "project").alias("scope"),
        F.col("value"),
    )


EVENTS_SQL = r"""
ev AS (
  SELECT event_id AS seq, 'e' || CAST(event_id AS VARCHAR) AS event_id, ts, strftime(ts, '%Y-%m-%d') AS day,
    CAST(user_id AS VARCHAR) || '|' || strftime(ts, '%Y-%m-%d') AS session_id, user_id,
    CASE event_type WHEN 'purchase' THEN 'validation' WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'decision' WHEN 'view' THEN 'observation' WHEN 'click' THEN 'experiment' END AS event_type,
    'c' || regexp_extract(props, '"k": *(\d+)', 1) AS concept,
    CASE event_type WHEN 'purchase' THEN 'validation' WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'decision' WHEN 'view' THEN 'observation' WHEN 'click' THEN 'experiment' END
      || ' of c' || regexp_extract(props, '"k": *(\d+)', 1) || CASE WHEN event_id % 3 = 0 THEN ' was decided after review of the whole run by the team' ELSE '' END AS summary,
    props AS evidence, CAST(event_id % 5 + 1 AS INTEGER) AS confidence,
    CASE event_id % 4 WHEN 0 THEN 'chat' WHEN 1 THEN 'diff' WHEN 2 THEN 'orchestrator' ELSE 'chat-fallback' END AS source,
    CASE WHEN event_id % 7 = 0 THEN 'user' WHEN event_id % 5 <> 0 THEN 'project' END AS scope, value
  FROM events)
"""


def outcome_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session (an order) and concept (a part) that it retrieved; OUTCOMES_SQL."""
    o, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    outcome = mapped(F.col("o_orderstatus"), {"F": "success", "O": "failure", "P": "abandoned"})
    # a row per session: its concepts stay a list, so both lists are resolved without a second join
    concepts = items.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_partkey")).alias("retrieved_concepts"),
        F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_partkey")))).alias("referenced_concepts"),
    )
    return o.join(concepts, o.o_orderkey == concepts.l_orderkey).select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("ts"), outcome.alias("outcome"), "retrieved_concepts", "referenced_concepts")


OUTCOMES_SQL = """
oc AS (
  SELECT o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failure' WHEN 'P' THEN 'abandoned' END AS outcome,
    l_partkey AS concept, max(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS referenced
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
"""


def concept_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry over the table part; REGISTRY_SQL."""
    p = table(spark, sf_dir, "part")
    status = F.when(F.col("p_size") <= 10, "candidate").when(F.col("p_size") <= 25, "emerging").when(F.col("p_size") <= 40, "validated").when(F.col("p_size") <= 47, "canonical").otherwise("deprecated")
    return p.select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("canonical_name"), F.array("p_brand", "p_type").alias("aliases"), status.alias("status"), F.col("p_size").alias("evidence_count"), (F.col("p_size") % 5 + 1).alias("confidence"))


REGISTRY_SQL = """
rg AS (
  SELECT p_partkey AS concept_id, p_name AS canonical_name, p_brand AS alias1, p_type AS alias2,
    CASE WHEN p_size <= 10 THEN 'candidate' WHEN p_size <= 25 THEN 'emerging' WHEN p_size <= 40 THEN 'validated' WHEN p_size <= 47 THEN 'canonical' ELSE 'deprecated' END AS status,
    p_size AS evidence_count, p_size % 5 + 1 AS confidence FROM part)
"""
