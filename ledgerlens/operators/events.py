"""Operators on event ledgers: filters, policies, dedupe, normalisation (S3, P1 to P9, D-1 to D-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug

# Fixed values of the noise policy.
COMMAND_LOG = r"(?i)^Command\s+(?:execution|failed|succeeded):|^Tool\s+(?:call|result|execution):|^MCP\s+(?:call|result|tool):|^Exit code:|^Output:\s*\n?FAILED:|^Command `.*` executed with exit code|^Command `.*`\s*\n?Output:"
REPORT = r"(?i)session end / commit complete|session end completed|extracted knowledge events:|graph & index updates:|session duration:|tool calls:|^report:"
LOG_TYPES = ["telemetry", "command_log", "search_log"]
DURABLE = ["failure", "decision", "outcome", "validation", "hypothesis", "experiment", "risk", "deprecation"]
RUNTIME_SOURCES = ["opencode_hook", "orchestrator", "agent_runtime_signal"]
PRIVATE_FOLDERS = ["sessions", "session_reports", "reports", ".runtime", "state"]
KNOWN_TYPES = ["observation", "decision", "hypothesis", "experiment", "outcome", "failure", "risk", "validation", "deprecation"]
DECISION_VERB = r"(?i)\b(decided|chose|selected|picked|agreed|concluded)\b"


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def is_noise(event_type: Column, source: Column, source_type: Column, summary: Column, evidence: Column, path: Column, eligible: Column, tool: str = "kb") -> Column:
    """Whether an event is operational noise; the first rule that applies decides. What the
    engine itself writes has source types ``tool``_..., and lies in folders of .``tool``."""
    kind, src, stype = _low(event_type), _low(source), _low(source_type)
    where = F.translate(_low(path), "\\", "/")
    s, e = F.coalesce(summary, F.lit("")), F.coalesce(evidence, F.lit(""))
    logged = s.rlike(COMMAND_LOG) | e.rlike(COMMAND_LOG)
    durable = kind.isin(DURABLE)
    runtime = (src == "orchestrator") | (src.isin(RUNTIME_SOURCES) & (stype == "agent_runtime_signal"))
    private = F.lit(False)
    for p in PRIVATE_FOLDERS:
        private = private | F.contains(where, F.lit(f".{tool}/{p}"))
    return (
        F.when(F.coalesce(~eligible, F.lit(False)), True)
        .when(kind.isin(LOG_TYPES), True)
        .when(stype.startswith(f"{tool}_"), True)
        .when(private, True)
        .when(runtime & (kind == "failure"), logged)
        .when(runtime, ~durable)
        .when(F.concat_ws("\n", s, e).rlike(REPORT) & src.isin(RUNTIME_SOURCES), True)
        .when(logged & (src == "opencode_hook") & (kind == "failure"), True)
        .when(logged, ~durable)
        .otherwise(False)
    )


def quality(summary: Column, evidence: Column) -> Column:
    """P4"""
    s = F.coalesce(summary, F.lit(""))
    n = F.length(s)
    score = F.when(n > 30, 0.3).otherwise(0.0) + F.when(n > 80, 0.2).otherwise(0.0) + F.when(F.length(evidence) > 20, 0.3).otherwise(0.0) + F.when(s.rlike(DECISION_VERB), 0.2).otherwise(0.0)
    return F.when(s == "", 0.0).otherwise(F.least(score, F.lit(1.0)))


def in_scope(scope: Column, wanted: str | None) -> Column:
    """A null scope counts as project; no wanted scope matches all."""
    return F.lit(True) if wanted is None else F.coalesce(scope, F.lit("project")) == wanted


def in_window(ts: Column, since: str | None, until: str | None) -> Column:
    """Inclusive; a missing or unreadable time is inside."""
    ok = F.lit(True)
    if since:
        ok = ok & (ts >= F.lit(since).cast("timestamp"))
    if until:
        ok = ok & (ts <= F.lit(until).cast("timestamp"))
    return F.coalesce(ok, F.lit(True))


def of_concept(candidates: Column, name: str) -> Column:
    """Any candidate whose slug is the name's."""
    return F.exists(candidates, lambda c: slug(c) == slug(F.lit(name)))


def unassigned(events: DataFrame) -> DataFrame:
    """Events that no concept is named for."""
    return events.where(F.coalesce(F.size("concept_candidates"), F.lit(-1)) <= 0)


def evidence_of(candidates: DataFrame, events: DataFrame, most: int = 5) -> DataFrame:
    """(candidate, n_found, evidence) of candidates (candidate, source_event_ids): how many of their events are there, and the
    evidence of the first ``most`` by seq. Ids that repeat count once; candidates without any have 0 and an empty list."""
    ids = candidates.select("candidate", F.explode(F.array_distinct("source_event_ids")).alias("event_id"))
    last = events.groupBy("event_id").agg(F.max_by(F.struct("seq", "evidence"), "seq").alias("e"))
    found = ids.join(last, "event_id").select("candidate", "e.*")
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("candidate").orderBy("seq"))).groupBy("candidate").agg(F.count("*").alias("n_found"), F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.struct("seq", "evidence")))).alias("_e"))
    out = candidates.select("candidate").join(first, "candidate", "left")
    return out.select("candidate", F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce(F.transform("_e", lambda x: x["evidence"]), F.array().cast("array<string>")).alias("evidence"))


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def append_new(old: DataFrame, new: DataFrame, key: str = "event_id") -> DataFrame:
    """S3, D-8: the rows of new whose key the ledger lacks; repeats within new stay."""
    return new.join(old.select(key), key, "left_anti")


def normalised(df: DataFrame) -> DataFrame:
    """P9 over event_type, summary, fallback, evidence, confidence: rows with what they become
    and whether they are rejected."""
    summary = F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.col("summary")).otherwise(F.when(F.coalesce(F.col("fallback"), F.lit("")) != "", F.col("fallback")))
    kind = F.lower(F.trim(F.coalesce("event_type", F.lit(""))))
    c = F.col("confidence").cast("double")
    level = F.when(c.isNull(), 4).when(c.between(0, 1), F.floor(c * 5)).otherwise(F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)))
    return df.select(
        "event_id",
        F.when(kind.isin(KNOWN_TYPES), kind).otherwise("observation").alias("event_type"),
        summary.alias("summary"),
        F.when(F.coalesce(F.col("evidence"), F.lit("")) != "", F.col("evidence")).otherwise(summary).alias("evidence"),
        F.when(level.between(1, 5), level).otherwise(1).cast("int").alias("confidence"),
        summary.isNull().alias("rejected"),
    )


def keep_within_caps(df: DataFrame, size: Column, rows: int, total: int, *newest_first: Column) -> DataFrame:
    """From the newest on, rows are kept while fewer than ``rows`` came before and the sizes
    add up to ``total`` at most; the first that breaks a cap ends it."""
    w = Window.orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_n", F.count("*").over(w)).withColumn("_sum", F.sum(size).over(w))
    broken = (F.col("_n") > rows) | (F.col("_sum") > total)
    return out.withColumn("kept", F.max(broken.cast("int")).over(w) == 0).drop("_n", "_sum")
