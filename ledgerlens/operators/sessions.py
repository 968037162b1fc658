"""From transcripts to events: extraction, reports, outcomes (F27, F28, L1, L15, L33, P20,
S14, T3, U2, W15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug, strip
from ..sources.tables import mapped
from .events import is_noise, normalised

# Marks of lines, verbs of work, priorities of sources.
LEAD = r"(?i)^\s*(?:-\s*(?:\[[ xX/]\]\s*)?|[*]\s*(?:\[[ xX/]\]\s*)?|\d+\.\s*|\[[ xX/]\]\s*)?"
MARKS = {"observation": "observation", "obs": "observation", "decision": "decision", "dec": "decision", "outcome": "outcome", "out": "outcome", "hypothesis": "hypothesis", "hyp": "hypothesis", "experiment": "experiment", "exp": "experiment", "failure": "failure", "fail": "failure", "risk": "risk", "validation": "validation", "val": "validation"}
VERBS = {"fix": "fix", "fixed": "fix", "add": "addition", "added": "addition", "remove": "removal", "removed": "removal", "decide": "decision", "decided": "decision", "fail": "failure", "failed": "failure", "implement": "implementation", "implemented": "implementation", "refactor": "refactoring", "refactored": "refactoring", "migrate": "migration", "migrated": "migration", "validate": "validation", "validated": "validation"}
PRIORITY = {"chat": 0, "chat-fallback": 1, "orchestrator": 2, "diff": 3}
SHELL = r"(?i)^\s*(\$ |command\s+`|exit code)"


def transcript(rows: DataFrame, kind: str) -> DataFrame:
    """(conv_id, turn, role, text) of one of four formats: ``messages`` (role and content
    in JSON), ``updates`` (type and text of an update in JSON), ``markdown`` (## User, ## Agent
    headings in one document) and ``turns`` (columns as they are)."""
    if kind == "turns":
        return rows.select("conv_id", "turn", "role", "text")
    if kind == "markdown":
        part = F.split("raw", r"(?m)^(?=##\s+(?:User|Agent|Assistant|System)\b)")
        found = rows.select("conv_id", F.posexplode(part).alias("turn", "_p")).withColumn("_r", F.regexp_extract("_p", r"^##\s+(\w+)", 1)).where("_r != ''")
        text = strip(F.regexp_replace("_p", r"^##[^\n]*\n?", ""))
        return found.select("conv_id", "turn", F.when(F.lower("_r") == "user", "user").when(F.lower("_r") == "system", "system").otherwise("assistant").alias("role"), text.alias("text"))
    schema = {"messages": "role string, content string", "updates": "type string, text string"}[kind]
    j = rows.withColumn("_j", F.from_json("raw", schema)).where("_j IS NOT NULL")
    if kind == "messages":
        return j.select("conv_id", "turn", "_j.role", F.col("_j.content").alias("text")).where("role IS NOT NULL AND text IS NOT NULL")
    role = F.when(F.col("_j.type").startswith("user"), "user").when(F.col("_j.type").startswith("system"), "system").otherwise("assistant")
    return j.select("conv_id", "turn", role.alias("role"), "_j.text").where("text IS NOT NULL")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, text): a conversation as lines of User:, Agent: and System:."""
    who = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Agent: ").otherwise("System: ")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(who, "text").alias("l"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("text"))


def _lines(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("line", "_l"))


def marked_lines(turns: DataFrame) -> DataFrame:
    """events of the lines that name what they are, behind bullets, boxes or numbers."""
    mark = LEAD + "(" + "|".join(sorted(MARKS, key=len, reverse=True)) + r")\s*:\s*([^\n]+)"
    rows = _lines(turns).withColumn("_t", F.lower(F.regexp_extract("_l", mark, 1))).where("_t != ''")
    return rows.select("conv_id", "turn", "line", mapped(F.col("_t"), MARKS).alias("event_type"), F.trim(F.regexp_extract("_l", mark, 2)).alias("summary")).where("summary != ''")


def verb_lines(turns: DataFrame) -> DataFrame:
    """events of the lines that begin with a verb of work, with the slug of what follows as
    the concept, at most 80 characters."""
    verb = LEAD + "(" + "|".join(sorted(VERBS, key=len, reverse=True)) + r")\s+([^\n]+)"
    rows = _lines(turns).withColumn("_v", F.lower(F.regexp_extract("_l", verb, 1))).where("_v != ''")
    tail = F.regexp_replace(F.trim(F.regexp_extract("_l", verb, 2)), "[.!]+$", "")
    return rows.select("conv_id", "turn", "line", mapped(F.col("_v"), VERBS).alias("event_type"), F.trim("_l").alias("summary"), F.substring(slug(tail), 1, 80).alias("concept")).where("concept != ''")


def extract(turns: DataFrame, given: DataFrame | None = None, pending: DataFrame | None = None, changes: DataFrame | None = None, mode: str = "auto", verbs: bool = False) -> tuple[DataFrame, DataFrame]:
    """L1, U2, D-1, P3, W15: (events, counters) of sessions.

    Structured events (given, pending, of changed files), each (session_id, event_type,
    concept, summary, evidence, confidence, source), come first; mode auto takes a session's
    marked lines if it has none of these, and its verbs of work if it has no marks either and
    ``verbs`` asks for them. skip gives none, markers only marks. Then events are normalised,
    noise goes, and of those of one session, type, concept (80 characters) and evidence the
    first stays, by source priority and place. The counters say how many were there and went.
    """
    cols = ["session_id", "event_type", "concept", "summary", "evidence", "confidence", "source"]
    text = lambda d, concept: d.select(F.col("conv_id").cast("string").alias("session_id"), "event_type", concept.alias("concept"), "summary", F.col("summary").alias("evidence"), F.lit(3.0).alias("confidence"), F.lit("chat").alias("source"), (F.col("turn") * 1_000_000 + F.col("line")).cast("long").alias("_at"))
    marks = text(marked_lines(turns), F.substring(slug(F.col("summary")), 1, 80))
    none = marks.where(F.lit(False))
    parts = [d.select(*cols).withColumn("confidence", F.col("confidence").cast("double")).withColumn("_at", F.xxhash64(*cols)) for d in (given, pending, changes) if d is not None]
    structured = none
    for p in parts:
        structured = structured.unionByName(p)
    if mode == "skip":
        found = none
    elif mode == "markers":
        found = marks
    else:
        have = structured.select("session_id").distinct()
        found = structured.unionByName(marks.join(have, "session_id", "left_anti").select(marks.columns))
        if verbs:
            said = have.unionByName(marks.select("session_id")).distinct()
            v = text(verb_lines(turns), F.col("concept")).withColumn("source", F.lit("chat-fallback"))
            found = found.unionByName(v.join(said, "session_id", "left_anti").select(v.columns))
    ids = found.withColumn("event_id", F.sha2(F.concat_ws("|", "session_id", "event_type", "concept", "summary", "evidence", "source", F.col("_at").cast("string")), 256)).withColumn("fallback", F.col("concept"))
    norm = normalised(ids)
    rows = ids.select("event_id", "session_id", "concept", "source", "_at").join(norm, "event_id")
    empty = F.lit(None).cast("string")
    noise = is_noise(F.col("event_type"), F.col("source"), empty, F.col("summary"), F.col("evidence"), empty, F.lit(None).cast("boolean"))
    order = F.coalesce(mapped(F.col("source"), {k: str(v) for k, v in PRIORITY.items()}).cast("int"), F.lit(99))
    key = Window.partitionBy("session_id", "event_type", F.substring("concept", 1, 80), F.lower("evidence")).orderBy(order, "_at", "event_id")
    judged = rows.withColumns({"_noise": F.coalesce(noise, F.lit(False)) & ~F.col("rejected"), "_n": F.row_number().over(key)})
    kept = judged.where("NOT rejected AND NOT _noise AND _n = 1").select("event_id", *cols)
    counters = judged.groupBy("session_id").agg(F.count("*").alias("found"), F.count_if("rejected").alias("rejected"), F.count_if("_noise").alias("noise"), F.count_if(F.expr("NOT rejected AND NOT _noise AND _n > 1")).alias("repeated"), F.count_if(F.expr("NOT rejected AND NOT _noise AND _n = 1")).alias("kept"))
    return kept, counters


def inline_gate(rows: DataFrame, most: int = 20) -> DataFrame:
    """P20: inline memories (session_id, seq, summary, evidence, confidence) with why each is
    refused, null if it is not: shaped like a command log, confidence 3 or more without twenty
    characters of evidence, repeated by its first 200 characters, or past the session's limit."""
    log = F.col("summary").rlike(SHELL) | F.coalesce(F.col("evidence").rlike(SHELL), F.lit(False))
    thin = (F.col("confidence") >= 3) & (F.length(F.coalesce("evidence", F.lit(""))) < 20)
    same = Window.partitionBy("session_id", F.substring(F.lower("summary"), 1, 200)).orderBy("seq")
    judged = rows.withColumn("_why", F.when(log, "command_log").when(thin, "weak_evidence")).withColumn("_n", F.sum(F.when(F.col("_why").isNull(), 1).otherwise(0)).over(same.rowsBetween(Window.unboundedPreceding, 0)))
    judged = judged.withColumn("_why", F.when(F.col("_why").isNull() & (F.col("_n") > 1), "duplicate").otherwise(F.col("_why")))
    ok = F.sum(F.when(F.col("_why").isNull(), 1).otherwise(0)).over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return judged.withColumn("refused", F.when(F.col("_why").isNull() & (ok > most), "rate_limit").otherwise(F.col("_why"))).drop("_why", "_n")


def close_stale(sessions: DataFrame, turns: DataFrame, now: Column, after_hours: float = 12.0) -> DataFrame:
    """(session_id, outcome, reason) for sessions (session_id, started_at, ended_at)
    that never ended: with a transcript a success that is committed, else abandoned."""
    open_ = sessions.where(F.col("ended_at").isNull() & ((now.cast("double") - F.col("started_at").cast("double")) > after_hours * 3600))
    said = turns.select(F.col("conv_id").cast("string").alias("session_id")).distinct().withColumn("_t", F.lit(True))
    has = F.coalesce("_t", F.lit(False))
    return open_.join(said, "session_id", "left").select("session_id", F.when(has, "success").otherwise("abandoned").alias("outcome"), F.when(has, "recovered_transcript").otherwise("no_transcript").alias("reason"))


def outcome_row(session: str, outcome: str, retrieved: list[str], referenced: list[str], at: str) -> tuple:
    """One row of the outcome ledger."""
    return session, outcome, referenced, retrieved, None, None, at, None, 2


def sessionized(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n) of runs of events with gaps below ``gap``: the batch twin of
    the stream, which has every window, the last ones too."""
    w = F.session_window(F.col("ts").cast("timestamp"), gap)
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")
