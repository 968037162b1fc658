"""Append-only ledgers of JSON lines: tolerant readers, versions, validated appends.

A reader returns what it can read and, beside it, what it cannot: a corrupt line is never lost.
Every row has ``seq``, its place in the order of files and lines, which is the order of replay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import settle
from .scratch import exists, fresh

EVENT = "event_id string, timestamp string, project string, session_id string, event_type string, concept_candidates array<string>, summary string, evidence string, confidence int, source string, source_type string, ingestion_eligible boolean, schema_version int, scope string"
OUTCOME = "session_id string, outcome string, referenced_concepts array<string>, retrieved_concepts array<string>, reason string, goal_satisfaction double, timestamp string, project string, schema_version int"
LATEST = 2


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, seq, raw) of all lines of text files. Lines are numbered from 1 in
    their file; seq runs over all files by name. Tasks read blocks of files side by side, and
    only the line counts of blocks pass through one task."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.col("value").alias("raw")).withColumn("_m", F.monotonically_increasing_id())
    blocks = raw.groupBy("file", "_b").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    order = Window.orderBy("file", "_b").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "_b", "_first", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_all"), F.coalesce(F.sum("_n").over(own), F.lit(0)).alias("_own"))
    at = F.col("_m") - F.col("_first")
    return raw.join(blocks, ["file", "_b"]).select("file", (at + F.col("_own") + 1).alias("line_no"), (at + F.col("_all")).alias("seq"), "raw")


def parse(lines: DataFrame, schema: str = EVENT) -> tuple[DataFrame, DataFrame]:
    """(rows with seq, quarantine with file, line_no, seq, raw). Blank lines are
    neither; a line that is no object of the schema's types goes to quarantine."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    # settled, so a line is parsed once and not again for each field and filter
    text = settle(lines.where(F.trim("raw") != ""), {"_r": F.from_json("raw", f"{schema}, _corrupt string", options)})
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull() | ~F.trim("raw").startswith("{")
    good = text.where(~bad).select("seq", "_r.*").drop("_corrupt")
    return good, text.where(bad).select("file", "line_no", "seq", "raw")


def line_counts(lines: DataFrame, schema: str = EVENT) -> DataFrame:
    """One row with how many lines there are, are empty, and are malformed."""
    _, bad = parse(lines, schema)
    n = lines.agg(F.count("*").alias("n_lines"), F.count_if(F.trim("raw") == "").alias("n_empty"))
    return n.crossJoin(bad.agg(F.count("*").alias("n_malformed")))


class Upcasters:
    """Steps from one version of a row to the next, as columns. A version without a step
    only gets the next number."""

    def __init__(self, latest: int = LATEST):
        self.latest, self.steps = latest, {}

    def register(self, version: int, step: Callable[[], dict[str, Column]]) -> None:
        self.steps[version] = step

    def apply(self, rows: DataFrame) -> DataFrame:
        """All rows at the latest version, in one pass; a null version counts as the first."""
        out = rows.withColumn("schema_version", F.coalesce("schema_version", F.lit(1)))
        for v in range(1, self.latest):
            now = F.col("schema_version") == v
            changed = {c: F.when(now, e).otherwise(F.col(c)) for c, e in self.steps.get(v, dict)().items()}
            out = out.withColumns(changed | {"schema_version": F.when(now, v + 1).otherwise(F.col("schema_version"))})
        return out


def standard_upcasters() -> Upcasters:
    """Version 1 events had no scope and confidences from 0 to 1 or missing."""
    u = Upcasters()
    u.register(1, lambda: {"scope": F.coalesce("scope", F.lit("project")), "confidence": F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce("confidence", F.lit(1))))})
    return u


def read_events(spark: SparkSession, path: str, user_path: str | None = None, upcasters: Upcasters | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of the project's ledger and, after it, of the user's,
    whose rows get the scope user. A ledger that isn't there is empty."""
    found = []
    for at, scope in ((path, None), (user_path, "user")):
        if at and exists(spark, at):
            good, bad = parse(read_lines(spark, at))
            found.append((good.withColumn("scope", F.lit(scope)) if scope else good, bad))
    if not found:
        none = spark.createDataFrame([], f"seq long, {EVENT}")
        return none, spark.createDataFrame([], "file string, line_no long, seq long, raw string")
    good, bad = found[0]
    for more, worse in found[1:]:
        after = good.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("_after"))
        good = good.unionByName(more.crossJoin(F.broadcast(after)).withColumn("seq", F.col("seq") + F.col("_after")).drop("_after"))
        bad = bad.unionByName(worse)
    return (upcasters or standard_upcasters()).apply(good), bad


def issues(rows: DataFrame) -> Column:
    """What keeps an event from being appended."""
    none = F.lit(None).cast("string")
    checks = [
        (F.coalesce(F.trim("event_id"), F.lit("")) == "", "event_id missing"),
        (F.coalesce(F.trim("event_type"), F.lit("")) == "", "event_type missing"),
        (F.col("confidence").isNull() | ~F.col("confidence").between(1, 5), "confidence not from 1 to 5"),
        (F.coalesce("scope", F.lit("project")).isin("project", "user", "global") == F.lit(False), "unknown scope"),
    ]
    return F.array_compact(F.array(*[F.when(c, m).otherwise(none) for c, m in checks]))


def append(rows: DataFrame, path: str) -> None:
    """Appends events; raises, and writes nothing, if one is not valid."""
    bad = rows.withColumn("_issues", issues(rows)).where(F.size("_issues") > 0).select("event_id", "_issues").head(3)
    if bad:
        raise ValueError(f"events that are not valid: {[tuple(r) for r in bad]}")
    rows.drop("seq").write.mode("append").json(path)


def append_missing(rows: DataFrame, known: DataFrame, path: str) -> None:
    """S3, S16, D-8: appends the events whose id the ledger does not have."""
    aside = fresh(rows.sparkSession, "missing")  # joined once, then checked and appended
    rows.join(known.select("event_id").distinct(), "event_id", "left_anti").select(rows.columns).write.parquet(aside)
    append(rows.sparkSession.read.parquet(aside), path)


def append_log(rows: DataFrame, path: str) -> None:
    """A row per entry of a log (audit, usage, maintenance, promotions, queue)."""
    rows.write.mode("append").json(path)


def find_event(events: DataFrame, event_id: str) -> DataFrame:
    """The event of an id; raises if there is none."""
    found = events.where(F.col("event_id") == event_id)
    if found.isEmpty():
        raise KeyError(event_id)
    return found


def tail(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows in order."""
    return rows.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def first_ledger(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of several places where a ledger may lie."""
    return next((p for p in paths if exists(spark, p)), None)


def migrate(spark: SparkSession, path: str, out: str, upcasters: Upcasters | None = None) -> DataFrame:
    """Writes the ledger at the latest version to ``out``; (version, n) as it was."""
    good, _ = parse(read_lines(spark, path))
    (upcasters or standard_upcasters()).apply(good).drop("seq").write.mode("errorifexists").json(out)
    return good.groupBy(F.coalesce("schema_version", F.lit(1)).alias("version")).agg(F.count("*").alias("n"))


def drain(spark: SparkSession, landing: str, ledger: str, checkpoint: str, files_per_trigger: int = 1000, rejected: str | None = None) -> None:
    """Moves pending events from a landing folder to the ledger: each file once, in
    bounded batches, without ids that the ledger has. Events without id go to the folder ``rejected`` (beside the ledger if
    none is named). ``streaming.sink.LedgerSink`` also survives a crash between its writes."""
    aside = rejected or f"{ledger.rstrip('/')}-rejected"

    def take(batch: DataFrame, _: int) -> None:
        nameless = batch.where("event_id IS NULL")
        if not nameless.isEmpty():
            nameless.write.mode("append").json(aside)
        new = batch.where("event_id IS NOT NULL").dropDuplicates(["event_id"])
        if exists(spark, ledger):
            new = new.join(spark.read.schema(EVENT).json(ledger).select("event_id").distinct(), "event_id", "left_anti").select(batch.columns)
        new.write.mode("append").json(ledger)

    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(landing)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def hook_sink(ledger: str, most_rows: int = 5000, most_chars: int = 2000, overflow: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of shell results as pending events: secrets are redacted, evidence is cut and
    a batch keeps its newest ``most_rows`` rows; older ones go to the folder ``overflow`` (beside the ledger if none is named)."""
    from ..functions.text import redact

    rest = overflow or f"{ledger.rstrip('/')}-overflow"

    def take(batch: DataFrame, _: int) -> None:
        clean = batch.withColumn("evidence", F.substring(redact(F.col("evidence")), 1, most_chars)).withColumn("summary", redact(F.col("summary")))
        aside = fresh(batch.sparkSession, "hooks")
        clean.withColumn("_n", F.monotonically_increasing_id()).write.parquet(aside)  # each row keeps its number
        rows = batch.sparkSession.read.parquet(aside)
        newest = rows.orderBy(F.desc("timestamp"), "event_id", "_n").limit(most_rows)
        newest.drop("_n").write.mode("append").json(ledger)
        older = rows.join(newest.select("_n"), "_n", "left_anti").drop("_n")
        if not older.isEmpty():
            older.write.mode("append").json(rest)

    return take
