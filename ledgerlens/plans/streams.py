"""Streams that run over what has arrived, and must equal their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import EVENTS_SQL, event_ledger, table
from ..streaming import ledger, sink, status
from .lifecycle import REPLAY_SQL
from .registry import query


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    schema = table(spark, sf_dir, "events").schema
    return ledger.read_events(spark, f"{sf_dir}/events.parquet", schema), ledger.scratch(spark, "run")


@query("SELECT DISTINCT event_id, event_type FROM events")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger read twice over keeps each event once."""
    e, at = _events(spark, sf_dir)
    twice = e.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    ledger.run_once(ledger.deduplicated(twice).select("event_id", "event_type"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("event_id long, event_type string").parquet(f"{at}/out")


@query("WITH e AS (SELECT user_id, list(event_type ORDER BY event_id) AS l FROM events GROUP BY user_id), r AS (SELECT user_id, len(l) AS n, list_reduce(l, lambda a, k: struct_pack(c := CASE k WHEN 'purchase' THEN least(5, a.c + 1) WHEN 'error' THEN greatest(1, a.c - 1) ELSE a.c END, f := a.f + CASE WHEN k = 'error' THEN 1 ELSE 0 END), struct_pack(c := 1, f := 0)) AS s FROM e) SELECT user_id, CAST(s.c AS INTEGER) AS confidence, CAST(s.f AS INTEGER) AS failures, CAST(n AS INTEGER) AS n FROM r")
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: the last state of each user after all micro-batches."""
    e, at = _events(spark, sf_dir)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    ledger.run_batches(ledger.status_counts(e.select("user_id", "event_id", "event_type")), write, f"{at}/checkpoint", "update")
    rows = spark.read.schema("user_id long, confidence int, failures int, n int, batch int").parquet(f"{at}/out")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("confidence", "failures", "n"), "batch").alias("s")).select("user_id", "s.confidence", "s.failures", "s.n")


@query()
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows that the watermark has closed."""
    e, at = _events(spark, sf_dir)
    ledger.run_once(ledger.sessions(e.select("user_id", "ts")), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("user_id long, started timestamp, ended timestamp, n long").parquet(f"{at}/out")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows of an hour."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "mean")


LINES_SQL = f"""
WITH {EVENTS_SQL},
a AS (SELECT CASE WHEN seq % 50 = 0 THEN 'malformed' WHEN seq % 41 = 0 THEN 'missing id' WHEN seq % 37 = 0 THEN 'no time' WHEN seq % 2 = 1 AND seq % 29 = 0 THEN 'late' ELSE 'event' END AS kind, seq FROM ev),
b AS (SELECT kind, count(*) AS n FROM a GROUP BY kind UNION ALL SELECT 'duplicate', count(*) FROM a WHERE kind = 'event' AND seq % 10 = 0)
SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM b WHERE n > 0 GROUP BY kind
"""


@query(LINES_SQL)
def stream_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending events as lines that arrive in two parts, some malformed, without id or time, late or
    repeated, through a sink that gets each batch twice: each line is in one of the two tables, once."""
    e, at = event_ledger(spark, sf_dir), ledger.scratch(spark, "sink")
    old = (F.col("seq") % 2 == 1) & (F.col("seq") % 29 == 0)
    time = F.when(F.col("seq") % 37 == 0, F.lit("some day")).when(old, F.lit("1999-01-01T00:00:00Z")).otherwise(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = e.select("seq", F.struct(F.when(F.col("seq") % 41 != 0, F.col("event_id")).otherwise(F.lit("")).alias("event_id"), time.alias("timestamp"), "session_id", "event_type", "summary", F.col("confidence")).alias("j"))
    raw = F.when(F.col("seq") % 50 == 0, F.concat(F.lit('{"event_id": '), F.col("seq").cast("string"))).otherwise(F.to_json("j"))
    lines = rows.select("seq", raw.alias("value"), F.explode(F.when(F.col("seq") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    bad = (F.col("seq") % 50 == 0) | (F.col("seq") % 41 == 0) | (F.col("seq") % 37 == 0) | old
    lines = lines.where(~bad | (F.col("copy") == 0))
    target = sink.LedgerSink(spark, f"{at}/ledger", "365 days")

    def twice(batch: DataFrame, number: int) -> None:
        target(batch, number)
        target(batch, number)

    # the even ones come first, so that the odd ones find a watermark; all second copies come last
    for part in (lines.where("seq % 2 = 0 AND copy = 0"), lines.where("seq % 2 = 1 OR copy = 1")):
        part.select("value").write.mode("append").text(f"{at}/landing")
        sink.drain_lines(spark, f"{at}/landing", twice, f"{at}/checkpoint")
    target.compact()
    n = target.events().groupBy(F.lit("event").alias("kind")).agg(F.count("*").alias("n"))
    return n.unionByName(target.quarantine().groupBy(F.col("reason").alias("kind")).agg(F.count("*").alias("n")))


@query(f"WITH {EVENTS_SQL}, {REPLAY_SQL} SELECT concept, r.st AS status, CAST(r.c AS INTEGER) AS confidence, CAST(len(r.ss) AS INTEGER) AS session_count, CAST(r.e AS INTEGER) AS evidence_count, CAST(r.n AS INTEGER) AS n_transitions FROM f")
def stream_concept_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status machine over the ledger as it arrives in three parts; the stream is stopped after each and
    started again from its checkpoint. Equal to the replay of the whole ledger."""
    e, at = event_ledger(spark, sf_dir).select("concept", "seq", "session_id", "event_type", "evidence", "ts"), ledger.scratch(spark, "status")
    bounds = e.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).head()
    width = (bounds["b"] - bounds["a"]) // 3 + 1

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    for k in range(3):
        e.where(F.col("seq").between(bounds["a"] + k * width, bounds["a"] + (k + 1) * width - 1)).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{at}/in")
        ledger.run_batches(status.status_stream(stream), write, f"{at}/checkpoint", "update")
    rows = spark.read.schema(f"{status.OUTPUT}, batch int").parquet(f"{at}/out")
    last = rows.groupBy("concept").agg(F.max_by(F.struct("status", "confidence", "sessions", "evidence", "transitions"), "batch").alias("s"))
    return last.select("concept", "s.status", "s.confidence", F.col("s.sessions").alias("session_count"), F.col("s.evidence").alias("evidence_count"), F.col("s.transitions").alias("n_transitions"))
