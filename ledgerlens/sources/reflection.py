"""Reflect (L2): what sessions say becomes events, a report and an outcome, under one commit."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import report
from ..operators.sessions import extract
from .commits import CommitLog

EVENTS = "event_id string, session_id string, event_type string, concept string, summary string, evidence string, confidence int, source string"
REPORTS = "session_id string, content string"
OUTCOMES = "session_id string, outcome string, referenced_concepts array<string>, n_events long, reason string"
SCHEMAS = {"events": EVENTS, "reports": REPORTS, "outcomes": OUTCOMES}


class Reflections:
    """The three tables under ``path``. ``after`` is called with the name of each after it was written, for tests of failures."""

    def __init__(self, spark: SparkSession, path: str, project: str = "default", after: Callable[[str], None] | None = None):
        self.spark, self.path, self.project, self.after = spark, path.rstrip("/"), project, after
        self.log = CommitLog(spark, f"{self.path}/commits")

    def table(self, kind: str) -> DataFrame:
        """The committed rows of events, reports or outcomes."""
        out = self.spark.createDataFrame([], SCHEMAS[kind])
        for n in self.log.numbers():
            out = out.unionByName(self.spark.read.schema(SCHEMAS[kind]).parquet(f"{self.path}/{kind}/{self.log.read(n)['name']}"))
        return out

    def _put(self, kind: str, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.path}/{kind}/{name}")
        if self.after:
            self.after(kind)
        return self.spark.read.schema(SCHEMAS[kind]).parquet(f"{self.path}/{kind}/{name}")

    def reflect(self, turns: DataFrame, **how) -> dict[str, int]:
        """Extracts the events of sessions (conv_id, turn, role, text; see ``operators.sessions.extract``), keeps those whose id no
        commit has, and writes with them a report and an outcome for each session that has new ones. All or
        nothing counts: a failure at any write leaves the tables as they were. The counters of events are
        observed by the write itself. Without new events nothing is written."""
        n, name = self.log.last(), uuid.uuid4().hex
        found, _ = extract(turns, **how)
        known = self.table("events").select("event_id")
        fresh = found.join(known, "event_id", "left_anti").select(*[F.col(c).cast(t) for c, t in (x.split(" ") for x in EVENTS.split(", "))])
        seen = Observation()
        events = self._put("events", fresh.observe(seen, F.count("*").alias("events"), F.count_if(F.col("event_type") == "failure").alias("failures")), name)
        counts = seen.get
        if not counts["events"]:
            return counts | {"sessions": 0}
        listed = F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("type"), "concept", "evidence", "confidence")))
        of = events.groupBy("session_id").agg(listed.alias("_l"))  # a session's report is one document
        day = F.coalesce("session_id", F.lit(""))
        reports = self._put("reports", of.select("session_id", report(day, F.lit(self.project), F.to_json("_l")).alias("content")), name)
        failed = F.count_if(F.col("event_type") == "failure")
        outcomes = events.groupBy("session_id").agg(F.when(failed > F.count("*") - failed, "failure").otherwise("success").alias("outcome"), F.array_sort(F.collect_set("concept")).alias("referenced_concepts"), F.count("*").alias("n_events"))
        self._put("outcomes", outcomes.withColumn("reason", F.lit("reflected")), name)
        record = counts | {"sessions": reports.count()}
        self.log.publish(n + 1, {"name": name, "counts": record})
        return record
