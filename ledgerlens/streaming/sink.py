"""A ledger that a stream of JSON lines writes exactly once, with a table of what it rejects.

Each micro-batch is one write of all its lines, split by kind into events and quarantine, and
then one record in a commit log under the batch's number. A batch that has a record is
skipped when it is repeated; what a crash has written without a record is never read. The
counters of the record are observed by the write itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import CommitLog, Conflict
from ..sources.ledgers import EVENT
from ..sources.scratch import delete, fresh

REASONS = ["malformed", "missing id", "no time", "late", "duplicate"]
FIELDS = [c.strip().split(" ")[0] for c in EVENT.split(", ")]
TABLE = f"raw string, reason string, at timestamp, {EVENT}, kind string, day string"


class LedgerSink:
    """A foreachBatch function over lines (raw) with the folder ``path``; ``late``: how far behind the newest
    committed event one may be. ``before_commit`` is called between the write and the commit, for tests of crashes."""

    def __init__(self, spark: SparkSession, path: str, late: str = "7 days", before_commit: Callable[[int], None] | None = None):
        self.spark, self.path, self.late, self.before_commit = spark, path.rstrip("/"), late, before_commit
        self.log = CommitLog(spark, f"{self.path}/commits")
        self.bases = CommitLog(spark, f"{self.path}/bases")

    def __call__(self, batch: DataFrame, number: int) -> None:
        """Commits a batch. Each line that is not blank becomes one row: an event, or a quarantined line with its reason,
        the first of REASONS that applies. Of lines with one id in a batch one stays; an id is
        compared with those of the ledger's days from the watermark on, older ones being late anyway."""
        if self.log.read(number + 1) is not None:
            return
        horizon = self.watermark()
        rows = self._judged(batch, horizon)
        name, seen = uuid.uuid4().hex, Observation()
        counters = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
        rows = rows.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("reason").isNull()).alias("events"), F.max(F.when(F.col("reason").isNull(), F.col("at"))).alias("newest"), *counters)
        rows.write.partitionBy("kind", "day").parquet(f"{self.path}/batches/{name}")
        found = seen.get
        newest = found.pop("newest")
        if self.before_commit:
            self.before_commit(number)
        ms = max([x for x in (horizon["newest"], int(newest.timestamp() * 1000) if newest else None) if x is not None], default=None)
        try:
            self.log.publish(number + 1, {"batch": number, "name": name, "newest": ms, "counts": found})
        except Conflict:  # another attempt at this batch was faster
            delete(self.spark, f"{self.path}/batches/{name}")

    def watermark(self) -> dict:
        """The time, in milliseconds, of the newest committed event, and from which on events are not late."""
        newest = (self.log.read() or {}).get("newest")
        if newest is None:
            return {"newest": None, "from": None}
        start = self.spark.range(1).select(F.unix_millis(F.timestamp_millis(F.lit(newest)) - F.expr(f"INTERVAL {self.late}")).alias("t")).head()["t"]
        return {"newest": newest, "from": start}

    def _judged(self, batch: DataFrame, horizon: dict) -> DataFrame:
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        lines = batch.where(F.trim("raw") != "").select("raw", F.from_json("raw", f"{EVENT}, _corrupt string", options).alias("_e"), F.monotonically_increasing_id().alias("_place"))
        bad = F.col("_e").isNull() | F.col("_e._corrupt").isNotNull() | ~F.trim("raw").startswith("{")
        at = F.coalesce(F.timestamp_seconds(F.col("_e.timestamp").try_cast("double")), F.try_to_timestamp(F.col("_e.timestamp")))
        late = F.lit(False) if horizon["from"] is None else F.unix_millis("at") < horizon["from"]
        rows = lines.withColumn("at", at).withColumn("event_id", F.col("_e.event_id"))
        rows = rows.withColumn("reason", F.when(bad, "malformed").when(F.coalesce(F.trim("event_id"), F.lit("")) == "", "missing id").when(F.col("at").isNull(), "no time").when(late, "late"))
        aside = fresh(self.spark, "judged")
        rows.write.parquet(aside)  # each line keeps its place
        rows = self.spark.read.schema(rows.schema).parquet(aside)
        good = rows.where("reason IS NULL")
        first = good.groupBy("event_id").agg(F.min("_place").alias("_place")).withColumn("_first", F.lit(True))
        if horizon["from"] is not None:
            known = self.events().where(F.col("day") >= F.date_format(F.timestamp_millis(F.lit(horizon["from"])), "yyyy-MM-dd")).select("event_id").distinct()
            first = first.join(known, "event_id", "left_anti")
        kept = rows.join(first, ["event_id", "_place"], "left")
        reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_first").isNull(), "duplicate")
        fields = [F.col(f"_e.{c}").alias(c) for c in FIELDS]
        return kept.select("raw", reason.alias("reason"), "at", *fields, F.when(reason.isNull(), "event").otherwise("quarantine").alias("kind"), F.coalesce(F.date_format("at", "yyyy-MM-dd"), F.lit("none")).alias("day"))

    def _committed(self) -> DataFrame:
        """All rows of committed batches: those of the last base, and the batches after it."""
        base = self.bases.read() or {"upto": 0, "name": None}
        paths = [f"{self.path}/bases-data/{base['name']}"] if base["name"] else []
        paths += [f"{self.path}/batches/{self.log.read(n)['name']}" for n in self.log.numbers() if n > base["upto"]]
        out = self.spark.createDataFrame([], TABLE)
        for p in paths:
            out = out.unionByName(self.spark.read.schema(TABLE).parquet(p))
        return out

    def events(self) -> DataFrame:
        return self._committed().where("kind = 'event'").select("at", *FIELDS, "day")

    def quarantine(self) -> DataFrame:
        return self._committed().where("kind = 'quarantine'").select("raw", "reason")

    def counts(self) -> dict[str, int]:
        """The counters of all records, added up on the driver: a few numbers per batch."""
        out: dict[str, int] = {}
        for n in self.log.numbers():
            for k, v in self.log.read(n)["counts"].items():
                out[k] = out.get(k, 0) + v
        return out

    def compact(self) -> None:
        """Merges the committed batches into one base, so that readers open few folders."""
        upto, name = self.log.last(), uuid.uuid4().hex
        if upto <= (self.bases.read() or {"upto": 0})["upto"]:
            return
        self._committed().repartition("kind", "day").write.partitionBy("kind", "day").parquet(f"{self.path}/bases-data/{name}")
        self.bases.publish(self.bases.last() + 1, {"upto": upto, "name": name})


def drain_lines(spark: SparkSession, landing: str, sink: Callable[[DataFrame, int], None], checkpoint: str, files_per_trigger: int = 1000) -> None:
    """Takes up the files that have arrived in a landing folder, each once, in bounded batches."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(landing).withColumnRenamed("value", "raw")
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
