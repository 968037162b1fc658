"""Events by concept with the states they lead to, and re-assignment with a replay of only what it moves.

Both lie in buckets of concepts; a commit names the folder of each bucket. A change reads and
rewrites the buckets of the concepts that lose or win events and replays these concepts; all
other states stay as they are.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import STATE, replay
from .commits import CommitLog

EVENT_ROW = "concept string, seq long, event_id string, session_id string, event_type string, summary string, evidence string"
STATE_ROW = f"concept string, s {STATE}, last_session string"


def concept_key(name: str) -> str:
    """A concept's name as it stands in events: blanks as hyphens, lower case."""
    return name.strip().replace(" ", "-").lower()


class ConceptStates:
    """A row per event and concept, and a state per concept, under ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.log = CommitLog(spark, f"{self.path}/commits")

    def _bucket(self) -> Column:
        return F.pmod(F.crc32(F.col("concept").cast("binary")), F.lit(self.buckets)).cast("int")

    def _read(self, kind: str, buckets: list[int] | None = None) -> DataFrame:
        schema = EVENT_ROW if kind == "events" else STATE_ROW
        of = {int(b): name for b, name in (self.log.read() or {"buckets": {}})["buckets"].items()}
        out = self.spark.createDataFrame([], schema)
        for name in sorted({of[b] for b in (of if buckets is None else buckets) if b in of}):
            mine = [b for b in of if of[b] == name and (buckets is None or b in buckets)]
            rows = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{kind}/{name}")
            out = out.unionByName(rows.where(F.col("bucket").isin(mine)).drop("bucket"))
        return out

    def events(self) -> DataFrame:
        return self._read("events")

    def states(self) -> DataFrame:
        """(concept, s, last_session) as ``operators.lifecycle.replay`` gives them."""
        return self._read("states")

    def _write(self, kind: str, rows: DataFrame, name: str) -> None:
        rows.withColumn("bucket", self._bucket()).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{kind}/{name}")

    def build(self, events: DataFrame) -> None:
        """Takes up events (concept, seq, event_id, ...) and replays all concepts. Events without a concept have no state."""
        n, name = self.log.last(), uuid.uuid4().hex
        cols = [c.split(" ")[0] for c in EVENT_ROW.split(", ")]
        self._write("events", events.where("concept IS NOT NULL").select(*cols), name)
        stored = self.spark.read.schema(f"{EVENT_ROW}, bucket int").parquet(f"{self.path}/events/{name}")
        self._write("states", replay(stored).select("concept", "s", "last_session"), name)
        self.log.publish(n + 1, {"buckets": {str(b): name for b in range(self.buckets)}})

    def reassign(self, to: str, source: str | None = None, match: str | None = None, event_id: str | None = None, dry_run: bool = False) -> dict[str, int]:
        """Gives events to the concept ``to``: those of the concept ``source``, which loses them, whose summary or evidence has
        the pattern ``match``, and of the one id if it is named. Without ``source`` a pattern is needed, and
        events keep their concepts. An event that ``to`` has already isn't doubled. How many moved, how many
        concepts were replayed and rows read for that; a dry run changes nothing."""
        if not source and not match:
            raise ValueError("name a concept or a pattern")
        n = self.log.last()
        goal, origin = concept_key(to), concept_key(source) if source else None
        at = {c: zlib.crc32(c.encode()) % self.buckets for c in {goal, origin} - {None}}
        rows = self._read("events", [at[origin]] if origin else None)
        if origin:
            rows = rows.where(F.lower("concept") == origin)
        if match:
            rows = rows.where(F.coalesce(F.col("evidence").rlike(match) | F.col("summary").rlike(match), F.lit(False)))
        if event_id:
            rows = rows.where(F.col("event_id") == event_id)
        moving = rows.where(F.lower("concept") != goal) if origin else rows
        moved = moving.select("event_id").distinct().count()
        if dry_run or not moved:
            return {"moved": moved, "replayed": 0, "read": 0}
        touched = sorted(set(at.values()))
        held = self._read("events", touched)
        ids = moving.select("event_id").distinct()
        has = held.where(F.lower("concept") == goal).select("event_id")
        added = moving.dropDuplicates(["event_id"]).join(has, "event_id", "left_anti").withColumn("concept", F.lit(goal)).select(held.columns)
        lost = F.lower("concept") == origin if origin else F.lit(False)
        stay = held.where(~lost).unionByName(held.where(lost).join(ids, "event_id", "left_anti").select(held.columns))
        name = uuid.uuid4().hex
        self._write("events", stay.unionByName(added), name)
        stored = self.spark.read.schema(f"{EVENT_ROW}, bucket int").parquet(f"{self.path}/events/{name}").drop("bucket")
        changed = F.lower("concept").isin([goal, *([origin] if origin else [])])
        mine = stored.where(changed)
        kept = self._read("states", touched).where(~changed)
        self._write("states", kept.unionByName(replay(mine).select("concept", "s", "last_session")), name)
        self.log.publish(n + 1, {"buckets": self.log.read(n)["buckets"] | {str(b): name for b in touched}})
        return {"moved": moved, "replayed": mine.select("concept").distinct().count(), "read": mine.count()}
