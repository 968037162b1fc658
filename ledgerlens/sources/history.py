"""Tables with a history: change detection, validity intervals, reads as of a version,
checkpoints, restore and compaction (S5, S23, L30).

Only rows whose content changed are written, each with the version from which it holds; a
key that is gone gets a row that says so. A version is a record in a commit log, so a save
counts as a whole, and of two writers one fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .commits import CommitLog
from .scratch import fresh


class History:
    """The history of a table with the columns of ``schema`` and one row per ``keys`` under ``path``.
    Columns of ``ignored`` are kept but never make a change."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], ignored: tuple[str, ...] = ("updated_at",)):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.row = StructType([StructField(f.name, f.dataType) for f in schema.fields])
        self.compared = [f.name for f in schema.fields if f.name not in ignored and f.name not in keys]
        self.log = CommitLog(spark, f"{self.path}/commits")
        self.schema = StructType([StructField("_version", LongType()), StructField("_hash", StringType()), StructField("_gone", BooleanType()), *self.row.fields])

    def _record(self, n: int | None = None) -> dict:
        return self.log.read(n) or {"version": 0, "segments": [], "checkpoints": {}, "at": None, "oldest": 1, "kept": []}

    def version(self) -> int:
        """The newest version, or 0."""
        return self._record()["version"]

    def _stored(self, record: dict) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema)
        for s in record["segments"]:
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/segments/{s}"))
        return out

    def _fingerprint(self) -> Column:
        return F.sha2(F.to_json(F.struct(*[F.col(c) for c in self.compared]), {"ignoreNullFields": "false"}), 256) if self.compared else F.lit("")

    def _last(self, rows: DataFrame) -> DataFrame:
        """Each key's newest row. Rows of a key are merged before they are shuffled."""
        rest = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_version").alias("_r")).select(*self.keys, "_r.*")

    def save(self, rows: DataFrame, at: str, whole: bool = True) -> dict[str, int]:
        """Makes rows the next version, at a time given as text that sorts; keys that rows lack go if ``whole``.
        (new, changed, removed) rows; where nothing changed no version is made. Rows with a null
        key or a repeated one are refused."""
        n = self.log.last()
        record = self._record(n)
        version = record["version"] + 1
        heads = self._stored(record).select(*self.keys, "_version", "_hash", "_gone")  # no other column is read
        current = self._last(heads).where("NOT _gone")
        fresh_rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.row.fields]).withColumn("_hash", self._fingerprint())
        bad = fresh_rows.groupBy(*self.keys).agg(F.count("*").alias("_n")).where(F.expr(" OR ".join(["_n > 1", *[f"`{k}` IS NULL" for k in self.keys]])))
        if not bad.isEmpty():
            raise ValueError(f"keys {self.keys} are null or repeat")
        old = current.select(*self.keys, F.col("_hash").alias("_old"))
        moved = fresh_rows.join(old, self.keys, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("_hash")))
        moved = moved.select(F.lit(version).cast("long").alias("_version"), "_hash", F.lit(False).alias("_gone"), *self.row.names, F.col("_old").isNull().alias("_new"))
        if whole:
            lost = current.join(fresh_rows.select(*self.keys), self.keys, "left_anti")
            moved = moved.unionByName(lost.select(F.lit(version).cast("long").alias("_version"), "_hash", F.lit(True).alias("_gone"), *[F.col(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in self.row.fields], F.lit(False).alias("_new")))
        aside = fresh(self.spark, "history")
        moved.write.parquet(aside)
        moved = self.spark.read.parquet(aside)
        c = moved.agg(F.count_if("_new").alias("new"), F.count_if(~F.col("_new") & ~F.col("_gone")).alias("changed"), F.count_if("_gone").alias("removed")).head().asDict()
        if sum(c.values()):
            name = uuid.uuid4().hex
            moved.drop("_new").write.parquet(f"{self.path}/segments/{name}")
            self.log.publish(n + 1, record | {"version": version, "segments": [*record["segments"], name], "at": at, "times": {**record.get("times", {}), str(version): at}})
        return c

    def _readable(self, record: dict, version: int) -> int:
        if not 0 < version <= record["version"] or (version < record["oldest"] and version not in record["kept"]):
            raise KeyError(f"version {version} is not kept")
        return version

    def as_of(self, version: int | None = None, at: str | None = None) -> DataFrame:
        """The table as it was at a version, or at the last one saved up to a time; now if neither is given.
        Raises KeyError for a version that was never there or that compaction has dropped."""
        record = self._record()
        if at is not None:
            version = max((int(v) for v, t in record.get("times", {}).items() if t <= at), default=0)
            if not version:
                return self.spark.createDataFrame([], self.row)
        if version is None and not record["version"]:
            return self.spark.createDataFrame([], self.row)
        version = self._readable(record, record["version"] if version is None else version)
        rows = self._stored(record).where(F.col("_version") <= version)
        return self._last(rows).where("NOT _gone").select(*self.row.names)

    def intervals(self) -> DataFrame:
        """The rows with the versions for which they hold: from valid_from up to, not including, valid_to (null: still)."""
        return self._spans(self._record()).where("NOT _gone").select(*self.row.names, "valid_from", "valid_to")

    def _spans(self, record: dict) -> DataFrame:
        order = Window.partitionBy(*self.keys).orderBy("_version")
        return self._stored(record).withColumn("valid_to", F.lead("_version").over(order)).withColumn("valid_from", F.col("_version"))

    def checkpoint(self, name: str, reason: str = "", most: int = 20) -> None:
        """Names the newest version; of the names the last ``most`` stay."""
        n = self.log.last()
        record = self._record(n)
        named = {k: v for k, v in record["checkpoints"].items() if k != name}
        named[name] = {"version": record["version"], "reason": reason, "order": max([v["order"] for v in named.values()], default=0) + 1}
        kept = sorted(named, key=lambda k: named[k]["order"])[-most:]
        self.log.publish(n + 1, record | {"checkpoints": {k: named[k] for k in kept}})

    def checkpoints(self) -> list[dict]:
        """Names with version and reason, oldest first."""
        named = self._record()["checkpoints"]
        return [{"name": k, "version": v["version"], "reason": v["reason"]} for k, v in sorted(named.items(), key=lambda x: x[1]["order"])]

    def restore(self, name: str, at: str) -> dict[str, int]:
        """Saves the table of a checkpoint as the newest version: what came since stays in the history.
        A part of a name is enough if only one has it; raises KeyError otherwise."""
        named = self._record()["checkpoints"]
        found = [name] if name in named else [k for k in named if name in k]
        if len(found) != 1:
            raise KeyError(name)
        return self.save(self.as_of(named[found[0]]["version"]), at)

    def compact(self, oldest: int) -> None:
        """Merges the segments; versions before ``oldest`` that no checkpoint names can't be read any
        more, and rows that hold for none of the others go."""
        n = self.log.last()
        record = self._record(n)
        oldest = min(max(oldest, record["oldest"]), record["version"])
        kept = sorted({v["version"] for v in record["checkpoints"].values() if 0 < v["version"] < oldest})
        end = F.coalesce("valid_to", F.lit(1 << 62))
        holds = end > oldest
        for v in kept:  # at most the number of checkpoints
            holds = holds | ((F.col("valid_from") <= v) & (end > v))
        name = uuid.uuid4().hex
        self._spans(record).where(holds).select(*self.schema.names).write.parquet(f"{self.path}/segments/{name}")
        self.log.publish(n + 1, record | {"segments": [name], "oldest": oldest, "kept": kept})


def last_items(df: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Lists cut to their last items."""
    return df.withColumns({c: F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), F.lit(n)) for c, n in caps.items()}) if caps else df
