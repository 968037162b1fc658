"""Ledgers as streams (T1 to T7): files that arrive, read once, into append-only tables.

Each stream is checkpointed in shared storage, so a restart neither loses nor repeats events.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A stream over Parquet files of the folder ``path``, or over the one file that it
    names; ts becomes a timestamp with zone."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        folder, _, name = path.rpartition("/")
        raw = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        raw = reader.parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Takes up all that has arrived, and stops."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """As run_once, through a function per micro-batch: for outputs that are updated."""
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deduplicated(events: DataFrame, late: str = "2 days") -> DataFrame:
    """An event_id counts once, as long as repeats come within ``late`` of each other."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a user where no explicit id exists, closed by a gap."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def status_counts(events: DataFrame) -> DataFrame:
    """T4: running confidence and failures of each concept, kept as state by concept: a row
    per concept of each micro-batch. Events of a batch are taken in order of seq."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        conf, fails, n = state.get if state.exists else (1, 0, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for kind in rows["event_type"]:
            n += 1
            if kind == "purchase":
                conf = min(5, conf + 1)
            elif kind == "error":
                conf, fails = max(1, conf - 1), fails + 1
        state.update((int(conf), int(fails), int(n)))
        yield pd.DataFrame({"user_id": [key[0]], "confidence": [conf], "failures": [fails], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(advance, "user_id long, confidence int, failures int, n int", "confidence int, failures int, n int", "update", "NoTimeout")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for one run's output and checkpoint, in the shared folder of the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
