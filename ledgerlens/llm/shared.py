"""Shared scratch tables and batch helpers.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` (a folder that
the driver and all executors share), never by a local checkpoint, so a lost
executor costs the recomputation of its own tasks only.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

T = TypeVar("T")
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` if the session names one. Where it is unset (tests)
    and the master is local, a temporary folder; on a cluster it must be set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own_dir
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df to a fresh scratch table and reads it back. Hashes gain nothing from compression."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a scratch table that no later plan reads."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_sample(df: DataFrame, key: str, rows: int, text: str | None = None, longest: int = 1 << 18, chars: int = 1 << 26) -> list[Row]:
    """At most ``rows`` rows of df, those of the least hashes of key, the same at every run.

    The rows are counted first, so that tasks sort only about as many as are kept; where few
    keys repeat often the share that is looked at grows until there are enough. Of rows with a
    column ``text`` only those of at most ``longest`` characters count, and as many of them as
    ``chars`` characters hold, so the driver gets a bounded number of rows and bytes.
    """
    if text:
        df = df.where(F.length(text) <= longest)
    h, rest = F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("_h"), F.xxhash64(*df.columns)
    n = df.count()
    share = 1 << 30 if n <= rows else int((rows + 3 * rows**0.5) / n * (1 << 30))
    while True:
        first = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share).withColumns({"_h": h, "_r": rest}).orderBy("_h", "_r").limit(rows)
        if text:
            upto = Window.orderBy("_h", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            first = first.withColumn("_sum", F.sum(F.length(text)).over(upto)).where(F.col("_sum") <= chars)
        found = first.collect()
        full = text and found and max(r["_sum"] for r in found) + longest > chars
        if len(found) >= min(rows, n) or full or share >= 1 << 30:
            break
        share = min(1 << 30, 4 * share + 1)
    return sorted(found, key=lambda r: tuple(str(x).rjust(24) for x in (r["_h"], r[key])))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Python workers get batches of at most ``rows`` rows from now on, since texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


_state: dict = {}


def worker_state(key, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task, such as a model with its memo. It keeps
    one thing: that of another operator or model goes when this one comes."""
    if key not in _state:
        _state.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # not every C library can
            ctypes.CDLL(None).malloc_trim(0)
        _state[key] = make()
    return _state[key]


def by_bytes(texts: list, budget: int) -> Iterator[slice]:
    """Slices of a batch that hold about ``budget`` characters, one row at least."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= budget:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def with_columns(batch: pa.RecordBatch, rows: slice, keep: Iterable[str], **new: pa.Array) -> pa.RecordBatch:
    """Rows of a batch with the columns ``keep`` as they are, nulls and whole numbers too, and new ones."""
    part = batch.slice(rows.start, rows.stop - rows.start)
    return pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *new.values()], names=[*keep, *new])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
