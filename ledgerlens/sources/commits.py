"""A log of commits in shared storage: what makes several written tables count at once.

Writers put their tables under names of their own and then publish a record that names them.
A record's file is complete before it gets its number, and a number is given once: of two
writers that saw the same last record, the second one fails and nothing of it counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from .scratch import delete, exists, file_system


class Conflict(RuntimeError):
    """Another writer has published the number meanwhile."""


class CommitLog:
    """Records (small dictionaries) numbered from 1 under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, n: int) -> str:
        return f"{self.path}/{n:010d}.json"

    def numbers(self) -> list[int]:
        fs, at = file_system(self.spark, self.path)
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def last(self) -> int:
        """The highest number, or 0."""
        return max(self.numbers(), default=0)

    def read(self, n: int | None = None) -> dict | None:
        """A record, the last if no number is given; None if there is none."""
        n = self.last() if n is None else n
        if not n or not exists(self.spark, self._file(n)):
            return None
        fs, at = file_system(self.spark, self._file(n))
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, n: int, record: dict) -> None:
        """Gives the number n to the record; raises Conflict if it is taken."""
        jvm = self.spark._jvm
        aside = f"{self.path}/_{n}-{uuid.uuid4().hex}"
        fs, at = file_system(self.spark, aside)
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(at, jvm.org.apache.hadoop.fs.Path(self._file(n)), no_overwrite)
        except Exception as e:
            delete(self.spark, aside)
            if exists(self.spark, self._file(n)):
                raise Conflict(f"{self.path}: {n} is taken") from e
            raise
