"""Vectors of chunks as a second phase after the text index.

Vectors are stored by content hash, model and dimension, so a chunk whose text was embedded
before, or that another chunk has too, costs nothing. A generation is staged whole, checked by
aggregates, and counts only once its record is published; readers never see another one.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import CommitLog
from .scratch import delete

SCHEMA = "chunk_id string, source string, content_hash string, model string, dimension int, vector array<double>"
Embedder = Callable[[list[str]], list]


class Incomplete(RuntimeError):
    """A staged generation that lacks something."""


class VectorStore:
    """Vectors of ``model`` with ``dimension`` entries under ``path``. ``embed`` makes vectors of texts, in
    tasks, for bounded batches of distinct texts."""

    def __init__(self, spark: SparkSession, path: str, model: str, dimension: int, embed: Embedder):
        self.spark, self.path, self.model, self.dimension, self.embed = spark, path.rstrip("/"), model, dimension, embed
        self.log = CommitLog(spark, f"{self.path}/commits")

    def record(self) -> dict | None:
        return self.log.read()

    def mode(self) -> str:
        """Hybrid if the published generation is of this model and dimension, bm25 otherwise."""
        r = self.record()
        return "hybrid" if r and (r["model"], r["dimension"]) == (self.model, self.dimension) else "bm25"

    def current(self) -> DataFrame:
        """The published vectors; none if they are of another model or dimension."""
        if self.mode() == "bm25":
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/generations/{self.record()['generation']}")

    def _hashed(self, chunks: DataFrame) -> DataFrame:
        return chunks.select("chunk_id", "source", F.sha2(F.coalesce("document", F.lit("")), 256).alias("content_hash"), F.coalesce("document", F.lit("")).alias("document"))

    def stage(self, chunks: DataFrame) -> str:
        """Writes a generation for chunks (chunk_id, source, document): vectors of known texts are taken over,
        each other distinct text is embedded once. Returns its name; nothing counts yet. Only texts that aren't
        known meet their like; rows, known vectors and new ones then meet by content hash, each shuffled once."""
        rows = self._hashed(chunks)
        embed, texts, known = self.embed, rows.select("content_hash", "document"), None
        if self.mode() != "bm25":
            current = self.current()
            texts = texts.join(current.select("content_hash"), "content_hash", "left_anti")
            known = current.groupBy("content_hash").agg(F.first("vector").alias("_known"))

        @F.pandas_udf("array<double>")
        def vectors(documents: pd.Series) -> pd.Series:
            return pd.Series(list(embed(documents.tolist())))

        fresh = texts.dropDuplicates(["content_hash"]).select("content_hash", vectors("document").alias("vector"))
        name = uuid.uuid4().hex
        staged = rows.drop("document").join(fresh, "content_hash", "left")
        if known is not None:
            staged = staged.join(known, "content_hash", "left").withColumn("vector", F.coalesce("_known", "vector"))
        staged = staged.select("chunk_id", "source", "content_hash", F.lit(self.model).alias("model"), F.lit(self.dimension).alias("dimension"), "vector")
        staged.write.parquet(f"{self.path}/generations/{name}")
        return name

    def problems(self, name: str, chunks: DataFrame) -> dict[str, int]:
        """How many vectors of a staged generation are missing, of a chunk or text that isn't
        there, repeated, of a wrong dimension, or not finite: one pass over ids and one over vectors."""
        staged = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/generations/{name}")
        finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        of = staged.agg(
            F.count_if(F.coalesce((F.size("vector") != self.dimension) | (F.col("dimension") != self.dimension) | (F.col("model") != self.model), F.lit(True))).alias("wrong_dimension"),
            F.count_if(~F.coalesce(finite, F.lit(False))).alias("not_finite"),
        ).head()
        want = self._hashed(chunks).groupBy("chunk_id", "content_hash").agg(F.count("*").alias("want"))
        have = staged.groupBy("chunk_id", "content_hash").agg(F.count("*").alias("have"))
        w, h = F.coalesce("want", F.lit(0)), F.coalesce("have", F.lit(0))
        met = want.join(have, ["chunk_id", "content_hash"], "full").agg(F.count_if(h < w).alias("missing"), F.count_if(w == 0).alias("surplus"), F.count_if((w > 0) & (h > w)).alias("repeated")).head()
        return of.asDict() | met.asDict()

    def publish(self, name: str, chunks: DataFrame) -> dict:
        """Makes a staged generation the one that counts; raises Incomplete, and changes nothing, if it is
        not whole. Returns its record."""
        n = self.log.last()
        found = {k: v for k, v in self.problems(name, chunks).items() if v}
        if found:
            raise Incomplete(f"generation {name}: {found}")
        size = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/generations/{name}").count()
        record = {"generation": name, "model": self.model, "dimension": self.dimension, "chunks": size, "status": "complete"}
        self.log.publish(n + 1, record)
        return record

    def refresh(self, chunks: DataFrame) -> dict:
        """Stages and publishes; what was staged goes if it can't be published. The earlier one still counts then."""
        name = self.stage(chunks)
        try:
            return self.publish(name, chunks)
        except Exception:
            delete(self.spark, f"{self.path}/generations/{name}")
            raise


def slot_embedder(dimension: int = 256, synonyms: dict[str, str] | None = None) -> Embedder:
    """A deterministic embedder for tests and offline use: unit vectors in whose slots words count twice
    and their synonyms thrice, by the SHA-256 of the word, with a little noise by that of the text."""
    other = synonyms or {}

    def embed(texts: list[str]) -> list[np.ndarray]:
        slots: dict[str, int] = {}

        def slot(word: str) -> int:
            if word not in slots:
                slots[word] = int.from_bytes(hashlib.sha256(word.encode()).digest()[:4], "big") % dimension
            return slots[word]

        out = []
        for text in texts:
            v = np.zeros(dimension)
            for token in re.findall(r"[A-Za-z0-9]+", text):
                for part in re.sub(r"(?<!^)(?=[A-Z])", " ", token).lower().split():
                    v[slot(part)] += 2.0
                    v[slot(other.get(part, part))] += 3.0
            for byte in hashlib.sha256(text.encode()).digest()[:4]:
                v[byte % dimension] += 0.03
            out.append(v / (np.sqrt((v * v).sum()) or 1.0))
        return out

    return embed
