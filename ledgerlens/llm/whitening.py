"""Whitening of embeddings from an exact scatter matrix in residue numbers.

Entries become longs x, and y = n x - S (n vectors, sums S) are centred without rounding.
Each partition multiplies the residues of its y by several primes: products of blocks of rows
stay below 2**53, so double-precision matrix products are exact. Spark adds them up by prime
and cell, and the Chinese remainder theorem gives sum(y y') as whole numbers, whatever the
order of additions. Divided by n**3 that is the covariance, each cell rounded once; its
eigenvectors are found in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

BITS = 21  # residues lie within 2**20 of zero, their products within 2**40
BLOCK = 1 << 12  # rows of a product: sums within 2**52
SCALE, SHIFT = 64, 1_000_000
SATURATED = 2.0**61
NO_VARIANCE = 1e-11  # of the largest eigenvalue
OUT_ROWS = 2048


def primes(product: int) -> list[int]:
    """The largest primes below 2**BITS, as many as make more than ``product`` together."""
    found, have, p = [], 1, (1 << BITS) - 1
    while have <= product:
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            have *= p
        p -= 2
    return found


def complete(vector: str) -> Column:
    """Not null, and without null or non-finite entries."""
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def longs(column: pa.Array, d: int) -> np.ndarray:
    """x of a column of lists of d numbers."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.clip(np.floor(SCALE * c), -SATURATED, SATURATED).astype(np.int64) + SHIFT


def wrapped(x: int) -> int:
    """x modulo 2**64, as a signed long."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


@dataclass(frozen=True)
class Whitening:
    """n vectors of d dimensions with sums S; unit eigenvectors (columns) and eigenvalues of
    their covariance, in falling order; its trace; a bound of |n x - S|."""

    n: int
    d: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    reach: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S without rounding: in longs, where wrapping cancels out, if it fits."""
        if self.reach < 1 << 62:
            return np.int64(wrapped(self.n)) * x - np.array([wrapped(s) for s in self.sums], np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whiten(self, y: np.ndarray, k: int) -> np.ndarray:
        """The first k components of centred rows. One without variance is 0."""
        e = self.values[:k]
        live = e > NO_VARIANCE * max(self.values[0], 0.0)
        scale = np.where(live, 1 / np.sqrt(np.where(live, e, 1.0)), 0.0)
        return ((y / self.n).astype(np.float64) @ self.vectors[:, :k]) * scale

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sums of squares of centred rows; None for what no long holds."""
        if self.d * self.reach**2 < 1 << 63:
            return (y * y).sum(1).tolist()
        sums = (y.astype(object) ** 2).sum(1)
        return [int(s) if s < 1 << 63 else None for s in sums]


def fit_list(vectors: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The complete vectors of the most frequent length (the shorter of two), and that length."""
    good = vectors.where(complete(vector))
    most = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").head()
    d = most["d"] if most else 0
    return good.where(F.size(vector) == d), d


def _sums(good: DataFrame, vector: str, d: int) -> tuple[int, list[int], int]:
    """n, the exact sums, and the widest range of a dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low, least, most = 0, np.zeros(d, np.int64), np.zeros(d, np.int64), None, None
        for b in batches:
            x = longs(b.column(0), d)
            if len(x):
                n += len(x)
                high += (x >> 31).sum(0)
                low += (x & ((1 << 31) - 1)).sum(0)
                least = x.min(0) if least is None else np.minimum(least, x.min(0))
                most = x.max(0) if most is None else np.maximum(most, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.arange(d), np.full(d, n), high, low, least, most)], names=["i", "n", "high", "low", "least", "most"])

    rows = good.select(vector).mapInArrow(part, "i long, n long, high long, low long, least long, most long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    found = rows.groupBy("i").agg(F.sum("n").alias("n"), *exact, F.min("least").alias("least"), F.max("most").alias("most")).orderBy("i").collect()
    return found[0]["n"], [int(r["high"]) * (1 << 31) + int(r["low"]) for r in found], max(r["most"] - r["least"] for r in found)


def scatter(good: DataFrame, vector: str, d: int, n: int, sums: list[int], reach: int) -> np.ndarray:
    """sum(y y') over all rows as a d by d array of Python's whole numbers. The driver gets a
    number per prime and cell of the upper triangle."""
    ps = primes(2 * n * reach * reach + 1)
    offsets = np.array([[s % p for s in sums] for p in ps], np.int64)
    upper = np.triu_indices(d)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((len(ps), d, d), np.int64), False
        for b in batches:
            x = longs(b.column(0), d)
            for at in range(0, len(x), BLOCK):
                any_rows = True
                for k, p in enumerate(ps):
                    y = (n % p * (x[at : at + BLOCK] % p) - offsets[k]) % p
                    y = (y - p * (y > p // 2)).astype(np.float64)
                    total[k] = (total[k] + (y.T @ y).astype(np.int64)) % p
        if any_rows:
            for k in range(len(ps)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), k)), pa.array(upper[0]), pa.array(upper[1]), pa.array(total[k][upper])], names=["k", "i", "j", "v"])

    cells = good.select(vector).mapInArrow(part, "k long, i long, j long, v long").groupBy("k", "i", "j").agg(F.sum("v").alias("v"))
    found = cells.toArrow()
    k, i, j, v = (found.column(c).to_numpy() for c in ("k", "i", "j", "v"))
    product = math.prod(ps)
    out = np.zeros((d, d), object)
    for at, p in enumerate(ps):
        rest, mine = product // p, k == at
        residues = np.zeros((d, d), object)
        residues[i[mine], j[mine]] = (v[mine] % p).astype(object)
        out += residues * (rest * pow(rest, -1, p))
    out %= product
    out = np.where(out > product // 2, out - product, out)
    return np.triu(out) + np.triu(out, 1).T


def fit(good: DataFrame, d: int, vector: str = "embedding") -> Whitening:
    """The whitening of vectors of length d, none of them incomplete. The driver holds
    matrices of the square of the dimension and no rows: some thousand dimensions at most."""
    n, sums, width = _sums(good, vector, d)
    reach = max(1, n * width)
    s = scatter(good, vector, d, n, sums, reach)
    v = np.array([[int(c) / n**3 for c in row] for row in s], np.float64)
    values, found = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    found = found[:, order]
    found *= np.sign(found[np.abs(found).argmax(0), np.arange(d)])
    return Whitening(n, d, tuple(sums), found, values[order], int(np.trace(s)) / n**3, reach)


def identity_error(good: DataFrame, vector: str, model: Whitening, k: int) -> float:
    """The largest entry of the covariance of the whitened rows minus the identity, over the
    components with variance. Rows are centred exactly before they are projected."""
    d = model.d
    rows_at, cols_at = np.triu_indices(k)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            x = longs(b.column(0), d)
            for at in range(0, len(x), BLOCK):
                z = model.whiten(model.centred(x[at : at + BLOCK]), k)
                products += z.T @ z
                sums += z.sum(0)
        cells = [np.concatenate([rows_at, np.arange(k)]), np.concatenate([cols_at, np.full(k, -1)]), np.concatenate([products[rows_at, cols_at], sums])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["i", "j", "v"])

    found = good.select(vector).mapInArrow(part, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (found.column(c).to_numpy() for c in ("i", "j", "v"))
    mean, products = np.zeros(k), np.zeros((k, k))
    mean[i[j < 0]] = v[j < 0] / model.n
    products[i[j >= 0], j[j >= 0]] = v[j >= 0] / model.n
    live = model.values[:k] > NO_VARIANCE * max(model.values[0], 0.0)
    off = np.abs(products - np.triu(np.outer(mean, mean)) - np.eye(k))[np.ix_(live, live)]
    return float(off.max()) if off.size else 0.0


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per vector and component: id, component (from 1), n, deviation, whitened,
    explained, identity_error.

    Vectors that are null or hold a null, NaN or infinite entry take no part, nor do those of
    another length than most have, and none if most are empty. Entries beyond 2**55 count as
    that. Repeated rows and ids, and null ids, give their rows each; other columns are ignored. Where fewer dimensions than
    ``components`` exist, each is given. A component without variance (a share of 1e-11 of the
    first at most) is whitened to 0 and takes no part in identity_error. A deviation that no
    long holds is null. Eigenvectors have their largest entry positive. An empty table gives none.
    """
    good, d = fit_list(vectors, vector)
    fields = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    key = StructField(id_col, vectors.schema[id_col].dataType if id_col in vectors.columns else LongType())
    schema = StructType([key, *StructType.fromDDL(fields).fields])
    if not d:
        return vectors.sparkSession.createDataFrame([], schema)
    model = fit(good, d, vector)
    k = min(components, d)
    error = identity_error(good, vector, model, k)
    explained = model.values[:k] / model.trace if model.trace > 0 else np.zeros(k)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(at, OUT_ROWS)
                y = model.centred(longs(part.column(1), d))
                m = len(y)
                each = pa.array(np.repeat(np.arange(m), k))
                deviation = pa.array(model.deviations(y), pa.int64())
                columns = [
                    part.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    deviation.take(each),
                    pa.array(model.whiten(y, k).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return good.select(id_col, vector).mapInArrow(rows, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings, by 32 components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
