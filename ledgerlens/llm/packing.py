"""Best-two-fit packing of documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import by_bytes, materialize, small_batches, with_columns
from .wordbpe import word_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def plan_bins(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """Best-two-fit over a histogram: counts[n] pieces have length n, of 1 to len - 1 = capacity.

    A bin is filled greedily with the largest piece that fits; then its smallest piece
    gives way to the two unpacked pieces that fill the expanded gap best, as long as that
    fills more. The same bin is taken as often as the counts allow, so the work depends
    on the capacity alone: a bin stops being taken when some length has fewer pieces left
    than the bin uses. Returns (times, lengths in the bin), at most about
    capacity * ln(capacity) entries.
    """
    capacity, left = len(counts) - 1, counts.astype(np.int64).copy()
    bins: list[tuple[int, list[int]]] = []
    lengths = np.arange(capacity + 1)

    def below(free: np.ndarray) -> np.ndarray:
        """For each n, the largest free length up to n (0: none)."""
        return np.maximum.accumulate(np.where(free > 0, lengths, 0))

    while left.any():
        free, fill, gap = left.copy(), [], capacity
        at = below(free)
        while gap and (n := int(at[gap])):
            take = min(gap // n, int(free[n]))
            fill += [n] * take
            free[n] -= take
            gap -= n * take
            if not free[n]:
                at = below(free)
        while gap:
            least, room = fill[-1], gap + fill[-1]
            at = below(free)
            a = np.flatnonzero(free[: room + 1] > 0)
            if not len(a):
                break
            b = at[np.minimum(room - a, a)]
            same = (b == a) & (free[a] < 2)
            b[same] = at[a[same] - 1]
            total = np.where(b > 0, a + b, 0)
            k = int(total.argmax())
            if total[k] <= least:
                break
            free[a[k]] -= 1
            free[b[k]] -= 1
            free[least] += 1
            fill[-1:] = [int(a[k]), int(b[k])]
            fill.sort(reverse=True)
            gap = room - int(total[k])
        use = np.bincount(fill, minlength=capacity + 1)
        times = int((left[use > 0] // use[use > 0]).min())
        left -= times * use
        bins.append((times, fill))
    return bins


def slot_table(bins: list[tuple[int, list[int]]], capacity: int) -> tuple[np.ndarray, ...]:
    """Where the nth piece of a length goes: rows (length, first nth, bin, times, uses, offset of the first use), ordered."""
    seen = np.zeros(capacity + 1, np.int64)
    rows, first = [], 0
    for times, fill in bins:
        offset = 0
        for n in dict.fromkeys(fill):
            uses = fill.count(n)
            rows.append((n, seen[n], first, times, uses, offset))
            seen[n] += times * uses
            offset += n * uses
        first += times
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 6).T)


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of every document: its ids, then end_id, cut only beyond capacity.
    ``nth`` numbers the pieces of one length within ``part``, a task of the scan."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, end = word_encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        step = 4 * capacity
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = []
            for s in by_bytes(texts, 1 << 20):
                for doc, data in zip(ids[s], encoder.encode([t or "" for t in texts[s]]), strict=True):
                    data += end
                    for piece, at in enumerate(range(0, len(data), step)):
                        own = data[at : at + step]
                        n = len(own) // 4
                        rows.append((doc, piece, at // 4, n, zlib.crc32(own), part, seen[n]))
                        seen[n] += 1
            if rows:
                kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int32(), "nth": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty (one piece that holds end_id alone); rows that repeat a
    doc_id, or have none, are packed each; very long texts are cut to pieces of the capacity; other columns are ignored; an empty table gives no rows.
    Bins depend on the lengths only, so the driver plans them from the number of pieces
    of each length, at most ``capacity`` rows whatever the input. A piece finds its place
    by its number among the pieces of its length: its number within its task plus the
    pieces of that length in the tasks before, so no task holds all pieces of a length.
    """
    small_batches(docs.sparkSession)
    pieces = materialize(tokenised_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in per_part.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    table = slot_table(plan_bins(histogram), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = pieces.join(starts, ["part", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, begin, first, _, uses, offset = table
        edges = np.searchsorted(n, np.arange(capacity + 2))
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("nth").to_numpy() + b.column("before").to_numpy()
            at = np.zeros(b.num_rows, np.int64)
            for own in np.unique(length):
                rows, lo, hi = length == own, edges[own], edges[own + 1]
                at[rows] = lo + np.searchsorted(begin[lo:hi], rank[rows], "right") - 1
            k = rank - begin[at]
            yield with_columns(b, slice(0, b.num_rows), ("doc_id", "piece", "start", "length", "ids_crc32"), sequence_id=pa.array(first[at] + k // uses[at]), offset=pa.array(offset[at] + k % uses[at] * length))

    return placed.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
