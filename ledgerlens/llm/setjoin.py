"""Exact joins of shingle sets by Jaccard similarity, at the scale of a corpus.

A unit is a document or a line; its set holds the distinct shingles of K words, each a
64-bit value, and units with equal sets form a class, named by a 64-bit value of its set.
Two classes link when 4 * overlap >= 3 * union. Everything below runs on classes:

1. ``scan`` writes for each unit its class, size and the smallest values of its set. Two
   linked sets of n and m share at least ``common(n), common(m)``, the lesser, among these.
2. ``classes`` counts for each class how many of those no other class has; a class that
   is left with too few can link with none. Most of a corpus ends here.
3. ``full_sets`` reads the whole sets of what is left, once for each class.
4. ``pivot_links`` brings classes with equal minima of hashes to the earliest of them and
   verifies that pair: a group of near copies takes links in proportion to its size.
5. The callers find the links that are still missing by prefix, length and positional
   filters over an order by rarity, and verify each candidate's overlap.

The order by rarity comes from counts of all shingles left, in a table of fixed size
(several shingles may share a count). Any fixed order gives the same links; a good one
keeps passages that many units share out of the prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from .shared import drop_table, materialize, mix, small_batches, worker_state

K = 5
SLOTS = 1 << 18
U = np.uint64
_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # letters A-Z in lower case
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x5851F42D4C957F2D
_BLOCK = 1 << 20  # bytes that are hashed at a time: what the tables below hold, however long a text is
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _powers:
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(_BLOCK + 1, U(b))
            t[0] = U(1)
            _powers.append(np.multiply.accumulate(t))
    return _powers


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of the words data[begin[i]:end[i]], in ascending order of place: by blocks of whole words, and
    a word that is longer than a block by parts."""
    up, down = _power_tables()
    out = np.empty(len(begin), U)
    i = 0
    while i < len(begin):
        base = begin[i]
        j = int(np.searchsorted(end, base + _BLOCK, "right"))
        if j > i:
            part = data[base : end[j - 1]]
            sums = np.zeros(len(part) + 1, U)
            np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
            out[i:j] = (sums[end[i:j] - base] - sums[begin[i:j] - base]) * down[begin[i:j] - base]
        else:
            j, total, scale = i + 1, 0, 1
            for c in range(base, end[i], _BLOCK):
                part = data[c : min(c + _BLOCK, end[i])]
                total += int((_BYTE[part] * up[: len(part)]).sum()) * scale
                scale = scale * int(up[_BLOCK]) % (1 << 64)
            out[i] = U(total % (1 << 64))
        i = j
    return mix(out)


def shingle_sets(data: np.ndarray, edges: np.ndarray, lines: bool, words_least: int = 0) -> tuple[np.ndarray, ...]:
    """The sets of the documents data[edges[i]:edges[i + 1]] (UTF-8 bytes), or of their lines.

    Returns (document, line, size of the set) of each unit with words (at least
    ``words_least``), and all sets in a row, each in ascending order. Words are runs of
    bytes other than white space; a unit of fewer than K words has its whole sequence as one
    shingle.
    """
    none = np.zeros(0, np.int64)
    n = len(data)
    if n == 0:
        return none, none, none, np.zeros(0, U)
    word = ~_BLANK[data]
    fence = np.zeros(n + 1, bool)  # a document begins here
    fence[edges] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | fence[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | fence[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(begin):
        return none, none, none, np.zeros(0, U)
    w = word_hashes(data, begin, end)
    doc = np.searchsorted(edges, begin, "right") - 1
    if lines:
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        line = breaks[begin] - breaks[edges[doc]]
        new = np.ones(len(w), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
    else:
        line = None
        new = np.ones(len(w), bool)
        new[1:] = doc[1:] != doc[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(w)))
    keep = count >= max(words_least, 1)
    unit = np.cumsum(new) - 1
    h = np.zeros(0, U)
    owner = none
    if len(w) >= K:
        whole = (unit[: len(w) - K + 1] == unit[K - 1 :]) & keep[unit[: len(w) - K + 1]]
        at = np.flatnonzero(whole)
        h = w[at]
        for k in range(1, K):
            h = h * U(0x9E3779B97F4A7C15) + w[at + k]
            h ^= h >> U(29)
        h, owner = mix(h), unit[at]
    short = np.flatnonzero((count < K) & keep)
    if len(short):
        s = mix(count[short].astype(U) + U(77))
        for k in range(K - 1):
            live = count[short] > k
            s = np.where(live, mix(s * U(0xD1342543DE82EF95) + w[np.minimum(start[short] + k, len(w) - 1)]), s)
        h, owner = np.concatenate([h, s]), np.concatenate([owner, short])
    if len(start) == 1:
        h = np.unique(h)
        return doc[start[keep]], (line[start[keep]] if lines else np.zeros(int(keep.sum()), np.int64)), np.full(int(keep.sum()), len(h)), h
    order = np.argsort(h)
    owner = owner[order]
    again = np.argsort(owner.astype(np.uint16) if len(start) < 1 << 16 else owner, kind="stable")
    h, owner = h[order][again], owner[again]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[fresh], owner[fresh]
    size = np.bincount(owner, minlength=len(start))
    kept = np.flatnonzero(keep)
    return doc[start[kept]], (line[start[kept]] if lines else np.zeros(len(kept), np.int64)), size[kept], h


def class_ids(size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The name of each set: a hash of its members and size."""
    if not len(size):
        return np.zeros(0, np.int64)
    starts = np.cumsum(size) - size
    total = np.add.reduceat(mix(h ^ U(0xA0761D6478BD642F)), starts)
    return mix(total + size.astype(U) * U(0xE7037ED1A0B428DB)).view(np.int64)


def text_slices(batch: pa.RecordBatch, column: str, budget: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, edges) of parts of a batch; null texts are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + budget, "right")) - 1)
        to = min(to, len(col))
        yield at, to, raw[edges[at] : edges[to]], edges[at : to + 1] - edges[at]
        at = to


def needed(n):
    """The least overlap of a set of n with one that it links with."""
    return (3 * n + 3) // 4


def common(n, slack: int):
    return 1 + slack * n // 20


def prefix_size(n, slack: int):
    return n - needed(n) + common(n, slack)


def _ragged(size: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given sizes."""
    starts = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(starts, size)


def scan(docs: DataFrame, lines: bool, slack: int, words_least: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes (id, line, cid, n, prefix array<long>) for every unit with words."""
    kind = docs.schema[id_col].dataType
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("shingles", dict)  # makes room
        for batch in batches:
            ids = batch.column(0)
            for a, z, data, edges in text_slices(batch, "_text"):
                doc, line, n, h = shingle_sets(data, edges, lines, words_least)
                cid, rank = class_ids(n, h), _ragged(n)
                p = prefix_size(n, slack)
                values = h[rank < np.repeat(p, n)].view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(p)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a).take(pa.array(doc)), pa.array(line.astype(np.int32)), pa.array(cid), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "line", "cid", "n", "prefix"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))
    return materialize(rows.mapInArrow(run, f"id {kind.simpleString()}, line int, cid long, n int, prefix array<long>"), "units", "none")


class Places:
    """One value that orders the units of a table by id and line. Integral ids that leave room
    for the line numbers make a long of both, others a decimal, ids of other types a struct."""

    def __init__(self, units: DataFrame):
        self.kind, self.bits = units.schema["id"].dataType, None
        if isinstance(self.kind, IntegralType):
            least, most, line = units.agg(F.min("id"), F.max("id"), F.max("line")).head()
            bits = int(line or 0).bit_length()
            if (least or 0) >= 0 and int(most or 0).bit_length() + bits < 63:
                self.bits = bits

    def of(self) -> Column:
        """The place of a row with id and line."""
        if self.bits is not None:
            return F.shiftleft(F.col("id").cast("long"), self.bits) + F.col("line")
        if isinstance(self.kind, IntegralType):
            return F.col("id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line").cast("decimal(10,0)")
        return F.struct("id", "line")

    def back(self, pos: Column) -> list[Column]:
        """The id and line of a place."""
        if self.bits is not None:
            return [F.shiftright(pos, self.bits).cast(self.kind).alias("id"), pos.bitwiseAND(F.lit((1 << self.bits) - 1).cast("long")).cast("int").alias("line")]
        if isinstance(self.kind, IntegralType):
            id_ = F.floor(pos / F.lit(1 << 31).cast("decimal(10,0)"))
            line = pos - id_.cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)")
            return [id_.cast(self.kind).alias("id"), line.cast("int").alias("line")]
        return [pos["id"].alias("id"), pos["line"].alias("line")]


def classes(units: DataFrame, places: Places, slack: int) -> DataFrame:
    """(cid, n, pos, c, open, id, line) of the classes that several units have or that may link
    with another (open); pos is the place where the class stands first. Counting is by partial
    sums: no task holds a shingle's units."""
    shingles = units.select("cid", F.explode("prefix").alias("s"))
    lone = shingles.groupBy("s").agg(F.min("cid").alias("cid"), F.max("cid").alias("_other")).where("cid = _other")
    lone = lone.groupBy("cid").agg(F.count("*").alias("lone"))
    found = units.groupBy("cid").agg(F.first("n").alias("n"), F.min(places.of()).alias("pos"), F.count("*").alias("c"))
    n = F.col("n")
    need = F.floor((3 * n + 3) / 4)
    prefix = n - need + 1 + F.floor(n * slack / 20)
    least = 1 + F.floor(need * slack / 20)
    found = found.join(lone, "cid", "left").withColumn("open", prefix - F.coalesce("lone", F.lit(0)) >= least)
    return materialize(found.where("open OR c > 1").select("cid", "n", "pos", "c", "open", *places.back(F.col("pos"))), "classes")


def full_sets(docs: DataFrame, left: DataFrame, lines: bool, words_least: int = 0, broadcast_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes (cid, n, pos, tokens array<long>) of the classes left, from the text where each
    stands first (twice if rows repeat an id); of a text only the lines asked for are read.
    Their list is broadcast only if it has at most ``broadcast_rows`` rows of three numbers."""
    want = left.groupBy("id").agg(F.collect_list(F.struct("cid", "line", "pos")).alias("want"))
    if left.count() <= broadcast_rows:
        want = F.broadcast(want)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text")).join(want, "id").select("want", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("shingles", dict)
        for batch in batches:
            wanted = batch.column(0)
            for a, z, data, edges in text_slices(batch, "_text"):
                asked = wanted.slice(a, z - a)
                flat = asked.flatten()
                owner = np.repeat(np.arange(z - a), np.diff(asked.offsets.to_numpy()))
                begin, end = edges[owner], edges[owner + 1]
                if lines:
                    breaks = np.flatnonzero(data == 10)
                    at = np.searchsorted(breaks, begin) + flat.field(1).to_numpy()
                    bounds = np.concatenate([[-1], breaks, [len(data)]])
                    begin, end = np.maximum(begin, bounds[np.minimum(at, len(breaks))] + 1), np.minimum(end, bounds[np.minimum(at, len(breaks)) + 1])
                size = np.maximum(end - begin, 0)
                part = data[np.repeat(begin, size) + _ragged(size)]
                unit, _, n, h = shingle_sets(part, np.concatenate([[0], np.cumsum(size)]), False, words_least)
                cid = class_ids(n, h)
                ok = cid == flat.field(0).to_numpy()[unit]  # rows that repeat an id may have other texts
                starts = np.concatenate([[0], np.cumsum(n[ok])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cid[ok]), pa.array(n[ok].astype(np.int32)), flat.field(2).take(pa.array(unit[ok])), pa.ListArray.from_arrays(pa.array(starts), pa.array(h[np.repeat(ok, n)].view(np.int64)))], ["cid", "n", "pos", "tokens"])

    kind = left.schema["pos"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"cid long, n int, pos {kind}, tokens array<long>"), "sets", "none")


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cid, size and all tokens of a batch of sets."""
    tokens = batch.column(batch.schema.get_field_index("tokens"))
    n = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
    return batch.column(batch.schema.get_field_index("cid")).to_numpy(), n, tokens.flatten().to_numpy().view(U)


def pivot_links(sets: DataFrame, keys: int = 4, rows: int = 3) -> DataFrame:
    """Links of classes with the earliest class that shares one of ``keys`` keys, each made of
    the least hashes in ``rows`` parts of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = keys * rows
        for batch in batches:
            cid, n, h = _columns(batch)
            least = np.full(len(cid) * bins, ~U(0))
            g = mix(h + U(0x51ED270B7F3A5C21))
            np.minimum.at(least, np.repeat(np.arange(len(cid)), n) * bins + (g % U(bins)).astype(np.int64), g)
            least = least.reshape(len(cid), keys, rows)
            key = np.broadcast_to(np.arange(keys, dtype=U), (len(cid), keys)).copy()
            for k in range(rows):
                key = mix(key * U(0x9E3779B97F4A7C15) + least[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cid, keys)), pa.array(key.view(np.int64).ravel())], ["cid", "key"])

    found = sets.select("cid", "tokens").mapInArrow(run, "cid long, key long")
    found = materialize(found.join(sets.select("cid", "n", "pos"), "cid"), "keys")
    pivots = found.groupBy("key").agg(F.min(F.struct("pos", "cid", "n")).alias("p"), F.count("*").alias("size")).where("size > 1")
    pairs = found.join(pivots, "key").where("cid != p.cid and 4 * least(n, p.n) >= 3 * greatest(n, p.n)")
    return verify(pairs.select(F.col("cid").alias("a"), F.col("p.cid").alias("b")).distinct(), sets)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets link, written out."""
    one = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("y"))
    rows = pairs.join(one, "a").join(two, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            xs, ys = x.offsets.to_numpy(), y.offsets.to_numpy()
            xv, yv = x.values.to_numpy(), y.values.to_numpy()
            ok = []
            for i in range(batch.num_rows):
                p, q = xv[xs[i] : xs[i + 1]].view(U), yv[ys[i] : ys[i + 1]].view(U)
                both = np.concatenate([p, q])
                both.sort()
                overlap = int((both[1:] == both[:-1]).sum())
                ok.append(4 * overlap >= 3 * (len(both) - overlap))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return materialize(rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def rarity(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each of SLOTS slots occur over all sets left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            total += np.bincount((_columns(batch)[2] % U(SLOTS)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    counts = sets.select("cid", "tokens").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out[counts["slot"]] = counts["n"]
    return out


def rare_prefixes(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """(s, cid, at): the rarest shingles of each set, as many as must meet those of a set that
    it links with, and their places in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, n, h = _columns(batch)
            owner = np.repeat(np.arange(len(cid)), n)
            order = np.lexsort((h, counts[(h % U(SLOTS)).astype(np.int64)], owner))
            rank = _ragged(n)
            keep = rank < np.repeat(prefix_size(n, 0), n)
            yield pa.RecordBatch.from_arrays([pa.array(h[order][keep].view(np.int64)), pa.array(np.repeat(cid, n)[keep]), pa.array(rank[keep].astype(np.int32))], ["s", "cid", "at"])

    return sets.select("cid", "tokens").mapInArrow(run, "s long, cid long, at int")


def may_link(n: Column, m: Column, i: Column, j: Column) -> Column:
    """Length and positional filters of sets of n and m that meet at places i and j: the
    overlap may still reach 3/7 of n + m."""
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (7 * (F.least(n - i, m - j)) >= 3 * (n + m))


def components(links: DataFrame) -> DataFrame:
    """(cid, root): the least node that each node of the links can reach.

    Alternates between bringing the larger and the smaller neighbours of each node to the
    least of them, until nothing moves. Each node takes the minimum of its neighbours by an
    aggregate, so a node with many links is no single task's.
    """
    def symmetric(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())

    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(edges)
    while True:
        both = symmetric(edges)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        small = materialize(small, "edges")
        drop_table(large)
        drop_table(edges)
        edges, after = small, state(small)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("a").alias("cid")).agg(F.min("b").alias("root"))


