"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton of all items' words (states, transitions, suffix links) is built by tasks, a
bounded number of words each, and streams each document: its state is the longest ending of
the words read so far that stands in an item. Where that is as long as a window (10 words),
the last 10 are hit; a shorter item is hit where it ends as a whole. Only stretches of words
whose neighbours stand beside each other in items are streamed: between two words that don't,
every match ends.

Items are normalised as documents are: A-Z in lower case, words of letters a-z, digits and
everything beyond ASCII. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import io
import json
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .setjoin import word_hashes
from .shared import materialize, worker_state

WINDOW = 10
PIECE = 1 << 16  # words of an item, or about so many of a block of items, in one automaton
SEGMENT = 1 << 21  # bytes of text that are looked at together
PASS_BYTES = 1 << 27  # of automata, broadcast for one pass over the documents
SLOTS = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SPANS = "n_words long, spans array<struct<first:long,last:long,begin:long,end:long>>, items array<string>"


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, edges) of a column of texts; null is empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    edges = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), edges


def find_words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the texts data[edges[i]:edges[i + 1]] begin and end."""
    part = data[edges[0] : edges[-1]]
    n = len(part)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _WORD[part]
    fence = np.zeros(n + 1, bool)
    fence[edges - edges[0]] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | fence[1:n]
    last[:-1] &= ~word[1:] | fence[1:n]
    return np.flatnonzero(first) + edges[0], np.flatnonzero(last) + 1 + edges[0]


def segments(data: np.ndarray, edges: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first text, edges) of runs of texts of about ``size`` bytes. A longer text
    stands alone."""
    i, n = 0, len(edges) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + size, "right")) - 1)
        yield i, edges[i : j + 1]
        i = j


def parts(data: np.ndarray, begin: int, end: int, size: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """A text's bytes in parts of about ``size``, cut before a word."""
    while end - begin > size:
        cut = begin + size
        while cut < end:
            gaps = np.flatnonzero(~_WORD[data[cut : min(cut + size, end)]])
            if len(gaps):
                cut += int(gaps[0])
                break
            cut = min(cut + size, end)
        yield begin, cut
        begin = cut
    if end > begin:
        yield begin, end


def words_of(data: np.ndarray, edges: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, its edges, begins, ends and hashes of words) by segments; the words of a
    longer text are found by parts, so that only they, not tables of its bytes, are held."""
    for i, e in segments(data, edges, size):
        if len(e) > 2 or e[-1] - e[0] <= size:
            begin, end = find_words(data, e)
            yield i, e, begin, end, word_hashes(data, begin, end)
        else:
            found = [(*(w := find_words(data, np.array(p))), word_hashes(data, *w)) for p in parts(data, int(e[0]), int(e[-1]), size)]
            yield i, e, *[np.concatenate(x) for x in zip(*found, strict=True)]


class Builder:
    """A generalised suffix automaton: sequences are added one after another. A state is a set
    of strings that end at the same places; it knows its longest, and by its link the state of
    the longest ending that stands at more places. State 0 is the empty string."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's longest string and w alone, apart from the longer ones that also lead there."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int]) -> None:
        at = 0
        for w in words:
            if w in self.next[at]:
                at = self._split(at, w)
                continue
            new, p = self._state(self.length[at] + 1, 0, {}), at
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, w)
            at = new


def compile_block(pieces: list[tuple[str | None, np.ndarray, bool]], window: int) -> bytes:
    """The automaton of (item, hashes of words, is all of the item), as arrays."""
    vocab = np.unique(np.concatenate([p[1] for p in pieces]))
    known = [(name, np.searchsorted(vocab, h).tolist(), whole) for name, h, whole in pieces]
    size = len(vocab)
    build = Builder()
    for _, words, _ in known:
        build.add(words)
    length, link = build.length, build.link
    keys = sorted((s * size + w, t) for s, after in enumerate(build.next) for w, t in after.items())
    names = sorted({name for name, _, _ in known if name is not None})
    number = {name: k for k, name in enumerate(names)} | {None: -1}
    marks = set()  # (state, length of a window in it, item)
    for name, words, whole in known:
        at = 0
        short = whole and len(words) < window
        for k, w in enumerate(words):
            at = build.next[at][w]
            if k + 1 >= window or (short and k + 1 == len(words)):
                n, s = min(window, k + 1), at
                while length[link[s]] >= n:
                    s = link[s]
                marks.add((s, n, number[name]))
                at = s  # the ending of a window's length leads to the next one
    mark = np.array(sorted(marks), np.int64).reshape(-1, 3)
    near = list(range(len(link)))  # the nearest state, by links, that has marks
    marked = set(mark[:, 0].tolist())
    for s in sorted(range(1, len(link)), key=length.__getitem__):
        near[s] = s if s in marked else near[link[s]]
    pairs = np.unique(np.array([a * size + b for _, words, _ in known for a, b in zip(words, words[1:], strict=False)], np.int64))
    out = io.BytesIO()
    least = int(mark[:, 1].min()) if len(mark) else window
    arrays = {"vocab": vocab, "keys": np.array([k for k, _ in keys], np.int64), "to": np.array([t for _, t in keys], np.int32), "link": np.array(link, np.int32), "length": np.array(length, np.int32), "near": np.array(near, np.int32), "mark": mark, "pairs": pairs, "least": np.array([least]), "names": np.frombuffer(json.dumps(names).encode(), np.uint8)}
    np.savez(out, **arrays, ones=np.unique(np.array([words[0] for _, words, whole in known if whole and len(words) == 1], np.int64)))
    return out.getvalue()


class Matcher:
    """A compiled block, ready to stream words."""

    def __init__(self, payload: bytes) -> None:
        a = np.load(io.BytesIO(payload), allow_pickle=False)
        self.vocab, self.pairs, self.ones = a["vocab"], a["pairs"], a["ones"]
        self.size, self.least = len(self.vocab), int(a["least"][0])
        self.maybe_word, self.maybe_pair = np.zeros(SLOTS, bool), np.zeros(SLOTS, bool)
        self.maybe_word[(self.vocab % np.uint64(SLOTS)).astype(np.int64)] = True
        self.maybe_pair[self.pairs % SLOTS] = True
        self.keys, self.to = memoryview(a["keys"]), memoryview(a["to"])
        self.link, self.length, self.near = (memoryview(a[c]) for c in ("link", "length", "near"))
        self.names = json.loads(a["names"].tobytes())
        mark = a["mark"]
        self.marks: dict[int, list[tuple[int, list[int]]]] = {}
        for s, n, item in mark.tolist():
            of = self.marks.setdefault(s, [])
            if not of or of[-1][0] != n:
                of.append((n, []))
            of[-1][1].append(item)

    def stretches(self, hashes: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the words, begins, ends): the runs of words that stand in items pair by pair,
        long enough for the shortest window. new: the word is a text's first."""
        ids = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(self.maybe_word[(hashes % np.uint64(SLOTS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocab, hashes[at]), self.size - 1)
        real = self.vocab[place] == hashes[at]
        ids[at[real]] = place[real]
        both = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0) & ~new[1:]) + 1
        code = ids[both - 1] * self.size + ids[both]
        some = self.maybe_pair[code % SLOTS]
        both, code = both[some], code[some]
        if len(self.pairs):
            both = both[self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code]
        else:
            both = both[:0]
        cut = np.flatnonzero(np.diff(both) != 1) + 1
        begin = both[np.concatenate([[0], cut])] - 1 if len(both) else both
        end = both[np.concatenate([cut - 1, [len(both) - 1]])] + 1 if len(both) else both
        if len(self.ones):
            alone = np.ones(len(ids), bool)
            alone[both] = alone[both - 1] = False
            single = np.flatnonzero(alone & np.isin(ids, self.ones))
            begin, end = np.concatenate([begin, single]), np.concatenate([end, single + 1])
            order = np.argsort(begin)
            begin, end = begin[order], end[order]
        keep = end - begin >= self.least
        return ids, begin[keep], end[keep]

    def stream(self, words: list[int]) -> tuple[bytearray, set[int]]:
        """Which of the words are hit, and by which items."""
        keys, to, link, length, near, marks, size = self.keys, self.to, self.link, self.length, self.near, self.marks, self.size
        hit, items, n_keys = bytearray(len(words)), set(), len(self.keys)
        state = matched = 0
        for i, w in enumerate(words):
            while True:
                key = state * size + w
                k = bisect_left(keys, key)
                if k < n_keys and keys[k] == key:
                    state, matched = to[k], matched + 1
                    break
                if state == 0:
                    matched = 0
                    break
                state = link[state]
                matched = length[state]
            s = near[state]
            while s > 0:
                for n, of in marks[s]:
                    if n <= matched:
                        hit[i + 1 - n : i + 1] = b"\1" * n
                        items.update(of)
                s = near[link[s]]
        return hit, items


def item_pieces(items: DataFrame, id_col: str, text_col: str, window: int, piece: int) -> DataFrame:
    """(item, words, whole): the hashed words of the items, in pieces that overlap by a window
    less one word, so that each window stands in one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, edges = text_bytes(b.column(1))
            names, out = b.column(0).to_pylist(), []
            for i, e, begin, _, h in words_of(data, edges):
                text = np.searchsorted(e, begin, "right") - 1
                for t in np.unique(text):
                    mine = h[text == t].view(np.int64)
                    for at in range(0, max(1, len(mine) - window + 1), piece - window + 1):
                        out.append((names[i + t], mine[at : at + piece], len(mine) <= piece))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out])], names=["item", "words", "whole"])

    return items.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(cut, "item string, words array<long>, whole boolean")


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """(block, payload): compiled automata of about ``piece`` words' worth of items each, written out."""
    pieces = materialize(item_pieces(items, id_col, text_col, window, piece), "item-words")
    blocks = max(1, -(-(pieces.agg(F.sum(F.size("words"))).head()[0] or 0) // piece))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))

    def compiled(rows: pd.DataFrame) -> pd.DataFrame:
        block = [(name, np.asarray(w, np.int64).view(np.uint64), bool(whole)) for name, w, whole in zip(rows["item"], rows["words"], rows["whole"], strict=True)]
        block.sort(key=lambda x: (x[0] or "", x[1].tobytes()))
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "payload": [compile_block(block, window)]})

    return materialize(dealt.groupBy("block").applyInPandas(compiled, "block long, payload binary"), "automata")


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def mark_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, piece: int = PIECE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The columns ``keep`` of docs (all by default), and n_words; spans: the runs of hit words, by
    numbers of words (first, last; from 0, last excluded) and by bytes of the text in UTF-8
    (begin, end); items: the ids, as sorted strings, of the items of which a window occurs.

    A null or empty text has no words. Rows are never merged or told apart by an id, so
    repeated and null ids keep theirs. Of items, rows of one id count as one; without an id they
    hit and are not listed; without words they are nothing. Very long texts are searched whole,
    by parts of their bytes. Columns of docs that are named as the new ones give way. Empty tables
    give no rows, or no hits.

    Automata are broadcast up to ``pass_bytes`` (128 MB) at a time. If there are more, the documents
    pass several times, and what was found is written with them in between.
    """
    spark = docs.sparkSession
    new = ["n_words", "spans", "items"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    blocks = automata(items, item_id, item_text, window, piece)
    sizes = sorted((r["block"], r["n"]) for r in blocks.select("block", F.length("payload").alias("n")).collect())
    passes: list[list[int]] = [[]]
    held = 0
    for block, n in sizes:
        if passes[-1] and held + n > pass_bytes:
            passes.append([])
            held = 0
        passes[-1].append(block)
        held += n
    text, seen = "_text" + uuid.uuid4().hex, "_seen" + uuid.uuid4().hex
    out = docs.select(F.col(text_col).alias(text), F.array().cast("array<struct<first:long,last:long,begin:long,end:long>>").alias(seen), F.array().cast("array<string>").alias(seen + "i"), *keep)
    for k, group in enumerate(passes):
        payloads = [bytes(r["payload"]) for r in blocks.where(F.col("block").isin(group)).orderBy("block").collect()] if group else []
        shared = spark.sparkContext.broadcast(payloads)
        last = k == len(passes) - 1
        kept = docs.select(*keep).schema.fields
        before = [] if last else out.schema.fields[:1]
        schema = StructType([*before, *kept, *StructType.fromDDL(SPANS).fields])
        out = out.mapInArrow(_scan(shared, uuid.uuid4().hex, last, schema.names), schema)
        if not last:
            out = materialize(out.select(text, F.col("spans").alias(seen), F.col("items").alias(seen + "i"), *keep), "documents-marked")
    return out.select(*keep, *new)


def _scan(shared, name: str, last: bool, names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = worker_state(("automata", name), lambda: [Matcher(p) for p in shared.value])
        for b in batches:
            data, edges = text_bytes(b.column(0))
            old, had = b.column(1).to_pylist(), b.column(2).to_pylist()
            n = b.num_rows
            n_words = np.zeros(n, np.int64)
            spans: list[list] = [[] for _ in range(n)]
            items = [set(x) for x in had]
            for i, e, begin, end, h in words_of(data, edges):
                of = np.searchsorted(e, begin, "right") - 1
                n_words[i : i + len(e) - 1] += np.bincount(of, minlength=len(e) - 1)
                new = np.ones(len(h), bool)
                new[1:] = of[1:] != of[:-1]
                start = np.zeros(len(e), np.int64)
                np.cumsum(np.bincount(of, minlength=len(e) - 1), out=start[1:])
                mask = np.zeros(len(h), bool)
                for t in range(len(e) - 1):
                    for s in old[i + t]:
                        mask[start[t] + s["first"] : start[t] + s["last"]] = True
                if len(h):
                    for m in blocks:
                        ids, froms, tos = m.stretches(h, new)
                        for x, y in zip(froms.tolist(), tos.tolist(), strict=True):
                            hit, by = m.stream(ids[x:y].tolist())
                            if by:
                                mask[x:y] |= np.frombuffer(hit, bool)
                                items[i + int(of[x])].update(m.names[k] for k in by if k >= 0)
                if mask.any():
                    edge = mask.copy()
                    froms, tos = _runs(edge)
                    for x, y in zip(froms.tolist(), tos.tolist(), strict=True):
                        while x < y:  # a run of hits may go on into the next text
                            t = int(of[x])
                            z = min(y, int(start[t + 1]))
                            spans[i + t].append({"first": x - int(start[t]), "last": z - int(start[t]), "begin": int(begin[x] - e[t]), "end": int(end[z - 1] - e[t])})
                            x = z
            found = [pa.array(n_words), pa.array(spans, pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "begin", "end")]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*([] if last else [b.column(0)]), *[b.column(c) for c in range(3, b.num_columns)], *found], names=names)

    return scan


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", longest: int = 12, coverage: float = 0.5, **more) -> DataFrame:
    """docs with benchmark passages taken out of their texts: a span goes if it has more than
    ``longest`` words, and all spans of a text go if they cover more than ``coverage`` of its words. The columns
    of docs, and n_words, spans and items as by ``mark_spans``, of which ``removed`` went.

    Only the spans' bytes go, with nothing in their place. Null texts stay null.
    """
    marked = mark_spans(docs, items, text_col, **more)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    all_go = hit > coverage * F.col("n_words")
    marked = marked.withColumn("removed", F.filter("spans", lambda x: all_go | (x["last"] - x["first"] > longest)))
    at, where = marked.columns.index(text_col), marked.columns.index("removed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, gone in zip(b.column(at).to_pylist(), b.column(where).to_pylist(), strict=True):
                if gone:
                    raw, edges = text.encode(), [0, *[x for s in gone for x in (s["begin"], s["end"])]]
                    text = b"".join(raw[p:q] for p, q in zip(edges[::2], [*edges[1::2], len(raw)], strict=True)).decode()
                out.append(text)
            columns = [pa.array(out, b.column(at).type) if k == at else c for k, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return marked.mapInArrow(cut, marked.schema)


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = mark_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return out.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
grams AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
met AS (SELECT r, item_id, n, i FROM grams JOIN windows USING (n, g)),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS k FROM met) GROUP BY r),
of AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN of USING (r)
"""
