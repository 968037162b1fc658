"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, by_bytes, mix, small_batches, with_columns, worker_state

_WORD = re.compile(r"[^\W\d_]+")
DIMS = 1 << 16
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit value per word, from its characters alone."""
    return _grams(words)[0]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per word its own hash, and the ids (-1: none) of its affix and n-gram features:
    prefixes and suffixes of 1 to 4 letters, n-grams of 2 and 3."""
    width = max(map(len, words))
    letters = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    place, rows = np.arange(width), np.arange(len(words))
    there = place < size[:, None]
    salt = mix(letters + np.uint64(1) + (place.astype(np.uint64) << np.uint64(32)))
    whole = mix(np.where(there, salt, np.uint64(0)).sum(1, dtype=np.uint64))
    found = []

    def add(kind: int, h: np.ndarray, ok: np.ndarray) -> None:
        ids = (mix(h + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(DIMS)).astype(np.int32)
        found.append(np.where(ok, ids, -1).reshape(len(words), -1))

    code = letters + np.uint64(1)
    gram = code
    for n in range(1, 5):
        if n > width:
            break
        if n > 1:
            gram = gram[:, : width - n + 1] * np.uint64(0x100000001B3) + code[:, n - 1 :]
        fits = size >= n
        add(n, gram[:, 0], fits)
        add(10 + n, gram[rows, np.maximum(size - n, 0)], fits)
        if n in (2, 3):
            add(20 + n, gram, place[: width - n + 1] + n <= size[:, None])
    return whole, np.concatenate(found, 1)


class WordCrf:
    """Labels are languages. A word's potential sums the weights of its affixes, n-grams,
    and of the languages whose learned lexicon has it; transitions are learned.

    weights has a row for each hashed feature, then a lexicon row for each language, and a
    row of zeros for absent features.
    """

    def __init__(self, labels: list[str], lexicon: list[np.ndarray]):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((DIMS + k + 1, k))
        self.transitions, self.start = np.zeros((k, k)), np.zeros(k)

    def features(self, words: list[str]) -> np.ndarray:
        whole, grams = _grams(words)
        known = [np.where(np.isin(whole, x), DIMS + i, -1) for i, x in enumerate(self.lexicon)]
        return np.column_stack([grams, *known]).astype(np.int32)

    def potentials(self, words: list[str]) -> np.ndarray:
        """A row of log potentials for each word; very long words don't widen the others."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for top in (12, 24, 96, 1 << 40):
            rows = np.flatnonzero((size > low) & (size <= top))
            for part in np.array_split(rows, max(1, len(rows) * max(1, min(top, 4096)) // 400_000)) if len(rows) else []:
                out[part] = self.weights[self.features([words[i] for i in part])].sum(1)
            low = top
        return out


def forward_backward(logits: np.ndarray, starts: np.ndarray, transitions: np.ndarray, start: np.ndarray, block: int = 64) -> np.ndarray:
    """Marginals of each word. ``logits`` has the words of several chains in a row, chain c
    from starts[c] to starts[c + 1].

    Chains are cut into blocks: the product of a block's matrices is taken for all blocks at
    once, vectors are carried from block to block, and the words inside are done for all
    blocks at once again. The result is that of the plain recursion.
    """
    n, k = logits.shape
    emit = np.exp(logits - logits.max(1, keepdims=True))
    trans, first = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    sizes = np.diff(starts)
    per = -(-sizes // block)  # blocks of each chain
    total = int(per.sum())
    chain = np.repeat(np.arange(len(sizes)), per)
    at = np.arange(total) - np.repeat(np.cumsum(per) - per, per)  # a block's number in its chain
    begin = starts[chain] + at * block
    length = np.minimum(block, starts[chain + 1] - begin)
    step = np.arange(block)
    inside = step < length[:, None]
    e = np.where(inside[..., None], emit[np.minimum(begin[:, None] + step, n - 1)], 1.0)
    head = at == 0
    product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(block):
        live = inside[:, t]
        m = product @ trans
        if t == 0:
            m[head] = np.broadcast_to(first, (k, k))  # whatever came before the first word
        m *= e[:, t, None, :]
        m /= m.sum((1, 2), keepdims=True)
        product = np.where(live[:, None, None], m, product)
    enter, leave = np.full((total, k), 1.0 / k), np.ones((total, k))
    order = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[order], np.arange(at.max() + 2 if total else 1))
    for b in range(1, len(edges) - 1):
        rows = order[edges[b] : edges[b + 1]]
        v = np.einsum("ij,ijk->ik", enter[rows - 1], product[rows - 1])
        enter[rows] = v / v.sum(1, keepdims=True)
    for b in range(len(edges) - 2, 0, -1):
        rows = order[edges[b] : edges[b + 1]]
        v = np.einsum("ijk,ik->ij", product[rows], leave[rows])
        leave[rows - 1] = v / v.sum(1, keepdims=True)
    forward = np.empty((total, block, k))
    a = enter
    for t in range(block):
        nxt = a @ trans
        if t == 0:
            nxt[head] = first
        nxt *= e[:, t]
        nxt /= nxt.sum(1, keepdims=True)
        a = np.where(inside[:, t, None], nxt, a)
        forward[:, t] = a
    b = leave
    for t in range(block - 1, -1, -1):
        forward[:, t] *= b
        nxt = (b * e[:, t]) @ trans.T
        nxt /= nxt.sum(1, keepdims=True)
        b = np.where(inside[:, t, None], nxt, b)
    out = forward[inside]
    return out / out.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], sequences: int = 3000, epochs: int = 3, seed: int = 7) -> WordCrf:
    """Fits the field to word sequences that switch between texts: each is made of runs of
    2 to 40 words of random texts, and a run's words bear its text's language. Adagrad on the
    log-likelihood, whose gradient is that of forward-backward."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    tokens = [words_of(t) for t in texts]
    pools = [[i for i, (w, x) in enumerate(zip(tokens, langs, strict=True)) if x == lang and w] for lang in labels]
    lexicon = []
    for pool in pools:
        seen, n = np.unique(np.concatenate([word_hashes(sorted(set(tokens[i]))) for i in pool] or [np.zeros(0, np.uint64)]), return_counts=True)
        lexicon.append(seen[n >= max(2, len(pool) // 100)])
    crf = WordCrf(labels, lexicon)
    usable = [k for k, p in enumerate(pools) if p]
    if not usable:
        return crf
    k = len(labels)
    runs = []
    for _ in range(sequences):
        own, marks = [], []
        for _ in range(rng.integers(1, 5)):
            label = usable[rng.integers(len(usable))]
            source = tokens[pools[label][rng.integers(len(pools[label]))]]
            size = int(rng.integers(2, 41))
            begin = int(rng.integers(0, max(1, len(source) - size + 1)))
            own += source[begin : begin + size]
            marks += [label] * len(source[begin : begin + size])
        runs.append((own, marks))
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for own, _ in runs for w in own))}
    feats = np.full((len(vocabulary), 0), -1, np.int32)
    words = list(vocabulary)
    blocks = [crf.features(words[i : i + 5000]) for i in range(0, len(words), 5000)]
    width = max(b.shape[1] for b in blocks)
    feats = np.concatenate([np.pad(b, ((0, 0), (0, width - b.shape[1])), constant_values=-1) for b in blocks])
    squares = [np.full(x.shape, 1e-2) for x in (crf.weights, crf.transitions, crf.start)]
    rate = 0.15
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(runs)), max(1, len(runs) // 60)):
            ids = np.array([vocabulary[w] for r in part for w in runs[r][0]])
            gold = np.array([y for r in part for y in runs[r][1]])
            starts = np.concatenate([[0], np.cumsum([len(runs[r][0]) for r in part])])
            f = feats[ids]
            logits = crf.weights[f].sum(1)
            p = forward_backward(logits, starts, crf.transitions, crf.start)
            error = np.eye(k)[gold] - p
            used, back = np.unique(f, return_inverse=True)
            back = back.reshape(f.shape)
            g = np.stack([np.bincount(back.ravel(), np.repeat(error[:, y], width), len(used)) for y in range(k)], 1)
            g[used < 0] = 0
            g -= 1e-3 * crf.weights[used]
            squares[0][used] += g * g
            crf.weights[used] += rate * g / np.sqrt(squares[0][used])
            crf.weights[-1] = 0
            # expected transitions from pair marginals: p(y, y') is in proportion to f(y) T e(y') b(y')
            inner = np.ones(len(ids), bool)
            inner[starts[:-1]] = False
            second = np.flatnonzero(inner)
            pair = _pairs(logits, starts, crf, second)
            g = np.zeros((k, k))
            np.add.at(g, (gold[second - 1], gold[second]), 1.0)
            g -= pair
            squares[1] += g * g
            crf.transitions += rate * g / np.sqrt(squares[1])
            g = error[starts[:-1][np.diff(starts) > 0]].sum(0)
            squares[2] += g * g
            crf.start += rate * g / np.sqrt(squares[2])
    crf.weights = crf.weights.astype(np.float32)
    return crf


def _pairs(logits: np.ndarray, starts: np.ndarray, crf: WordCrf, second: np.ndarray) -> np.ndarray:
    """Summed marginals of label pairs at the words second - 1, second of short chains."""
    trans, k = np.exp(crf.transitions), logits.shape[1]
    emit = np.exp(logits - logits.max(1, keepdims=True))
    sizes = np.diff(starts)
    fwd, bwd = np.empty_like(emit), np.ones_like(emit)
    for t in range(int(sizes.max())):
        rows = starts[:-1][sizes > t] + t
        a = emit[rows] * (np.exp(crf.start) if t == 0 else fwd[rows - 1] @ trans)
        fwd[rows] = a / a.sum(1, keepdims=True)
    for t in range(int(sizes.max()) - 2, -1, -1):
        rows = starts[:-1][sizes > t + 1] + t
        b = (bwd[rows + 1] * emit[rows + 1]) @ trans.T
        bwd[rows] = b / b.sum(1, keepdims=True)
    joint = fwd[second - 1][:, :, None] * trans * (emit[second] * bwd[second])[:, None, :]
    return (joint / joint.sum((1, 2), keepdims=True)).sum(0) if len(second) else np.zeros((k, k))


class Labeller:
    """Word potentials by memo, and language shares of texts."""

    def __init__(self, crf: WordCrf, entries: int = 120_000):
        self.crf, self.entries = crf, entries
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(crf.labels)), np.float32)

    def _learn(self, words: set[str]) -> None:
        new = list(words.difference(self.rows))
        if new and len(self.rows) + len(new) > self.entries:
            self.rows, self.table, new = {}, self.table[:0], list(words)
        if new:
            base = len(self.rows)
            if base + len(new) > len(self.table):
                self.table = np.concatenate([self.table[:base], np.zeros((max(base, 2 * len(new)), self.table.shape[1]), np.float32)])
            self.table[base : base + len(new)] = self.crf.potentials(new)
            self.rows.update(zip(new, range(base, base + len(new)), strict=True))

    def marginals(self, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words in a row, and where each text's words start."""
        words: set[str] = set()
        for w in tokens:
            words.update(w)
        self._learn(words)
        starts = np.concatenate([[0], np.cumsum([len(w) for w in tokens])]).astype(np.int64)
        get = self.rows.__getitem__
        ids = np.fromiter((i for w in tokens for i in map(get, w)), np.int64, int(starts[-1]))
        if not len(ids):
            return np.zeros((0, len(self.crf.labels))), starts
        return forward_backward(self.table[ids], starts, self.crf.transitions, self.crf.start), starts

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Per text the mean marginal of each language over its words; zeros without words."""
        p, starts = self.marginals([words_of(t) for t in texts])
        sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0)])
        n = np.diff(starts)
        return (sums[starts[1:]] - sums[starts[:-1]]) / np.maximum(n, 1)[:, None]


def fit(docs: DataFrame, train_rows: int = 2000) -> WordCrf:
    """Learns from at most ``train_rows`` rows with a language whose crc32(doc_id) mod 3 is
    not 1: those of the smallest hashes of doc_id, so the sample is the same at every run. Texts
    beyond ``bounded_sample``'s length and sum take no part in learning."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    rows = bounded_sample(rows.select("doc_id", "text", "lang"), "doc_id", train_rows, "text")
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, crf: WordCrf, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds lang_pred and score to the columns ``keep`` of every row.

    score is the mean marginal of the predicted language over all words of the text, so
    code-switched texts score lower. Null, empty and letterless texts are ``und`` with score
    0, and so is every text if nothing was learned; of languages with equal shares the first by
    name is taken. Null ids stay null; repeated rows and ids give a row each; very long texts
    are labelled whole, in blocks of words; other columns are ignored, whatever their names; an
    empty table gives no rows.
    """
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_state(("crf", key), lambda: Labeller(crf))
        for b in batches:
            texts = b.column(text).to_pylist()
            for s in by_bytes(texts, 1 << 19):
                share = own.shares(texts[s]) if crf.labels else np.zeros((len(texts[s]), 1))
                best = share.argmax(1)
                ok = np.array([has_letter(t) for t in texts[s]], bool) & (share.max(1) > 0)
                found = [crf.labels[k] if y else UNKNOWN for k, y in zip(best, ok, strict=True)]
                yield with_columns(b, s, keep, lang_pred=pa.array(found, pa.string()), score=pa.array(np.where(ok, np.minimum(share.max(1), 1.0), 0.0)))

    key = uuid.uuid4().hex
    small_batches(docs.sparkSession)
    text = "text" if "text" in keep else "_text"
    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col("text").alias("_text"))
    return rows.mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return identify(docs, fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
