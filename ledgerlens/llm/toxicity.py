"""Toxicity scores by a classifier that is regularised with counterfactuals."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid_crf import words_of
from .shared import bounded_sample, by_bytes, small_batches, with_columns, worker_state

# Terms that name a group. Within a row they can stand for each other.
IDENTITY_TERMS = (
    "women men girls boys wives husbands mothers fathers".split(),
    "woman man girl boy wife husband mother father".split(),
    "muslim christian jewish hindu buddhist catholic atheist sikh".split(),
    "muslims christians jews hindus buddhists catholics atheists sikhs".split(),
    "black white asian latino arab african european american mexican".split(),
    "gay straight lesbian bisexual transgender queer heterosexual".split(),
    "immigrants refugees foreigners natives citizens migrants".split(),
    "disabled blind deaf old young elderly poor rich".split(),
    "femmes hommes musulmans chrétiens juifs noirs blancs arabes immigrés".split(),
    "frauen männer muslime christen juden schwarze weiße araber ausländer".split(),
    "mujeres hombres musulmanes cristianos judíos negros blancos árabes inmigrantes".split(),
)
_ROW = {t: row for row in IDENTITY_TERMS for t in row}
_SENTENCE = re.compile(r"[.!?\n]+")


def word_features(word: str) -> list[str]:
    """The word, and its prefixes from 4 to 8 letters."""
    return [word] + [f"{word[:n]}-" for n in range(4, min(9, len(word)))]


def swapped(text: str, limit: int = 4) -> list[str]:
    """Sentences of text with an identity term, as pairs' second halves: the term replaced
    by others of its row, ``limit`` of them at most."""
    out = []
    for sentence in _SENTENCE.split(text.lower()):
        words = words_of(sentence)
        for term in dict.fromkeys(w for w in words if w in _ROW):
            row = _ROW[term]
            k = row.index(term)
            for step in range(1, min(limit, len(row) - 1) + 1):
                other = row[(k + step) % len(row)]
                out.append((sentence, " ".join(other if w == term else w for w in words)))
    return out


SLOTS = 1 << 22


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SLOTS


def _evidence(seen: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log likelihood ratios of features seen in so many texts of each class, of which
    there are ``size``."""
    rate = seen.sum(1) / size.sum()

    def part(a: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log(p / q), 0.0)

    return sum(part(seen[:, k], seen[:, k] / size[k], rate) + part(size[k] - seen[:, k], 1 - seen[:, k] / size[k], 1 - rate) for k in (0, 1))


class ToxicityModel:
    """A logistic model over the distinct words of a text: each adds the weights of its
    selected features."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def word_weight(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in word_features(word))


def train(texts: list[str], toxic: list[int], keep: int = 3000, penalty: float = 1.0, ridge: float = 0.0005, steps: int = 300) -> ToxicityModel:
    """Fits weights to labelled texts.

    Features: of those in 3 texts or more, the ``keep`` with the most evidence (the log
    likelihood ratio of toxic against other texts) among those with more than chance gives
    the best of so many, and identity terms always. Loss: mean logistic loss, toxic texts
    weighing half as much as the others together, so a text without evidence is none, plus ridge * |w|^2, plus penalty times
    the mean squared change of the logit when an identity term in a sentence is swapped,
    which draws the weights of identity terms together. Full-batch Adam.
    """
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, 4.0 if len(y) and y[0] else -4.0)
    size = np.array([(y == 0).sum(), (y == 1).sum()], float)
    # First all features by hash, in tables of fixed size; then those that may be chosen, by name.
    table = np.zeros((2, SLOTS), np.int32)
    for t, label in zip(texts, toxic, strict=True):
        table[int(label), np.unique([_slot(f) for w in set(words_of(t)) for f in word_features(w)] or [0])] += 1
    common = np.flatnonzero(table.sum(0) >= 3)
    enough = np.log(max(len(common), 1)) + 2
    promising = np.zeros(SLOTS, bool)
    promising[common] = _evidence(table[:, common].T.astype(float), size) >= enough
    counts: dict[str, list[int]] = {}
    for t, label in zip(texts, toxic, strict=True):
        for f in {f for w in set(words_of(t)) for f in word_features(w) if promising[_slot(f)]}:
            counts.setdefault(f, [0, 0])[int(label)] += 1
    names = sorted(f for f, n in counts.items() if sum(n) >= 3)
    seen = np.array([counts[f] for f in names], float).reshape(-1, 2)
    evidence = _evidence(seen, size)
    chosen = [names[i] for i in np.argsort(-evidence, kind="stable")[:keep] if evidence[i] >= enough]
    chosen += [t for row in IDENTITY_TERMS for t in row if t not in set(chosen)]
    at = {f: i for i, f in enumerate(chosen)}

    def matrix(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, columns and counts of the features of distinct words."""
        r, c = [], []
        for i, t in enumerate(rows):
            for w in set(words_of(t)):
                for f in word_features(w):
                    if f in at:
                        r.append(i)
                        c.append(at[f])
        return np.array(r, np.int64), np.array(c, np.int64), np.ones(len(r))

    r, c, v = matrix(texts)
    pairs = [x for t in texts for x in swapped(t)]
    # the terms alone as well, so that a feature which only some terms of a row have is penalised
    # where no labelled sentence names a group
    pairs += [(a, b) for row in IDENTITY_TERMS for a, b in zip(row, row[1:] + row[:1], strict=True)]
    pr, pc, pv = matrix([a for a, _ in pairs])
    qr, qc, qv = matrix([b for _, b in pairs])
    pr, pc, pv = np.concatenate([pr, qr]), np.concatenate([pc, qc]), np.concatenate([pv, -qv])
    class_weight = np.where(y == 1, 1 / 3 / size[1], 2 / 3 / size[0])
    w, m, s = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):
        logit = np.bincount(r, w[c] * v, len(y)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * class_weight
        g = np.zeros_like(w)
        g[:-1] = np.bincount(c, error[r] * v, len(chosen))
        if pairs:
            change = np.bincount(pr, w[pc] * pv, len(pairs))
            g[:-1] += penalty * 2 / len(pairs) * np.bincount(pc, change[pr] * pv, len(chosen))
        g[:-1] += 2 * ridge * w[:-1]
        g[-1] = error.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return ToxicityModel({f: float(x) for f, x in zip(chosen, w, strict=False) if abs(x) > 1e-4}, float(w[-1]))


class Scorer:
    def __init__(self, model: ToxicityModel, entries: int = 200_000):
        self.model, self.entries = model, entries
        self.memo: dict[str, float] = {}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.memo) > self.entries:
            self.memo = {}
        memo, logits = self.memo, []
        for t in texts:
            words = set(words_of(t))
            for w in words.difference(memo):
                memo[w] = self.model.word_weight(w)
            logits.append(self.model.bias + sum(map(memo.__getitem__, words)))
        return 1 / (1 + np.exp(-np.clip(np.array(logits, float), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 4000) -> ToxicityModel:
    """Learns from at most ``train_rows`` labelled rows whose crc32(doc_id) mod 5 is not 0:
    those of the smallest hashes of doc_id. Texts beyond ``bounded_sample``'s length and sum
    take no part in learning."""
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = bounded_sample(marks, "doc_id", train_rows)
    spark = docs.sparkSession
    found = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], marks.schema)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(found), "doc_id")
    rows = bounded_sample(rows, "doc_id", train_rows, "text")  # ids may repeat
    rows = sorted(rows, key=lambda r: (str(r["doc_id"]).rjust(24), r["text"]))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score_documents(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds score and predicted to the columns ``keep`` of every row.

    Null and empty texts get the score of a text without words. Null ids stay null; repeated
    rows and ids give a row each; equal texts have equal scores; very long texts are scored
    whole, their words one by one; other columns are ignored, whatever their names; an empty
    table gives no rows.
    """
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int"
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_state(("toxicity", key), lambda: Scorer(model))
        for b in batches:
            texts = b.column(text).to_pylist()
            for s in by_bytes(texts, 1 << 20):
                score = np.asarray(own.score(texts[s]), np.float64)
                yield with_columns(b, s, keep, score=pa.array(score), predicted=pa.array((score >= 0.5).astype(np.int32)))

    small_batches(docs.sparkSession)
    text = "text" if "text" in keep else "_text"
    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col("text").alias("_text"))
    return rows.mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
