"""Decontamination against a search of every window in every document."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination as dc

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items):
    windows = {}
    for k, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for k, t in docs:
        w, hit, of = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    of |= windows[g]
        of = sorted(str(x) for x in of if x is not None)
        out.append((k, len(w), len(hit), len(of), hashlib.sha256(",".join(of).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, DOCS)
    for c in ("spans", "items", "n_words", "block", "item"):
        d = d.withColumn(c, F.lit("clash"))
    rows = dc.mark_spans(d, spark.createDataFrame(items, ITEMS), keep=["doc_id"], **more).collect()
    return sorted(((r.doc_id, r.n_words, sum(s.last - s.first for s in r.spans), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in rows), key=str)


def sample(seed, n_docs, vocab=12):
    r = random.Random(seed)
    word = lambda: r.choice([*"abcdefgh", "é", "日本", "7", "Ab"][:vocab])
    items = [(k, " ".join(word() for _ in range(r.choice([1, 3, 9, 10, 14, 30])))) for k in range(12)]
    items = [(k, t) for k, t in items if len(t.split()) != 1] + [(50, "zeta"), (51, "!!"), (52, None), (None, "omega psi"), (53, "zeta"), (54, " ".join(["a"] * 40)), (12, "same id other words here")]
    docs = []
    for k in range(n_docs):
        t = [word() for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            w = (r.choice(items)[1] or "").split()
            at, a = r.randint(0, len(t)), r.randint(0, max(0, len(w) - 10))
            t[at:at] = w[a : a + r.randint(8, 16)]
        docs.append((k, r.choice([" ", "-", "\n", ", "]).join(t)))
    return docs + [(1, docs[1][1]), (None, docs[2][1]), (60, None), (61, ""), (62, "omega, PSI"), (63, "a " * 3000), (9007199254740993, "zeta")], items


def test_every_window_of_every_item(spark):
    for seed, vocab in ((1, 3), (2, 12)):
        docs, items = sample(seed, 120, vocab)
        assert found(spark, docs, items) == plain(docs, items)


def test_pieces_and_passes_change_nothing(spark):
    docs, items = sample(3, 60)
    assert found(spark, docs, items, piece=24, pass_bytes=1) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = sample(4, 5)
    assert found(spark, docs, []) == plain(docs, [])
    assert found(spark, [], items) == []


def test_long_texts_by_parts():
    text = ("word é " * 50 + "x" * 300 + "- ").encode() * 3
    data = np.frombuffer(text, np.uint8)
    for size in (16, 100, 1 << 20):
        got = [(b, e, h) for _, _, *f in dc.words_of(data, np.array([0, len(text)]), size) for b, e, h in zip(*f, strict=True)]
        assert [text[b:e].decode() for b, e, _ in got] == words(text.decode())
        assert len({h for *_, h in got}) == 3


def test_spans_are_taken_out(spark):
    item = " ".join(f"w{k}" for k in range(14))
    docs = [(1, f"Before é, {item.upper()}! After all of it there are more words of its own to keep."), (2, f"so {item} so"), (3, "nothing of it"), (4, None)]
    rows = {r.doc_id: r for r in dc.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, item)], ITEMS), longest=20, coverage=0.5).collect()}
    assert rows[1].text == docs[0][1] and rows[1].removed == [] and len(rows[1].spans) == 1 and rows[1]["items"] == ["7"]
    assert rows[2].text == "so  so" and rows[2].removed[0].last == 15
    assert rows[3].text == docs[2][1] and rows[4].text is None
    cut = {r.doc_id: r.text for r in dc.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, item)], ITEMS), longest=12).collect()}
    assert cut[1] == docs[0][1].replace(item.upper(), "")
