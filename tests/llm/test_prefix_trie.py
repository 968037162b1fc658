"""Prefix trie of conversations against a trie that is built in one process."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ledgerlens.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest(), (r, t)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(turns.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + mine[h:])
    members, kids = defaultdict(set), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].add(c)
            if d:
                kids[p[: d - 1]].add(p[:d])
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        saved[node] = (len(members[node]) - 1) * len(node[-1][1] if node else "") + sum(saved[k] for k in kids[node])
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
    ends = {n: ",".join(map(str, sorted(c for c in m if paths[c] == n))) for n, m in members.items()}
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()
    )


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for c in ("conv", "depth", "x", "y", "rest", "leaf", "blk", "g", "o", "own"):
        df = df.withColumn(c, F.lit("clash"))
    return sorted(tuple(r) for r in prefix_trie(df, **more).collect())


def test_paths_of_many_shapes(spark):
    r = random.Random(5)
    words = ["", "a", "bé", "long " * 400, None]
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(words[:3])) for c in [*range(0, 24), *range(98, 112), 205, 206, -3, -104] for t in range(r.randint(1, 7))]
    rows += [(7, None, None, None), (7, 1, "user", "a"), (7, 1, "user", "a"), (None, 1, "user", "lost"), (300, 0, "user", words[3])]
    rows += [(400 + k, t, "user", "copy") for k in range(40) for t in range(8)]
    rows += [(500, t, "user", f"turn {t % 3}") for t in range(60)]
    for block in (1 << 16, 4):
        assert found(spark, rows, block_rows=block) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_no_conversations(spark, rows):
    assert found(spark, rows) == []


def test_conversation_without_turns_is_at_the_root(spark):
    c = next(k for k in range(101, 199) if zlib.crc32(str(k).encode()) % 6 > 0)
    assert found(spark, [(c, 0, "user", "gone")]) == plain([(c, 0, "user", "gone")])
    assert len(plain([(c, 0, "user", "gone")])) == 1
