"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns, its members the conversations that begin with
it, and its owner the smallest member. If a conversation owns a node it owns every deeper one
on its path, since members only grow fewer: each conversation owns a suffix of its path. So
what a subtree holds comes from its members' own paths, without a walk of the tree: each node
of it is owned by exactly one of them.

    tokens saved below a node = sum over members of (their tokens from its depth on)
                              - sum over members of (their tokens of owned nodes from its depth on)
    leaves                    = members that own a childless end
    children                  = members that own the next node of their path

A conversation may hold any share of the turns: its path is numbered by sorted ranges and cut
into blocks, windows run within a block, and what goes before a block is one row of another
table. A node may hold any share of the conversations: its sums are aggregated before they
are shuffled. Sequences are told apart by their depth and 128 bits of hashes of SHA-256
digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop_table, materialize, small_batches

BLOCK_ROWS = 1 << 16  # turns of a path that meet in one group
ID_RANGE = 1 << 12  # ids of a list that meet in one row
HEAD, FAMILY = 6, 100
KEY = ["depth", "x", "y"]
UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def _placed(conversations: DataFrame) -> DataFrame:
    """(conv, digest, cp, g): every turn with its place g in the order by conversation, turn
    (null first) and digest, counted from 0 over the whole table. Ranges are sorted side by side."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("cp"))
    order = ["conv", "turn", "digest", "_copy"]
    ranged = rows.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    at = materialize(ranged.select("conv", "digest", "cp", F.monotonically_increasing_id().alias("_at")), "turns")
    part = F.shiftright("_at", 33).alias("_p")
    sizes = at.groupBy(part).count()
    before = sizes.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(*BEFORE)), F.lit(0)).alias("_before"))
    return at.withColumn("_p", part).join(F.broadcast(before), "_p").select("conv", "digest", "cp", (F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before")).alias("g"))


def rebuilt_paths(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv, depth, len, digest, cp): each rebuilt conversation's turns by depth from 1, and
    its textless root at depth 0. A conversation has the first turns of the first of its
    family of 100, as many as its id's CRC-32 modulo 6 says, and then its own after as many."""
    turns = materialize(_placed(conversations), "turns-placed")
    blocks = turns.groupBy("conv", F.floor(F.col("g") / block_rows).alias("blk")).agg(F.min("g").alias("g0"), F.count("*").alias("n"))
    convs = blocks.groupBy("conv").agg(F.min("g0").alias("g0"), F.sum("n").alias("n"))
    convs = convs.select("conv", "g0", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("first"), (F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD).alias("h"))
    firsts = convs.select(F.col("conv").alias("first"), F.col("n").alias("first_n"))
    taken = F.least("h", F.coalesce("first_n", F.lit(0)))
    convs = convs.join(firsts, "first", "left").select("conv", "g0", "first", "h", taken.alias("m"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    convs = materialize(convs, "conversations")
    known = blocks.select("conv", "blk").join(convs, "conv")
    own = turns.withColumn("blk", F.floor(F.col("g") / block_rows)).join(known, ["conv", "blk"])
    own = materialize(own.select("conv", (F.col("g") - F.col("g0") + 1).alias("o"), "h", "m", "len", "digest", "cp"), "own-turns")
    heads = own.where((F.col("o") < HEAD) & (F.col("conv") % FAMILY == 0)).select(F.col("conv").alias("first"), "o", "digest", "cp")
    headed = heads.join(convs.where("m > 0").select("conv", "first", "m", "len"), "first").where("o <= m")
    rows = own.where("o > h").select("conv", (F.col("m") + F.col("o") - F.col("h")).alias("depth"), "len", "digest", "cp")
    rows = rows.unionByName(headed.select("conv", F.col("o").alias("depth"), "len", "digest", "cp"))
    return rows.unionByName(convs.select("conv", F.lit(0).cast("long").alias("depth"), "len", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("cp")))


def prefixes(paths: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """((conv, blk, depth, len, x, y, rest), (conv, blk)): for every place of a path, the hashes
    of all turns up to it and the code points from it on. A hash of a sequence is the exclusive
    or of its turns' hashes by depth, so blocks can be hashed side by side."""
    lanes = [F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(salt), "depth", "digest")).cast("long") for salt in (11, 29)]
    rows = paths.select("conv", F.floor(F.col("depth") / block_rows).alias("blk"), "depth", "len", "cp", lanes[0].alias("x"), lanes[1].alias("y"))
    run = Window.partitionBy("conv", "blk").orderBy("depth").rowsBetween(*UP_TO_HERE)
    local = materialize(rows.select("conv", "blk", "depth", "len", "cp", F.bit_xor("x").over(run).alias("x"), F.bit_xor("y").over(run).alias("y"), F.sum("cp").over(run).alias("upto")), "blocks")
    total = local.groupBy("conv", "blk").agg(F.max_by(F.struct("x", "y", "upto"), "depth").alias("t"))
    ahead = Window.partitionBy("conv").orderBy("blk").rowsBetween(*BEFORE)
    edge = total.select(
        "conv",
        "blk",
        F.coalesce(F.bit_xor("t.x").over(ahead), F.lit(0)).alias("bx"),
        F.coalesce(F.bit_xor("t.y").over(ahead), F.lit(0)).alias("by"),
        (F.sum("t.upto").over(Window.partitionBy("conv")) - F.coalesce(F.sum("t.upto").over(ahead), F.lit(0))).alias("left"),
    )
    edge = materialize(edge, "block-edges")
    x, y = F.col("x").bitwiseXOR(F.col("bx")).alias("x"), F.col("y").bitwiseXOR(F.col("by")).alias("y")
    full = local.join(edge, ["conv", "blk"]).select("conv", "blk", "depth", "len", x, y, (F.col("left") - F.col("upto") + F.col("cp")).alias("rest"))
    full = materialize(full, "prefixes")
    drop_table(local)
    return full, edge.select("conv", "blk")


def ends_digests(ends: DataFrame, id_range: int = ID_RANGE) -> DataFrame:
    """(KEY, ends_sha256) over (KEY, conv): the digest of each node's conversations that end
    there. Ids are distinct, so a range of them has a bounded number; a node's ranges stream through its digest."""
    small_batches(ends.sparkSession)
    ids = F.array_join(F.array_sort(F.collect_list("conv")), ",")
    ranges = ends.groupBy(*KEY, F.floor(F.col("conv") / id_range).alias("range")).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, out = None, None, []

        def full() -> pa.RecordBatch:
            keys = list(zip(*[k for k, _ in out], strict=True))
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in keys], pa.array([d for _, d in out])], names=[*KEY, "ends_sha256"])

        for b in batches:
            for *k, ids in zip(*[b.column(c).to_pylist() for c in (*KEY, "ids")], strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(ids.encode())
                else:
                    h.update(f",{ids}".encode())
            if len(out) >= 4096:
                yield full()
                out = []
        if key is not None:
            out.append((key, h.hexdigest()))
            yield full()

    return ranges.repartition(*KEY).sortWithinPartitions(*KEY, "range").select(*KEY, "ids").mapInArrow(digest, "depth long, x long, y long, ends_sha256 string")


def _owner_of_parent(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv, depth, parent): for (KEY, conv), where KEY is the parent of conv's first own node,
    the parent's owner. The nodes of most children, at most 10,000, are broadcast; of the others
    none has more than a ten thousandth of all nodes, or 64, as children."""
    many = max(64, -(-nodes.count() // 10_000))
    hot = F.broadcast(nodes.where(F.col("n_children") >= many).select(*KEY, F.col("conv_id").alias("parent")))
    cold = nodes.where((F.col("n_children") < many) & (F.col("n_children") > 0)).select(*KEY, F.col("conv_id").alias("parent"))
    found = rows.join(hot, KEY).unionByName(rows.join(hot, KEY, "left_anti").join(cold, KEY))
    return found.select("conv", (F.col("depth") + 1).alias("depth"), "parent")


def prefix_trie(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per node of the trie over (conv_id, turn, role, text), all longs: conv_id (owner),
    depth, parent_conv_id (the parent's owner; root: null), n_convs, n_children, n_leaves,
    saved_tokens (code points that a shared store of the subtree saves) and ends_sha256.

    Null roles and texts are empty. Turns are taken in order, null first; turns of one number,
    and rows that repeat one, each count, in the order of their content's SHA-256. Rows
    without conv_id take no part. Very long texts are digested whole. Other columns are
    ignored, whatever their names. An empty table has no conversations and no root.
    """
    rows, places = prefixes(rebuilt_paths(conversations, block_rows), block_rows)
    first = rows.groupBy(*KEY).agg(F.min(F.struct("conv", "rest")).alias("o"), F.max("len").alias("longest"))
    owners = first.groupBy(F.col("o.conv").alias("conv")).agg(F.min(F.struct("depth", "o.rest")).alias("own"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
    owned = places.join(owners, "conv", "left").select("conv", "blk", F.col("own.depth").alias("d0"), F.col("own.rest").alias("own_rest"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    marked = materialize(rows.join(owned, ["conv", "blk"]).drop("blk"), "owned")

    def total(c: Column) -> Column:
        return F.sum(c).cast("long")

    is_owned = F.coalesce(F.col("depth") >= F.col("d0"), F.lit(False))
    next_owned = F.coalesce((F.col("depth") + 1 >= F.col("d0")) & (F.col("depth") < F.col("len")), F.lit(False))
    nodes = marked.groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"),
        F.count("*").alias("n_convs"),
        total(next_owned.cast("long")).alias("n_children"),
        total(F.col("leaf")).alias("n_leaves"),
        total(F.when(is_owned, F.lit(0)).otherwise(F.col("rest") - F.coalesce("own_rest", F.lit(0)))).alias("saved_tokens"),
    )
    nodes = materialize(nodes, "nodes")
    parents = _owner_of_parent(marked.where("depth = d0 - 1").select(*KEY, "conv"), nodes)
    ends = ends_digests(marked.where("depth = len").select(*KEY, "conv"), min(block_rows, ID_RANGE))
    out = nodes.join(ends, KEY, "left").join(parents.withColumnRenamed("conv", "conv_id"), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie over all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# CRC-32 takes eight steps per character: a bit goes out, and the polynomial in if it was one.
SQL = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, xor(list_reduce(
            flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
            lambda r, v: xor(xor(r, v) >> 1, (xor(r, v) & 1) * 3988292384), 4294967295::BIGINT), 4294967295) AS crc FROM ids),
convs AS (SELECT c, c - c % 100 AS b, crc % 6 AS h FROM crc),
turns AS (SELECT conv_id AS c, length(coalesce(text, '')) AS cp, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS o
    FROM conversations WHERE conv_id IS NOT NULL),
path0 AS (SELECT v.c, 0 AS part, t.o, t.cp, t.s FROM convs v JOIN turns t ON t.c = v.b AND t.o <= v.h
    UNION ALL SELECT v.c, 1, t.o, t.cp, t.s FROM convs v JOIN turns t ON t.c = v.c AND t.o > v.h),
path AS (SELECT c, cp, row_number() OVER w AS depth, sha256(string_agg(s, '') OVER w) AS k FROM path0 WINDOW w AS (PARTITION BY c ORDER BY part, o)
    UNION ALL SELECT c, 0, 0, 'root' FROM convs),
lens AS (SELECT c, max(depth) AS n FROM path GROUP BY c),
nodes AS (SELECT depth, k, min(c) AS owner, count(*) AS n, max(cp) AS cp FROM path GROUP BY depth, k),
up AS (SELECT p.c, p.depth, p.k, lag(p.k) OVER (PARTITION BY p.c ORDER BY p.depth) AS pk FROM path p),
kin AS (SELECT n.depth, n.k, n.owner, n.n, n.cp, u.pk, q.owner AS parent FROM nodes n JOIN up u ON u.c = n.owner AND u.depth = n.depth AND u.k = n.k
    LEFT JOIN nodes q ON q.depth = n.depth - 1 AND q.k = u.pk),
kids AS (SELECT depth - 1 AS depth, pk AS k, count(*) AS n FROM kin WHERE depth > 0 GROUP BY ALL),
below AS (SELECT p.depth, p.k, sum((n.n - 1) * n.cp) AS saved, sum(CASE WHEN kd.n IS NULL THEN 1 ELSE 0 END) AS leaves
    FROM nodes n LEFT JOIN kids kd ON kd.depth = n.depth AND kd.k = n.k JOIN path p ON p.c = n.owner AND p.depth <= n.depth GROUP BY p.depth, p.k),
ends AS (SELECT p.depth, p.k, sha256(string_agg(p.c::VARCHAR, ',' ORDER BY p.c)) AS e FROM path p JOIN lens l ON l.c = p.c AND l.n = p.depth GROUP BY p.depth, p.k)
SELECT n.owner AS conv_id, n.depth, n.parent AS parent_conv_id, n.n AS n_convs, coalesce(kd.n, 0) AS n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens,
    coalesce(e.e, sha256('')) AS ends_sha256
FROM kin n JOIN below b USING (depth, k) LEFT JOIN kids kd USING (depth, k) LEFT JOIN ends e USING (depth, k)
"""
