"""Nearest neighbours by inner product through robust-pruned graphs of shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graphs import beam_search, build
from .shared import materialize

SHARD, BLOCK = 3000, 4096


def usable(vector: str) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda c: c != 0)


def main_length(vectors: DataFrame, vector: str) -> int:
    """The most frequent length of usable vectors, the shorter of two; 0 without any."""
    most = vectors.where(usable(vector)).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").head()
    return most["d"] if most else 0


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values]) if len(values) else np.zeros((0, 0))


def build_shards(vectors: DataFrame, shard_rows: int = SHARD, degree: int = 40, width: int = 80) -> DataFrame:
    """(shard, row, vec_id, embedding, node, entry, nbrs) of all usable vectors, written out.

    Shards hold about ``shard_rows`` vectors, dealt by a hash of vec_id. Inner products become
    distances by one more component, which brings all vectors to one length. Equal vectors
    of a shard are one node; every row has a number of its own, so rows that repeat a vec_id each count.
    Rows without vec_id, and vectors of another length than most have, take no part; other
    columns are ignored, and an empty table has no shards.
    """
    fits = F.col("vec_id").isNotNull() & usable("embedding") & (F.size("embedding") == main_length(vectors, "embedding"))
    good = vectors.where(fits).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    good = materialize(good, "vectors")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, c: s + c * c)
    n, most = good.agg(F.count("*"), F.max(square)).head()
    shards = max(1, -(-n // shard_rows))
    top = most or 0.0

    def graph(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["vec_id", "row"]).reset_index(drop=True)
        x = _matrix(rows["embedding"])
        nodes, node = np.unique(x, axis=0, return_inverse=True)
        node = node.ravel()
        far = np.sqrt(np.maximum(top - (nodes * nodes).sum(1), 0))
        links, entry = build(np.column_stack([nodes, far]).astype(np.float32), degree, width)
        first = np.zeros(len(rows), bool)
        first[np.unique(node, return_index=True)[1]] = True
        return pd.DataFrame({"shard": rows["shard"], "row": rows["row"], "vec_id": rows["vec_id"], "embedding": rows["embedding"], "node": node, "entry": entry, "nbrs": [links[k][links[k] >= 0].tolist() if f else [] for k, f in zip(node, first, strict=True)]})

    dealt = good.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return materialize(dealt.groupBy("shard").applyInPandas(graph, "shard int, row long, vec_id long, embedding array<double>, node int, entry int, nbrs array<int>"), "graphs")


def search(graphs: DataFrame, query_where: Column, k: int = 20, width: int = 80, block_rows: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each member of the graphs that is a query, the k
    others of largest inner product that beam searches of all shards find.

    Queries go in blocks of about ``block_rows``, each with every shard, so a task holds one
    shard and one block. Of equal vectors the least vec_ids count. A row is no candidate of its own;
    others of its vec_id are, and each row of a repeated query id has its k.
    """
    queries = graphs.where(query_where)
    blocks = max(1, -(-queries.count() // block_rows))
    last = graphs.agg(F.max("shard")).head()[0] or 0
    block = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).cast("int")
    members = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("ask", F.lit(False))
    asked = queries.drop("shard").withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))
    asked = asked.withColumn("ask", F.lit(True)).withColumn("nbrs", F.array().cast("array<int>"))

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"asked": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        own, ask = rows[~rows["ask"]], rows[rows["ask"]]
        if not len(own) or not len(ask):
            return none
        own = own.sort_values(["node", "vec_id", "row"]).reset_index(drop=True)
        x, q, ids, places = _matrix(own["embedding"]), _matrix(ask["embedding"]), own["vec_id"].to_numpy(), own["row"].to_numpy()
        node = own["node"].to_numpy()
        begin = np.flatnonzero(np.diff(node, prepend=-1))
        count = np.diff(np.append(begin, len(node)))
        lists = own.loc[own["nbrs"].map(len) > 0].set_index("node")["nbrs"]
        links = np.full((len(begin), max(map(len, lists), default=1)), -1, np.int32)
        for i, to in lists.items():
            links[i, : len(to)] = to
        length = (x * x).sum(1)
        far = np.sqrt(np.maximum(length.max() - length[begin], 0))
        z = np.column_stack([x[begin], far]).astype(np.float32)
        norms = np.einsum("ij,ij->i", z, z)
        out = []
        for a in range(0, len(q), 512):
            part, who, asked_by = q[a : a + 512], ask["vec_id"].to_numpy()[a : a + 512], ask["row"].to_numpy()[a : a + 512]
            beam, _, _ = beam_search(z, norms, links, int(own["entry"].iloc[0]), np.column_stack([part, np.zeros(len(part))]).astype(np.float32), min(width, max(len(z), k)))
            r, c = np.nonzero(beam >= 0)
            found = beam[r, c]
            times = np.minimum(count[found], k + 1)  # the least vec_ids of a node's equal vectors
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, at = np.repeat(r, times), np.repeat(begin[found], times) + step
            ok = places[at] != asked_by[row]
            row, at = row[ok], at[ok]
            score = np.einsum("ij,ij->i", x[at], part[row])
            order = np.lexsort((ids[at], -score, row))
            row, at, score = row[order], at[order], score[order]
            n = np.bincount(row, minlength=len(part))
            rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            keep = rank < k
            out.append(pd.DataFrame({"asked": asked_by[row[keep]], "query_id": who[row[keep]], "vec_id": ids[at[keep]], "score": score[keep]}))
        return pd.concat(out) if out else none

    found = members.unionByName(asked).groupBy("shard", "block").applyInPandas(find, "asked long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = build_shards(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(graphs, F.col("vec_id") % 20 == 0)
