"""Near-duplicate vectors through a robust-pruned flat graph over overlapping shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann_search import main_length, usable
from .graphs import beam_search, distances, medoid, robust_prune, unseen
from .setjoin import components
from .shared import bounded_sample, materialize

LEAST_COSINE = 0.93
SAMPLE, PER_SHARD, OVERLAP, MOST, DEGREE, BEAM = 20_000, 400, 3, 2000, 32, 32
PROBES, RECALL = 256, 0.98


def fit_centres(nodes: DataFrame, sample: int = SAMPLE, per_shard: int = PER_SHARD) -> dict[int, np.ndarray]:
    """Centres of each label by spherical k-means over a bounded sample of ``sample`` vectors,
    about one for ``per_shard`` vectors of the label and at most one for 10 of its sample."""
    sizes = {r["label"]: r["count"] for r in nodes.groupBy("label").count().collect()}
    rows = pd.DataFrame([r.asDict() for r in bounded_sample(nodes.select("node", "label", "v"), "node", sample)], columns=["node", "label", "v"])
    centres = {}
    for label, part in rows.groupby("label"):
        x = np.stack(part["v"].tolist())
        k = int(max(1, min(-(-sizes[label] // per_shard), max(1, len(x) // 10))))
        c = x[np.random.default_rng(5).permutation(len(x))[:k]]
        for _ in range(8):
            near = (x @ c.T).argmax(1)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            size = np.sqrt((total * total).sum(1, keepdims=True))
            c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
        centres[label] = c
    return centres


def _least_overlap(c: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of rows of x and y, over how many nearest centres both must be dealt to share one."""
    ranks = [np.argsort(np.argsort(-(z @ c.T), 1, kind="stable"), 1, kind="stable") for z in (x, y)]
    return np.maximum(*ranks).min(1) + 1


def overlaps(nodes: DataFrame, centres: dict[int, np.ndarray], cosine: float, sample: int = SAMPLE) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """Over how many nearest centres the nodes of each label are dealt, and for each label
    the links of its probes with all nodes of the label: how many, and how many of them
    share a shard then.

    At most PROBES nodes of a label are held against all of it, and at least OVERLAP
    centres are taken, and as many more as RECALL of the links need. As a label may have
    few links, partners at the very threshold, the hardest to keep, are planted about the
    probes, and RECALL of these must share a shard as well.
    """
    wide = {k: c for k, c in centres.items() if len(c) > OVERLAP}
    if not wide:
        return {}, {}
    rows = pd.DataFrame([r.asDict() for r in bounded_sample(nodes.select("node", "label", "v"), "node", sample)], columns=["node", "label", "v"])
    rng, probes, least = np.random.default_rng(6), {}, {}
    for label, part in rows[rows["label"].isin(list(wide))].groupby("label"):
        x = np.stack(part["v"].tolist()[:PROBES])
        probes[label] = part["node"].to_numpy()[:PROBES], x
        x = np.repeat(x, -(-PROBES // len(x)), 0)
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        size = np.sqrt((away * away).sum(1, keepdims=True))
        y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * away / np.where(size > 1e-9, size, 1)
        least[label] = int(np.quantile(_least_overlap(wide[label], x, y), RECALL, method="higher"))

    def needs(batches):
        for b in batches:
            for label, part in b[b["label"].isin(list(probes))].groupby("label"):
                ids, x = probes[label]
                own = part["node"].to_numpy()
                for a in range(0, len(part), 4096):
                    y = np.stack(part["v"].iloc[a : a + 4096].tolist())
                    r, c = np.nonzero((x @ y.T >= cosine) & (ids[:, None] != own[a : a + 4096]))
                    for s in range(0, len(r), 1024):
                        need = np.bincount(_least_overlap(wide[label], x[r[s : s + 1024]], y[c[s : s + 1024]]))
                        yield pd.DataFrame({"label": label, "need": np.flatnonzero(need), "c": need[need > 0]})

    seen = nodes.select("node", "label", "v").mapInPandas(needs, "label int, need int, c long").groupBy("label", "need").agg(F.sum("c").alias("c")).collect()
    taken, audit = {}, {}
    for label, c in wide.items():
        count = np.zeros(len(c) + 1, np.int64)
        for r in seen:
            if r["label"] == label:
                count[r["need"]] = r["c"]
        total = np.cumsum(count)
        taken[label] = max(OVERLAP, least[label], int(np.argmax(total >= RECALL * total[-1])))
        audit[label] = int(total[-1]), int(total[taken[label]])
    return taken, audit


def deal(nodes: DataFrame, centres: dict[int, np.ndarray], overlap: dict[int, int], most: int = MOST) -> DataFrame:
    """(label, shard, i, j, node, v, weight, homes, part): every node in the shards of as many
    nearest centres as ``overlap`` says for its label. A shard of more than ``most`` nodes is cut into parts by a
    hash, and each pair of parts i <= j is a task, so none grows with the shard and no pair
    is lost."""

    def assign(batches):
        for b in batches:
            homes = []
            for label, v in zip(b["label"], b["v"], strict=True):
                c = centres.get(label)
                homes.append([0] if c is None else np.argsort(-(c @ np.asarray(v)), kind="stable")[: overlap.get(label, OVERLAP)].astype(int).tolist())
            yield b.assign(homes=homes)

    put = nodes.mapInPandas(assign, "node long, label int, v array<double>, weight long, homes array<int>")
    put = materialize(put, "homes").withColumn("shard", F.explode("homes"))
    parts = put.groupBy("label", "shard").agg(F.count("*").alias("size")).select("label", "shard", F.ceil(F.col("size") / most).cast("int").alias("parts"))
    put = put.join(parts, ["label", "shard"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(9)), "parts").cast("int"))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return put.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other", "parts")


def _local_graph(rows: pd.DataFrame) -> pd.DataFrame:
    """Adjacency lists of a shard's nodes: the nearest, robustly pruned, and half of the
    degree for the plainly nearest, which ties tight groups together."""
    rows = rows.sort_values("node").reset_index(drop=True)
    x = np.stack(rows["v"].tolist()).astype(np.float32)
    norms, ids = np.einsum("ij,ij->i", x, x), rows["node"].to_numpy()
    lists = []
    for a in range(0, len(x), 512):
        points = np.arange(a, min(a + 512, len(x)))
        d = norms[points, None] + norms[None] - 2 * x[points] @ x.T
        width = min(len(x), 3 * DEGREE)
        near = np.argpartition(d, width - 1, 1)[:, :width].astype(np.int32)
        own = np.take_along_axis(d, near, 1)
        kept = robust_prune(x, norms, points, near, own, DEGREE // 2, 1.2)
        close = np.take_along_axis(near, np.argsort(own, 1)[:, : DEGREE // 2], 1)
        lists += [ids[np.unique(r[r >= 0])].tolist() for r in np.concatenate([kept, close], 1)]
    return pd.DataFrame({"node": ids, "nbrs": lists})


def _exact_pairs(x: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """Pairs (as a * n + b) of left and right nodes that link, by blocked products in double precision."""
    out = [np.zeros(0, np.int64)]
    for s in range(0, len(left), 512):
        a = left[s : s + 512]
        r, c = np.nonzero(x[a] @ x[right].T >= cosine)
        out.append(a[r].astype(np.int64) * len(x) + right[c])
    pairs = np.concatenate(out)
    return pairs[pairs // len(x) != pairs % len(x)]


def _find(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of one task: per node the weight it links with here, and a forest of links.

    Inside a part the graph is searched, and an audit holds all of its nodes against one
    another: a part has about MOST nodes, so no sample has to stand for it, and what the
    search let go is added. Two parts of a shard have no edges between them: their pairs
    come from the product alone. ``probed`` and ``hit`` count the pairs of the audit and
    those of them that the search found.
    """
    rows = rows.sort_values("node").reset_index(drop=True)
    exact = np.stack(rows["v"].tolist())
    ids, n = rows["node"].to_numpy(), len(rows)
    part, shard = rows["part"].to_numpy(), rows["shard"].iloc[0]
    i, j = rows["i"].iloc[0], rows["j"].iloc[0]
    probed = hit = 0
    if i == j:
        everyone = np.arange(n)
        pairs = _exact_pairs(exact, everyone, everyone, cosine)
        found = _graph_pairs(exact.astype(np.float32), ids, rows["nbrs"], cosine)
        probed, hit = len(pairs), int(np.isin(pairs, found).sum())
        pairs = np.concatenate([pairs, found])
    else:
        pairs = _exact_pairs(exact, np.flatnonzero(part == i), np.flatnonzero(part == j), cosine)
    p, q = pairs // n, pairs % n
    p, q = np.minimum(p, q), np.maximum(p, q)
    once = np.unique(p * n + q)
    p, q = once // n, once % n
    ok = np.empty(len(p), bool)
    for a in range(0, len(p), 1 << 17):
        s = slice(a, a + (1 << 17))
        ok[s] = np.einsum("ij,ij->i", exact[p[s]], exact[q[s]]) >= cosine
    p, q = p[ok], q[ok]
    # a pair belongs to the first shard that both share, and there to the task of its parts:
    # every task that has both of a pair finds it, so none is lost by counting it once
    homes = np.stack(rows["homes"].tolist())  # a label's nodes are all dealt to as many shards
    first = np.full(len(p), 1 << 30)
    for k in range(homes.shape[1]):
        own = homes[p, k]
        shared = (homes[q] == own[:, None]).any(1)
        first = np.where(shared, np.minimum(first, own), first)
    mine = (first == shard) & (np.minimum(part[p], part[q]) == i) & (np.maximum(part[p], part[q]) == j)
    p, q = p[mine], q[mine]
    weight = rows["weight"].to_numpy()
    links = np.bincount(p, weight[q], n) + np.bincount(q, weight[p], n)
    root = np.arange(n)
    while True:  # least reachable node by halving: a forest of at most n links stands for the pairs
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, root[p], low)
        np.minimum.at(new, root[q], low)
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = (links > 0) | (root != np.arange(n))
    return pd.DataFrame({"node": ids[some], "links": links[some].astype(np.int64), "root": ids[root[some]], "probed": probed, "hit": hit})


def _graph_pairs(x: np.ndarray, ids: np.ndarray, nbrs: pd.Series, cosine: float) -> np.ndarray:
    """Pairs (as a * n + b) that a search of the graph finds about within reach."""
    norms = np.einsum("ij,ij->i", x, x)
    at = {k: i for i, k in enumerate(ids.tolist())}
    lists = [[at[k] for k in to if k in at] for to in nbrs]
    graph = np.full((len(x), max(1, max(map(len, lists)))), -1, np.int32)
    for k, to in enumerate(lists):
        graph[k, : len(to)] = to
    return _range_search(x, norms, graph, medoid(x), np.float32(2 - 2 * cosine + 1e-4), BEAM)


def _range_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: int, reach: float, width: int) -> np.ndarray:
    """Pairs (as query * n + node) within reach: a greedy search from the medoid and the
    query's own neighbours, then all neighbours of nodes within reach, until none is new."""
    n, out = len(x), []
    # for the spread within reach, links count in both directions: a node that is on nobody's list is found
    p, k = np.nonzero(graph >= 0)
    q = graph[p, k]
    both = np.unique(np.concatenate([p * n + q, q.astype(np.int64) * n + p]))
    ends, degree = both % n, np.bincount(both // n, minlength=n)
    start = np.cumsum(degree) - degree
    for a in range(0, n, 512):
        q = np.arange(a, min(a + 512, n))
        ids, dist, _ = beam_search(x, norms, graph, entry, x[q], min(width, n), also=graph[q])
        r, c = np.nonzero((dist <= reach) & (ids >= 0))
        # what the beam saw and let go may be within reach too: the spread looks at it again
        seen = np.zeros((len(q), n), bool)
        row, node = unseen(seen, r, ids[r, c].astype(np.int64))
        within = [(row, node)]
        while len(row):
            times = degree[node]
            step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            row, node = unseen(seen, np.repeat(row, times), ends[np.repeat(start[node], times) + step])
            ok = distances(x, norms, x[q], norms[q], row, node) <= reach
            row, node = row[ok], node[ok]
            within.append((row, node))
        row, node = (np.concatenate([w[k] for w in within]) for k in (0, 1))
        key = (row + a) * n + node
        out.append(key[row + a != node])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def near_duplicates(vectors: DataFrame, cosine: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, zero, of another length than most have or with null or non-finite
    components, and rows without a label, link with nothing. Equal vectors of a label are one node with a weight and link
    with one another; a row that repeats a vec_id counts as a vector of its own. A null
    vec_id is a row with null ids. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>"))
    good = F.col("label").isNotNull() & usable("embedding") & F.col("vec_id").isNotNull() & (F.size("embedding") == main_length(rows, "embedding"))
    nodes = rows.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    # a vec_id may stand for several vectors: nodes are told apart by their content
    nodes = nodes.withColumn("node", F.xxhash64("label", "embedding", "first"))
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, c: s + c * c))
    nodes = materialize(nodes.select("node", "label", "embedding", "first", "weight", F.transform("embedding", lambda c: c / size).alias("v")), "nodes")
    centres = fit_centres(nodes)
    tasks = materialize(deal(nodes.select("node", "label", "v", "weight"), centres, overlaps(nodes, centres, cosine)[0]), "tasks")
    key = ["label", "shard", "i", "j"]
    local = tasks.where("i = j").groupBy(*key).applyInPandas(_local_graph, "node long, nbrs array<long>")
    flat = local.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))
    flat = materialize(flat, "flat-graph")
    schema = "node long, links long, root long, probed long, hit long"
    inside = tasks.where("i = j").join(flat, "node").groupBy(*key).applyInPandas(lambda d: _find(d, cosine), schema)
    found = inside.unionByName(tasks.where("i < j").groupBy(*key).applyInPandas(lambda d: _find(d, cosine), schema))
    found = materialize(found, "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.join(links, "node", "left").join(roots.withColumnRenamed("cid", "node"), "node", "left")
    named = materialize(named.select("label", "embedding", "weight", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("label", "embedding", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = rows.where(good).join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
