"""Pruned proximity graphs over the vectors of one shard, for many queries at once.

Distances are squared Euclidean ones in single precision; what a search finds is measured
again in double precision by its caller.
"""

from __future__ import annotations

import numpy as np


def distances(x: np.ndarray, norms: np.ndarray, q: np.ndarray, qn: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Between q[rows[i]] and x[ids[i]]."""
    out = np.empty(len(ids), np.float32)
    for a in range(0, len(ids), 1 << 17):
        r, i = rows[a : a + (1 << 17)], ids[a : a + (1 << 17)]
        out[a : a + len(i)] = norms[i] + qn[r] - 2 * np.einsum("ij,ij->i", x[i], q[r])
    return out


def robust_prune(x: np.ndarray, norms: np.ndarray, points: np.ndarray, cand: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours (-1: none) of each point out of its candidates cand (-1: none), ``dist`` away.

    The nearest candidate is kept and all others that are alpha times closer to it than to
    the point go, until none is left or the degree is reached. alpha is for plain distances.
    """
    n, width = cand.shape
    dist = np.where((cand < 0) | (cand == points[:, None]), np.inf, dist)
    order = np.argsort(dist, 1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    out = np.full((n, degree), -1, np.int32)
    safe = np.maximum(cand, 0)
    v = x[safe]
    between = norms[safe][:, :, None] + norms[safe][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive = np.isfinite(dist)
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    rows = np.arange(n)
    for k in range(degree):
        best = alive.argmax(1)
        ok = alive[rows, best]
        if not ok.any():
            break
        out[ok, k] = cand[rows, best][ok]
        alive &= ~((alpha * alpha * between[rows, best] <= dist) & ok[:, None])
        alive[rows, best] = False
    return out


def unseen(seen: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of rows and ids that are not yet marked in ``seen``, in order; marks
    them."""
    new = np.zeros(seen.shape, bool)
    new[rows, ids] = True
    new &= ~seen
    np.logical_or(seen, new, out=seen)
    return np.nonzero(new)


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, width: int, expand: int = 4, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy search from ``entry`` (and each query's ids in ``also``) with a beam of ``width``.

    Returns the beam's ids (-1: none), distances, ascending, and which nodes each query saw.
    """
    nq, n = len(q), len(x)
    qn = np.einsum("ij,ij->i", q, q)
    seen = np.zeros((nq, n), bool)
    ids, dist = np.full((nq, width), -1, np.int32), np.full((nq, width), np.inf, np.float32)
    done = np.zeros((nq, width), bool)
    rows = np.arange(nq)
    first = np.full((nq, 1), entry) if also is None else np.concatenate([np.full((nq, 1), entry), also], 1)
    todo, nbr = np.repeat(rows, first.shape[1]), first.ravel()
    while True:
        ok = nbr >= 0
        todo, nbr = todo[ok], nbr[ok]
        r, i = unseen(seen, todo, nbr)
        if len(r):
            d = distances(x, norms, q, qn, r, i)
            count = np.bincount(r, minlength=nq)
            col = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            new_ids, new_d = np.full((nq, count.max()), -1, np.int32), np.full((nq, count.max()), np.inf, np.float32)
            new_ids[r, col], new_d[r, col] = i, d
            all_ids, all_d = np.concatenate([ids, new_ids], 1), np.concatenate([dist, new_d], 1)
            all_done = np.concatenate([done, np.zeros(new_ids.shape, bool)], 1)
            keep = np.argpartition(all_d, width - 1, 1)[:, :width]
            keep = np.take_along_axis(keep, np.argsort(np.take_along_axis(all_d, keep, 1), 1), 1)
            ids, dist, done = (np.take_along_axis(a, keep, 1) for a in (all_ids, all_d, all_done))
        open_ = ~done & (ids >= 0)
        turn = np.cumsum(open_, 1)
        pick = open_ & (turn <= expand)
        if not pick.any():
            return ids, dist, seen
        done |= pick
        r, c = np.nonzero(pick)
        todo, nbr = np.repeat(r, graph.shape[1]), graph[ids[r, c]].ravel()


def medoid(x: np.ndarray) -> int:
    return int(((x - x.mean(0)) ** 2).sum(1).argmin())


def build(x: np.ndarray, degree: int = 40, width: int = 80, alpha: float = 1.2, seed: int = 3) -> tuple[np.ndarray, int]:
    """A directed graph and its entry. Points enter in batches that grow: a greedy search over
    the graph so far proposes neighbours, pruning keeps diverse ones, and the neighbours take
    the point up in return, pruned again where they get too many."""
    n = len(x)
    norms = np.einsum("ij,ij->i", x, x)
    graph = np.full((n, degree), -1, np.int32)
    entry = medoid(x)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        size = max(8, min(at, 512))
        batch = order[at : at + size]
        at += size
        ids, dist, _ = beam_search(x, norms, graph, entry, x[batch], width)
        if len(batch) < 64 or at < 4096:  # members of a batch may be near each other
            mates = np.broadcast_to(batch, (len(batch), len(batch)))
            r = np.repeat(np.arange(len(batch)), len(batch))
            own = distances(x, norms, x[batch], norms[batch], r, mates.ravel()).reshape(mates.shape)
            few = np.argsort(own, 1)[:, : min(len(batch), 32)]
            ids = np.concatenate([ids, np.take_along_axis(mates, few, 1).astype(np.int32)], 1)
            dist = np.concatenate([dist, np.take_along_axis(own, few, 1)], 1)
        graph[batch] = robust_prune(x, norms, batch, ids, dist, degree, alpha)
        src, tgt = np.repeat(batch, degree), graph[batch].ravel()
        ok = tgt >= 0
        _take_back(x, norms, graph, src[ok], tgt[ok], degree, alpha)
    return graph, entry


def _take_back(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, src: np.ndarray, tgt: np.ndarray, degree: int, alpha: float) -> None:
    """Adds the edges tgt -> src, and prunes the lists that overflow."""
    order = np.argsort(tgt, kind="stable")
    src, tgt = src[order], tgt[order]
    who, begin, count = np.unique(tgt, return_index=True, return_counts=True)
    for a in range(0, len(who), 256):
        w, b, c = who[a : a + 256], begin[a : a + 256], count[a : a + 256]
        more = np.full((len(w), int(c.max())), -1, np.int32)
        r = np.repeat(np.arange(len(w)), c)
        col = np.arange(len(r)) - np.repeat(np.cumsum(c) - c, c)
        more[r, col] = src[np.repeat(b, c) + col]
        both = np.concatenate([graph[w], more], 1)
        both[both == w[:, None]] = -1
        both = np.sort(both, 1)[:, ::-1]
        both[:, 1:][(both[:, 1:] == both[:, :-1])] = -1
        have = (both >= 0).sum(1)
        fits = have <= degree
        tight = np.sort(both[fits], 1)[:, ::-1][:, :degree]
        graph[w[fits], : tight.shape[1]] = tight
        graph[w[fits], tight.shape[1] :] = -1
        if (~fits).any():
            big, own = both[~fits], w[~fits]
            rr = np.repeat(np.arange(len(own)), big.shape[1])
            safe = np.maximum(big, 0)
            d = distances(x, norms, x[own], norms[own], rr, safe.ravel()).reshape(big.shape)
            d = np.where(big < 0, np.inf, d)
            near = np.argsort(d, 1)[:, : 4 * degree]
            graph[own] = robust_prune(x, norms, own, np.take_along_axis(big, near, 1), np.take_along_axis(d, near, 1), degree, alpha)
