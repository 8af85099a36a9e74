"""Hierarchical navigable small-world graph of one shard, in flat neighbour arrays, built and searched for whole batches in lockstep.

Nodes come ordered by level, highest first, and are inserted in that order. So what a level holds is the graph as it stood when its last node was in:
the levels are snapshots of one growing neighbour array, and the array of the bottom level is the whole graph.
"""

from __future__ import annotations

import numpy as np

LINKS = 20
EF_BUILD, EF_UPPER, EF_SEARCH = 48, 24, 56
#: Each level keeps one node in so many of the level below; the top is scanned whole.
RATIO = 4
TOP = 96
BATCH = 512


def level_order(ids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """A permutation of the nodes, highest level first by a hash of the id, and the sizes of the levels from the top down to all."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    sizes, n = [], len(ids)
    while n > TOP:
        sizes.append(n)
        n = -(-n // RATIO)
    return np.argsort(x ^ x >> np.uint64(29), kind="stable"), [*reversed([*sizes, n])]


def _descend(v: np.ndarray, q: np.ndarray, levels: list[tuple[int, np.ndarray | None]], ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities (queries, <= ef), best first, -1 where there are none."""
    n_top = levels[0][0]
    sims = q @ v[:n_top].T
    take = min(n_top, ef if len(levels) == 1 else EF_UPPER)
    ids = np.argsort(-sims, axis=1, kind="stable")[:, :take]
    best = np.take_along_axis(sims, ids, 1)
    for k, (n, links) in enumerate(levels[1:], 1):
        ids, best = _beam(v, q, links, n, ids, best, ef if k == len(levels) - 1 else EF_UPPER)
    return ids, best


def _beam(v: np.ndarray, q: np.ndarray, links: np.ndarray, n: int, start: np.ndarray, best: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    rows = len(q)
    ids = np.full((rows, ef), -1, np.int32)
    sims = np.full((rows, ef), -np.inf, np.float32)
    done = np.ones((rows, ef), bool)
    k = min(ef, start.shape[1])
    ids[:, :k], sims[:, :k] = start[:, :k], best[:, :k]
    done[:, :k] = start[:, :k] < 0
    seen = np.zeros((rows, n), bool)
    r, c = np.nonzero(ids >= 0)
    seen[r, ids[r, c]] = True
    active = np.arange(rows)
    while len(active):
        # The best two that were not expanded yet, of every query that has one.
        order = np.where(done[active], -np.inf, sims[active])
        two = np.argpartition(-order, 1, axis=1)[:, :2] if ef > 2 else np.argsort(-order, axis=1)[:, :2]
        open_ = np.take_along_axis(order, two, 1) > -np.inf
        keep = open_.any(1)
        active, two, open_ = active[keep], two[keep], open_[keep]
        if not len(active):
            break
        done[active[:, None], two] = True
        at = np.where(open_, ids[active[:, None], two], -1)
        near = np.where(at[:, :, None] >= 0, links[np.maximum(at, 0)], -1).reshape(len(active), -1)
        i, j = np.nonzero(near >= 0)
        row, node = active[i], near[i, j]
        new = ~seen[row, node]
        row, node, i = row[new], node[new], i[new]
        if not len(row):
            continue
        _, first = np.unique(row.astype(np.int64) * n + node, return_index=True)  # both expanded nodes may link to it
        row, node, i = row[first], node[first], i[first]
        seen[row, node] = True
        s = np.einsum("ij,ij->i", q[row], v[node])
        better = s > sims[row].min(1)
        row, node, i, s = row[better], node[better], i[better], s[better]
        if not len(row):
            continue
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        width = np.diff(np.r_[starts, len(row)])
        place = np.arange(len(row)) - np.repeat(starts, width)
        own = row[starts]
        more_ids = np.full((len(own), width.max()), -1, np.int32)
        more_sims = np.full(more_ids.shape, -np.inf, np.float32)
        at = np.repeat(np.arange(len(own)), width)
        more_ids[at, place], more_sims[at, place] = node, s
        all_sims = np.concatenate([sims[own], more_sims], 1)
        pick = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        sims[own] = np.take_along_axis(all_sims, pick, 1)
        ids[own] = np.take_along_axis(np.concatenate([ids[own], more_ids], 1), pick, 1)
        done[own] = np.take_along_axis(np.concatenate([done[own], more_ids < 0], 1), pick, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _choose(v: np.ndarray, cand: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
    """For each row the `links` candidates to link to: first those closer to it than to any chosen before, then the closest of the rest."""
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    rows, width = cand.shape
    if width <= links:
        return np.pad(cand, ((0, 0), (0, links - width)), constant_values=-1)
    x = v[np.maximum(cand, 0)]
    pair = x @ x.transpose(0, 2, 1)
    chosen = np.zeros((rows, width), bool)
    nearest = np.full((rows, width), -np.inf, np.float32)  # similarity to the closest chosen
    for j in range(width):
        take = (cand[:, j] >= 0) & (sims[:, j] > nearest[:, j]) & (chosen.sum(1) < links)
        chosen[:, j] = take
        nearest = np.where(take[:, None], np.maximum(nearest, pair[:, j]), nearest)
    rank = np.where(cand < 0, 3 * width, np.where(chosen, 0, width) + np.arange(width))
    first = np.argsort(rank, axis=1, kind="stable")[:, :links]
    return np.take_along_axis(cand, first, 1)


class Graph:
    """vectors: unit length, in the order of level_order; sizes: of its levels."""

    def __init__(self, vectors: np.ndarray, sizes: list[int]):
        self.v, self.sizes = vectors, sizes
        n = len(vectors)
        links = np.full((n, LINKS), -1, np.int32)
        self.levels: list[tuple[int, np.ndarray | None]] = [(sizes[0], None)]
        if n > 1:
            first = sizes[0]
            s = vectors[:first] @ vectors[:first].T
            np.fill_diagonal(s, -np.inf)
            cand = np.argsort(-s, axis=1, kind="stable")[:, : first - 1].astype(np.int32)
            links[:first] = _choose(vectors, cand, np.take_along_axis(s, cand.astype(np.int64), 1), LINKS)
        at = sizes[0]
        for size in sizes[1:]:
            while at < size:
                end = min(size, at + min(BATCH, at))
                self._insert(links, at, end)
                at = end
            self.levels.append((size, links[:size].copy()))

    def _insert(self, links: np.ndarray, a: int, b: int) -> None:
        v, q = self.v, self.v[a:b]
        levels = [*self.levels, (a, links)] if a > self.levels[-1][0] or self.levels[-1][1] is None else self.levels
        ids, sims = _descend(v, q, levels, EF_BUILD)
        mates = q @ q.T
        np.fill_diagonal(mates, -np.inf)
        k = min(LINKS, b - a - 1)
        if k > 0:
            near = np.argpartition(-mates, k - 1, axis=1)[:, :k]
            ids = np.concatenate([ids, (near + a).astype(np.int32)], 1)
            sims = np.concatenate([sims, np.take_along_axis(mates, near, 1)], 1)
        links[a:b] = _choose(v, ids.astype(np.int32), sims, LINKS)
        # Back links: each target takes the newcomers that chose it, and drops what is beyond its room.
        source = np.repeat(np.arange(a, b), LINKS)
        target = links[a:b].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        starts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        width = np.diff(np.r_[starts, len(target)])
        own = target[starts]
        for lo in range(0, len(own), 2048):
            o, w, s0 = own[lo : lo + 2048], width[lo : lo + 2048], starts[lo : lo + 2048]
            more = np.full((len(o), min(int(w.max()), 3 * LINKS)), -1, np.int32)
            for j in range(more.shape[1]):
                has = w > j
                more[has, j] = source[s0[has] + j]
            # A batch mate may have chosen the target and been chosen by it.
            more = np.where((more[:, :, None] == links[o][:, None, :]).any(2), -1, more)
            cand = np.concatenate([links[o], more], 1)
            sim = np.where(cand >= 0, np.einsum("ijk,ik->ij", v[np.maximum(cand, 0)], v[o]), -np.inf)
            links[o] = _choose(v, cand, sim, LINKS)

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities (queries, <= k), best first; -1 where there are fewer."""
        ids, sims = [], []
        for i in range(0, len(q), BATCH):
            a, s = _descend(self.v, q[i : i + BATCH], self.levels, max(ef, k))
            ids.append(a[:, :k])
            sims.append(s[:, :k])
        return np.concatenate(ids), np.concatenate(sims)
