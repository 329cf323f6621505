"""Numpy kernels of proximity graphs: pruning, search and build within one shard, many queries at a time.

Vectors are a float64 matrix; a graph is an int32 matrix of neighbours by position, -1 where a node has fewer. Order
is always (distance, position), and positions follow ids, so every result is the same however queries are batched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Passes of a prune; distances are squares in l2, and so is the factor.
ALPHAS = (1.0, 1.2)
#: A node may have so many times its degree before it is pruned again.
SLACK = 1.3
#: Queries that are walked together; marks that a batch may take, and distances within the pools that are pruned together.
TOGETHER, MOST_NUMBERS, MOST_BETWEEN = 256, 1 << 24, 1 << 22


def prepared(metric: str, vectors: np.ndarray) -> np.ndarray:
    """Vectors that distance() takes: of length one for cosine, zero staying zero."""
    vectors = np.asarray(vectors, float)
    if metric != "cosine":
        return vectors
    norms = np.sqrt((vectors * vectors).sum(-1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def distance(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the last axes of two prepared arrays; the smallest is the nearest."""
    if metric in ("ip", "cosine"):
        dot = (a * b).sum(-1)
        return -dot if metric == "ip" else 1 - np.clip(dot, -1, 1)
    diff = a - b
    return np.abs(diff).sum(-1) if metric == "l1" else (diff * diff).sum(-1)


def _among(metric: str, x: np.ndarray) -> np.ndarray:
    """Distances between all rows of each matrix of a stack."""
    if metric == "l1":
        return np.abs(x[:, :, None] - x[:, None]).sum(-1)
    dots = x @ x.transpose(0, 2, 1)
    if metric == "ip":
        return -dots
    if metric == "cosine":
        return 1 - np.clip(dots, -1, 1)
    norms = np.einsum("bpd,bpd->bp", x, x)
    found = np.maximum(norms[:, :, None] + norms[:, None] - 2 * dots, 0)
    found[found < 1e-12 * (1 + norms[:, :, None])] = 0  # of equal rows, whose difference is rounding
    return found


def prune(pools: np.ndarray, distances: np.ndarray, vectors: np.ndarray, degree: int, metric: str = "l2", alphas: tuple[float, ...] = ALPHAS, fill: bool = False, covers: np.ndarray | None = None) -> np.ndarray:
    """Robust pruning of many pools at once. pools: positions in order of distance, -1 after the last. A candidate
    goes if a chosen one is nearer to it, by the factor alpha, than the node is; each larger alpha gives dropped ones
    another chance. fill: what is missing to the degree comes from the pool's start. covers[q, i, t]: whether
    candidate i may drop t, as it has all of t's labels."""
    n, width = pools.shape
    out, count = np.full((n, degree), -1, np.int32), np.zeros(n, np.int64)
    if not n or not width:
        return out
    worst = np.where(pools >= 0, 0.0, np.inf)
    between = _among(metric, vectors[np.maximum(pools, 0)])
    rows, chosen = np.arange(n), np.zeros(pools.shape, bool)
    for alpha in alphas:
        while True:
            free = (worst <= alpha) & (count < degree)[:, None]
            some = free.any(1)
            if not some.any():
                break
            q = rows[some]
            i = free[some].argmax(1)
            out[q, count[q]] = pools[q, i]
            count[q] += 1
            chosen[q, i], worst[q, i] = True, np.inf
            djk = between[q, i]
            if metric == "ip":
                factor = np.where(-djk > alpha * -distances[q], alpha + 0.01, 0.0)
            else:
                with np.errstate(divide="ignore", invalid="ignore"):
                    factor = np.where(djk <= 0, np.inf, distances[q] / djk)
            if covers is not None:
                factor = np.where(covers[q, i], factor, 0.0)
            later = np.arange(width) > i[:, None]
            worst[q] = np.where(later, np.maximum(worst[q], factor), worst[q])
    if fill:
        for q in np.flatnonzero(count < degree):
            more = pools[q][(pools[q] >= 0) & ~chosen[q]][: degree - count[q]]
            out[q, count[q] : count[q] + len(more)] = more
    return out


def prune_once(pool: np.ndarray, distances: np.ndarray, vectors: np.ndarray, degree: int, metric: str = "l2", alpha: float = 1.2) -> list[int]:
    """The single-pass rule: the nearest candidate is chosen, then all those go that are as far from the node as
    alpha times their distance from it, and so on."""
    left, out = np.arange(len(pool)), []
    while len(left) and len(out) < degree:
        best, left = left[0], left[1:]
        out.append(int(pool[best]))
        left = left[distances[left] < alpha * distance(metric, vectors[pool[left]], vectors[pool[best]])]
    return out


@dataclass
class Found:
    """Of each query: positions and distances of the best, nearest first (-1 and inf after the last), how many rounds
    and how many distances it took, and, if asked for, what was expanded (position, distance) by (query, ...)."""

    positions: np.ndarray
    distances: np.ndarray
    hops: np.ndarray
    compared: np.ndarray
    expanded: list[np.ndarray] = field(default_factory=list)


def _ordered(distances: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """np.lexsort((positions, distances), axis=1); both keys are sorted only where finite distances tie."""
    order = np.argsort(distances, axis=1)
    d = np.take_along_axis(distances, order, 1)
    tied = ((d[:, 1:] == d[:, :-1]) & np.isfinite(d[:, 1:])).any(1)
    if tied.any():
        order[tied] = np.lexsort((positions[tied], distances[tied]), axis=1)
    return order


def walk(graph: np.ndarray, vectors: np.ndarray, queries: np.ndarray, starts: np.ndarray, width: int, metric: str = "l2", beam: int = 1, allowed: np.ndarray | None = None, score=None, most_hops: int | None = None, keep: bool = False) -> Found:
    """Best-first search to a fixed point, all queries side by side: each round expands every query's beam nearest
    candidates that are not expanded yet. starts: positions by query (-1 for none). allowed: which points each
    query may meet. score(query numbers, positions): what orders candidates, if not the distance. most_hops: expansions
    a query at most."""
    n, total = len(queries), len(vectors)
    if score is None:
        score = lambda q, p: distance(metric, queries[q][:, None], vectors[p])
    seen = np.zeros((n, total + 1), bool)
    seen[:, total] = True  # where -1 points to
    if allowed is not None:
        seen[:, :total] |= ~allowed
    best, near, done = np.full((n, width), -1, np.int64), np.full((n, width), np.inf), np.ones((n, width), bool)
    hops, compared = np.zeros(n, np.int64), np.zeros(n, np.int64)
    trail: list[list] = [[] for _ in range(n)] if keep else []
    every = np.arange(n)

    def offer(q: np.ndarray, found: np.ndarray) -> None:
        """found: positions by query, -1 for none."""
        place = np.where(found < 0, total, found)
        place = np.sort(place, 1)
        new = ~seen[q[:, None], place]
        new[:, 1:] &= place[:, 1:] != place[:, :-1]
        wide = int(new.sum(1).max(initial=0))
        if not wide:
            return
        order = np.argsort(~new, 1, kind="stable")[:, :wide]
        place, new = np.take_along_axis(place, order, 1), np.take_along_axis(new, order, 1)
        place = np.where(new, place, total)
        seen[q[:, None], place] = True
        compared[q] += new.sum(1)
        d = np.where(new, score(q, np.where(new, place, 0)), np.inf)
        both = np.concatenate([best[q], np.where(new, place, -1)], 1)
        all_d = np.concatenate([near[q], d], 1)
        all_done = np.concatenate([done[q], ~new], 1)
        order = _ordered(all_d, both)[:, :width]
        best[q], near[q], done[q] = (np.take_along_axis(x, order, 1) for x in (both, all_d, all_done))

    offer(every, starts)
    while True:
        open_ = ~done & (best >= 0)
        if most_hops is not None:
            open_ &= (hops < most_hops)[:, None]
        q = every[open_.any(1)]
        if not len(q):
            break
        here = open_[q]
        rank = np.cumsum(here, 1)
        take = here & (rank <= beam)
        if most_hops is not None:
            take &= rank <= (most_hops - hops[q])[:, None]
        hops[q] += take.sum(1)
        at = np.argsort(~take, 1, kind="stable")[:, : int(take.sum(1).max())]
        some = np.take_along_axis(take, at, 1)
        nodes = np.where(some, np.take_along_axis(best[q], at, 1), -1)
        done[q] |= take
        if keep:
            for i, row in zip(q.tolist(), nodes):
                trail[i].append(row[row >= 0])
        next_ = np.where(nodes[:, :, None] >= 0, graph[np.maximum(nodes, 0)], -1)
        offer(q, next_.reshape(len(q), -1))
    return Found(best, near, hops, compared, [np.concatenate(t) if t else np.zeros(0, np.int64) for t in trail])


def batches(n: int, total: int) -> list[slice]:
    """Queries in batches whose seen marks stay bounded."""
    size = max(1, min(TOGETHER, MOST_NUMBERS // max(1, total)))
    return [slice(i, min(n, i + size)) for i in range(0, n, size)]


def medoid(vectors: np.ndarray) -> int:
    """The position nearest the mean."""
    return int(distance("l2", vectors, vectors.mean(0)).argmin())


def _pooled(metric: str, node: np.ndarray, pools: list[np.ndarray], vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pools without their node and repeats, in order of distance, as a matrix; and the distances."""
    row, flat = np.repeat(np.arange(len(pools)), [len(p) for p in pools]), np.concatenate([np.zeros(0, np.int64), *pools])
    order = np.lexsort((flat, row))
    row, flat = row[order], flat[order]
    keep = flat != node[row] if len(row) else np.zeros(0, bool)
    keep[1:] &= (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    row, flat = row[keep], flat[keep]
    sizes = np.bincount(row, minlength=len(pools))
    table = np.full((len(pools), int(sizes.max(initial=0))), -1, np.int64)
    table[np.arange(table.shape[1]) < sizes[:, None]] = flat
    d = np.where(table >= 0, distance(metric, vectors[node][:, None], vectors[np.maximum(table, 0)]), np.inf)
    order = np.lexsort((table, d), axis=1)[:, :most]
    return np.take_along_axis(table, order, 1), np.take_along_axis(d, order, 1)


@dataclass
class Graph:
    """A shard's graph, which grows by insertion."""

    vectors: np.ndarray  # prepared
    metric: str = "l2"
    degree: int = 32
    width: int = 64
    alphas: tuple[float, ...] = ALPHAS
    fill: bool = False
    most_pool: int = 750
    labels: np.ndarray | None = None  # points x labels
    starts: list[int] = field(default_factory=list)
    start_of: dict[int, int] = field(default_factory=dict)  # by label

    def __post_init__(self) -> None:
        self.wide = int(SLACK * self.degree)
        self.table = np.full((len(self.vectors), self.wide), -1, np.int32)
        self.linked = np.zeros(len(self.vectors), bool)

    def _covers(self, pools: np.ndarray) -> np.ndarray | None:
        if self.labels is None:
            return None
        own = self.labels[np.maximum(pools, 0)]
        return ~((~own[:, :, None] & own[:, None]).any(-1))  # [q, i, t]: t has no label that i lacks

    def pruned(self, node: np.ndarray, pools: list[np.ndarray]) -> np.ndarray:
        out = np.full((len(node), self.degree), -1, np.int32)
        size = max(1, MOST_BETWEEN // max(1, max((len(p) for p in pools), default=1)) ** 2)
        for i in range(0, len(node), size):
            table, d = _pooled(self.metric, node[i : i + size], pools[i : i + size], self.vectors, self.most_pool)
            out[i : i + size] = prune(table, d, self.vectors, self.degree, self.metric, self.alphas, self.fill, self._covers(table))
        return out

    def search(self, queries: np.ndarray, width: int, beam: int = 1, wanted: np.ndarray | None = None, **more) -> Found:
        """queries: prepared. wanted: labels by query, any of which a point must have."""
        starts = np.tile(np.array(self.starts, np.int64), (len(queries), 1))
        if wanted is not None:
            rows = [[*self.starts, *(self.start_of[x] for x in np.flatnonzero(w).tolist() if x in self.start_of)] for w in wanted]
            size = max((len(r) for r in rows), default=0)
            starts = np.array([r + [-1] * (size - len(r)) for r in rows], np.int64).reshape(len(queries), size)
        found = []
        for part in batches(len(queries), len(self.vectors)):
            allowed = None if wanted is None else (wanted[part].astype(np.int32) @ self.labels.T.astype(np.int32)) > 0
            found.append(walk(self.table, self.vectors, queries[part], starts[part], width, self.metric, beam, allowed, **more))
        if not found:
            return Found(np.zeros((0, width), np.int64), np.zeros((0, width)), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return Found(*(np.concatenate([getattr(f, x) for f in found]) for x in ("positions", "distances", "hops", "compared")), [e for f in found for e in f.expanded])

    def insert(self, nodes: np.ndarray) -> None:
        """Links new nodes, a batch at a time: batches double up to the number of linked nodes' fiftieth part, so that
        nodes of one batch, which do not see each other's links, are few."""
        at = 0
        while at < len(nodes):
            size = max(1, min(TOGETHER, int(self.linked.sum()) // 20))
            self._link(np.asarray(nodes[at : at + size], np.int64))
            at += size

    def _link(self, nodes: np.ndarray) -> None:
        pools = [[x, self.table[i][self.table[i] >= 0]] for i, x in zip(nodes.tolist(), self.search(self.vectors[nodes], self.width, keep=True).expanded)]
        if self.labels is not None:
            for pool, more in zip(pools, self.search(self.vectors[nodes], self.width, wanted=self.labels[nodes], keep=True).expanded):
                pool.append(more)
        chosen = self.pruned(nodes, [np.concatenate(p).astype(np.int64) for p in pools])
        self.table[nodes] = -1
        self.table[nodes, : self.degree] = chosen
        self.linked[nodes] = True
        self._add_back(np.repeat(nodes, self.degree), chosen.ravel())

    def _add_back(self, src: np.ndarray, dst: np.ndarray) -> None:
        """An edge from each dst to src; a node that gets too many is pruned."""
        keep = dst >= 0
        keep[keep] = ~(self.table[dst[keep]] == src[keep][:, None]).any(1)
        order = np.argsort(dst[keep], kind="stable")
        src, dst = src[keep][order], dst[keep][order]
        if not len(dst):
            return
        node, first, new = np.unique(dst, return_index=True, return_counts=True)
        now = (self.table[node] >= 0).sum(1)
        fits = now + new <= self.wide
        some = np.repeat(fits, new)
        place = np.repeat(now - first, new) + np.arange(len(dst))
        self.table[dst[some], place[some]] = src[some]
        full = node[~fits].tolist()
        pools = [np.concatenate([self.table[i][self.table[i] >= 0], src[a : a + n]]).astype(np.int64) for i, a, n in zip(full, first[~fits], new[~fits])]
        self._put(full, pools)

    def _put(self, nodes: list[int], pools: list[np.ndarray]) -> None:
        if nodes:
            nodes = np.array(nodes, np.int64)
            chosen = self.pruned(nodes, pools)
            self.table[nodes] = -1
            self.table[nodes, : self.degree] = chosen

    def prune_all(self) -> None:
        """Prunes every node that has more than its degree."""
        over = np.flatnonzero((self.table >= 0).sum(1) > self.degree)
        self._put(over.tolist(), [self.table[i][self.table[i] >= 0].astype(np.int64) for i in over])

    def build(self, order: np.ndarray | None = None) -> Graph:
        """Links all points, in the order given (a seeded shuffle), from the medoid."""
        n = len(self.vectors)
        if n:
            if not self.starts:
                self.starts = [medoid(self.vectors)]
            if self.labels is not None and not self.start_of:
                self.start_of = label_starts(self.labels)
            # a start that is not linked yet is met all the same, but leads nowhere
            self.insert(np.random.default_rng(42).permutation(n) if order is None else order)
            self.prune_all()
        return self

    def remove(self, gone: np.ndarray) -> None:
        """Takes nodes out: whoever pointed to one gets its live neighbours instead, pruned if they are too many. A
        start that goes gives way to its nearest live point."""
        dead = np.zeros(len(self.vectors), bool)
        dead[gone] = True
        live = np.flatnonzero(~dead & self.linked)
        if not len(live):
            self.table[:], self.starts, self.start_of, self.linked = -1, [], {}, self.linked & ~dead
            return
        hit = live[(dead[np.maximum(self.table[live], 0)] & (self.table[live] >= 0)).any(1)]
        full, pools = [], []
        fixed = {}
        for node in hit.tolist():
            now = self.table[node][self.table[node] >= 0]
            beyond = self.table[now[dead[now]]].ravel()
            beyond = beyond[beyond >= 0]
            pool = np.unique(np.concatenate([now[~dead[now]], beyond[~dead[beyond]]]))
            pool = pool[pool != node]
            if len(pool) <= self.degree:
                fixed[node] = pool
            else:
                full.append(node)
                pools.append(pool.astype(np.int64))
        for node, pool in fixed.items():
            self.table[node] = -1
            self.table[node, : len(pool)] = pool
        self._put(full, pools)
        self.table[dead] = -1
        self.linked[dead] = False
        near = lambda i: i if not dead[i] else int(live[distance(self.metric, self.vectors[live], self.vectors[i]).argmin()])
        self.starts = list(dict.fromkeys(near(i) for i in self.starts))
        self.start_of = {k: near(i) for k, i in self.start_of.items() if not dead[i]} | {
            k: int(x[0]) for k, i in self.start_of.items() if dead[i] and len(x := live[self.labels[live, k]])
        }


def label_starts(labels: np.ndarray, tries: int = 25, seed: int = 42) -> dict[int, int]:
    """An entry point for each label: of some of its points, drawn at random, the one that serves the fewest labels
    so far."""
    rng, used, out = np.random.default_rng(seed), np.zeros(len(labels), np.int64), {}
    for k in range(labels.shape[1]):
        own = np.flatnonzero(labels[:, k])
        if len(own):
            drawn = np.sort(rng.choice(own, min(tries, len(own)), replace=False))
            out[k] = int(drawn[used[drawn].argmin()])
            used[out[k]] += 1
    return out
