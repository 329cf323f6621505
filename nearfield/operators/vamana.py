"""Graph index over shards of bounded size.

Points go to the shards of their nearest centers (two by default); a shard that would be too large is cut by the hash of
its ids. Each shard is an index of its own, built and searched by one task, so no edge reaches out of a shard and none is
lost in a search: all shards answer, and the best answers are merged. The index is a table, a row for each point and shard:

    shard, vec_id, embedding, labels, neighbours (ids), distances, start (whether searches begin here), start_of (labels
    whose searches begin here), hidden (a start that is no point)

Queries are a stated set of a checked size, sent to every task. Distances are those of nearfield.operators.knn: squared
for l2, one minus the cosine, the inner product itself (largest first), l1.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import METRICS
from ..shipping import map_arrow, ship
from ..storage import written
from .knn import best_of, gather
from .proximity import ALPHAS, Found, Graph, batches, distance, prepared, prune, walk

SHARD_ROWS, MOST_CENTERS = 20_000, 1024
#: A filtered walk meets only the few of a node's neighbours that match, and keeps a list so many times as wide; where no
#: more points of a shard match than so many times the width, which leaves too few edges among them, all are compared.
FILTERED, SCANNED = 3, 32
#: Partitions that shards are dealt to in turn, so that no task has two before there are more shards than these.
SHARD_PARTS = 128
NODES = "shard bigint, vec_id bigint, embedding array<float>, labels array<string>, neighbours array<bigint>, distances array<double>, start boolean, start_of array<string>, hidden boolean"


def usable(points: DataFrame, dim: int | None = None) -> DataFrame:
    """vec_id, embedding and labels of the points whose vector is whole and has dim numbers (else the largest size)."""
    points = points.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    if dim is None:
        dim = points.agg(F.max(F.size("embedding"))).first()[0] or 0
    labels = F.coalesce("labels", F.array().cast("array<string>")) if "labels" in points.columns else F.array().cast("array<string>")
    return points.where(F.size("embedding") == dim).select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<float>"), labels.alias("labels"))


def near_shards(points: DataFrame, centers: list[tuple[int, list[float]]], copies: int) -> DataFrame:
    """points with shard: a row for each of the copies nearest centers (number, vector)."""
    ship(points.sparkSession)
    names = np.array([n for n, _ in centers], np.int64)
    matrix = np.array([c for _, c in centers], float)
    norms = (matrix * matrix).sum(1)

    @F.pandas_udf("array<bigint>")
    def nearest(vectors: pd.Series) -> pd.Series:
        d = norms - 2 * np.stack(vectors.to_numpy()).astype(float) @ matrix.T if len(vectors) else np.zeros((0, len(names)))
        return pd.Series([names[np.lexsort((names, x))[:copies]] for x in d])

    return points.withColumn("shard", F.explode(nearest("embedding")))


def deal(points: DataFrame, rows: int = SHARD_ROWS, copies: int = 2) -> DataFrame:
    """points with shard. The centers are the points whose ids hash lowest. The driver keeps them and their counts."""
    n = points.count()
    wanted = min(MOST_CENTERS, math.ceil(n * copies / rows)) if n > rows else 1
    if wanted <= 1:
        return points.withColumn("shard", F.lit(0).cast("bigint"))
    centers = [(i, r.embedding) for i, r in enumerate(points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect())]
    dealt = near_shards(points, centers, copies)
    parts = {r.shard: math.ceil(r["count"] / rows) for r in dealt.groupBy("shard").count().collect()}
    first = np.cumsum([0, *(parts.get(i, 1) for i in range(wanted))]).tolist()
    of = lambda xs: F.get(F.array(*(F.lit(x) for x in xs)), F.col("shard").cast("int"))
    return dealt.withColumn("shard", (of(first[:-1]) + F.pmod(F.xxhash64("vec_id"), of([parts.get(i, 1) for i in range(wanted)]))).cast("bigint")).dropDuplicates(["shard", "vec_id"])


def sphere(n: int, dim: int, radius: float = 1.0, seed: int = 42) -> np.ndarray:
    """Random points at that distance from the origin."""
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return radius * x / np.sqrt((x * x).sum(1, keepdims=True))


def by_shard(rows: DataFrame):
    """rows by shard, each shard a task of its own as long as there are no more than SHARD_PARTS."""
    return rows.withColumn("__part", F.pmod("shard", F.lit(SHARD_PARTS)).cast("int")).repartitionById(SHARD_PARTS, "__part").groupBy("__part", "shard")


class Shard:
    """A shard's rows as a Graph, and back."""

    def __init__(self, rows: pd.DataFrame, metric: str, degree: int = 32, width: int = 64, alphas=ALPHAS, fill: bool = False, universal: str | None = None, labelled: bool = True) -> None:
        rows = rows.sort_values("vec_id", kind="stable").reset_index(drop=True)
        self.number = int(rows.shard.iloc[0]) if len(rows) else 0
        self.ids = rows.vec_id.to_numpy(np.int64)
        self.raw = np.stack(rows.embedding.to_numpy()).astype(float) if len(rows) else np.zeros((0, 0))
        self.hidden = rows.hidden.to_numpy(bool) if "hidden" in rows else np.zeros(len(rows), bool)
        self.labels = [list(x) for x in rows.labels]
        self.names = sorted({x for row in self.labels for x in row})
        marks = np.zeros((len(rows), len(self.names)), bool)
        at = {x: i for i, x in enumerate(self.names)}
        for i, row in enumerate(self.labels):
            marks[i, [at[x] for x in row]] = True
        if universal in at:  # such a point answers any filter
            marks[marks[:, at[universal]]] = True
        self.graph = Graph(prepared(metric, self.raw), metric, degree, width, alphas, fill, labels=marks if labelled and self.names else None)
        if "neighbours" in rows:
            own = rows.neighbours.map(lambda x: x is not None).to_numpy(bool)
            sizes = np.array([len(x) if x is not None else 0 for x in rows.neighbours], np.int64)
            if sizes.max(initial=0) > self.graph.wide:
                self.graph.wide = int(sizes.max())
                self.graph.table = np.full((len(rows), self.graph.wide), -1, np.int32)
            flat = np.concatenate([np.asarray(x, np.int64) for x in rows.neighbours if x is not None]) if own.any() else np.zeros(0, np.int64)
            inside = np.arange(self.graph.wide) < sizes[:, None]
            self.graph.table[inside] = np.searchsorted(self.ids, flat)
            self.graph.linked[:] = own
            self.graph.starts = np.flatnonzero(rows.start.fillna(False).to_numpy(bool)).tolist()
            if self.graph.labels is not None:
                self.graph.start_of = {at[x]: i for i, xs in enumerate(rows.start_of) if xs is not None for x in xs if x in at}

    def rows(self, keep: np.ndarray | None = None) -> pd.DataFrame:
        g = self.graph
        neighbours = [t[t >= 0] for t in g.table]
        far = [distance(g.metric, g.vectors[i], g.vectors[t]) for i, t in enumerate(neighbours)]
        entry: dict[int, list] = {}
        for k, i in g.start_of.items():
            entry.setdefault(i, []).append(self.names[k])
        out = pd.DataFrame(
            {
                "shard": np.full(len(self.ids), self.number, np.int64),
                "vec_id": self.ids,
                "embedding": list(self.raw.astype(np.float32)),
                "labels": self.labels,
                "neighbours": [self.ids[t] for t in neighbours],
                "distances": far,
                "start": np.isin(np.arange(len(self.ids)), g.starts),
                "start_of": [sorted(entry.get(i, [])) for i in range(len(self.ids))],
                "hidden": self.hidden,
            }
        )
        return out if keep is None else out[keep]


def _check(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}: one of {sorted(METRICS)}")


def build(points: DataFrame, degree: int = 32, width: int = 64, shard_rows: int = SHARD_ROWS, copies: int = 2, metric: str = "l2", alphas: tuple[float, ...] = ALPHAS, fill: bool = False, labelled: bool = False, universal: str | None = None, frozen: int = 0, seed: int = 42) -> DataFrame:
    """The index of points (vec_id, embedding, and labels if labelled). frozen: so many random starts a shard that are
    no points. Points are linked in a seeded shuffle."""
    _check(metric)
    return built(deal(usable(points), shard_rows, copies), degree, width, metric, alphas, fill, labelled, universal, frozen, seed)


def built(dealt: DataFrame, degree: int = 32, width: int = 64, metric: str = "l2", alphas: tuple[float, ...] = ALPHAS, fill: bool = False, labelled: bool = False, universal: str | None = None, frozen: int = 0, seed: int = 42) -> DataFrame:
    """The index of points that have a shard already."""
    ship(dealt.sparkSession)

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("vec_id")
        if frozen:
            lowest, vectors = int(rows.vec_id.min()), np.stack(rows.embedding.to_numpy())
            radius = float(np.sqrt((vectors.astype(float) ** 2).sum(1)).max())
            starts = sphere(frozen, vectors.shape[1], radius, seed)
            extra = pd.DataFrame({"shard": rows.shard.iloc[0], "vec_id": [lowest - 1 - i for i in range(frozen)], "embedding": list(starts), "labels": [[] for _ in range(frozen)], "hidden": True})
            rows = pd.concat([rows.assign(hidden=False), extra], ignore_index=True)
        own = Shard(rows, metric, degree, width, alphas, fill, universal, labelled)
        if frozen:
            own.graph.starts = np.flatnonzero(own.hidden).tolist()
        own.graph.build(np.random.default_rng(seed).permutation(len(own.ids)))
        return own.rows()

    return by_shard(dealt.select("shard", "vec_id", "embedding", "labels")).applyInPandas(shard, NODES)


def joined(nodes: DataFrame, degree: int = 32) -> DataFrame:
    """One index of all shards, of the same columns: each point once, with its nearest neighbours of all shards, and one
    start, the point nearest the mean, and one for each label. No task holds it whole."""
    from .cluster import medoid

    lists = edges(nodes, degree).groupBy(F.col("src").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("distance", "dst"))).alias("x"))
    points = nodes.where("NOT hidden").select("vec_id", "embedding", "labels").dropDuplicates(["vec_id"])
    first = F.broadcast(medoid(points).withColumn("start", F.lit(True)))
    of = nodes.where("NOT hidden").select("vec_id", F.explode("start_of").alias("label")).groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    of = of.groupBy("vec_id").agg(F.sort_array(F.collect_list("label")).alias("start_of"))
    every = points.join(lists, "vec_id", "left").join(first, "vec_id", "left").join(of, "vec_id", "left")
    listed = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return every.select(
        F.lit(0).cast("bigint").alias("shard"), "vec_id", "embedding", "labels",
        listed(F.transform("x", lambda r: r["dst"]), "bigint").alias("neighbours"), listed(F.transform("x", lambda r: r["distance"]), "double").alias("distances"),
        F.coalesce("start", F.lit(False)).alias("start"), listed(F.col("start_of"), "string").alias("start_of"), F.lit(False).alias("hidden"),
    )


def edges(nodes: DataFrame, degree: int | None = None) -> DataFrame:
    """src, dst, distance: the shards' edges in one graph, each once; with a degree, each node's nearest so many."""
    pairs = nodes.where("NOT hidden").select(F.col("vec_id").alias("src"), F.explode(F.arrays_zip("neighbours", "distances")).alias("x"))
    pairs = pairs.select("src", F.col("x.neighbours").alias("dst"), F.col("x.distances").alias("distance"))
    hidden = nodes.where("hidden").select(F.col("vec_id").alias("dst"))
    pairs = pairs.join(hidden, "dst", "left_anti").groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    if degree is None:
        return pairs
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))).where(F.col("place") <= degree).drop("place")


def known_labels(nodes: DataFrame, wanted: DataFrame, universal: str | None = None) -> None:
    """wanted: label. Raises an error for a label that no point has, unless points with a universal label answer it."""
    if universal is not None and not nodes.where(F.array_contains("labels", universal)).isEmpty():
        return
    known = nodes.select(F.explode("labels").alias("label")).distinct()
    missing = [r.label for r in wanted.select("label").distinct().join(known, "label", "left_anti").orderBy("label").limit(10).collect()]
    if missing:
        raise ValueError(f"no point has the label {', '.join(missing)}")


def _queries(queries: DataFrame, metric: str) -> tuple[np.ndarray, np.ndarray, list | None]:
    """ids, prepared vectors, wanted labels (lists) if the queries have such a column."""
    names, q = gather(queries)
    wanted = None
    if "wanted" in queries.columns:
        kind = dict(queries.dtypes)["wanted"]
        own = queries.select("qid", (F.col("wanted") if kind.startswith("array") else F.array("wanted")).alias("wanted"))
        by_id = {r.qid: [x for x in (r.wanted or []) if x is not None] for r in own.collect()}
        wanted = [by_id[n] for n in names]
    return np.array(names, np.int64), prepared(metric, q) if len(q) else q, wanted


_ANSWERS = "qid bigint, vec_id bigint, distance double, hops bigint, compared bigint"


def _answers(ids: np.ndarray, own: Shard, positions: np.ndarray, far: np.ndarray, hops: np.ndarray, compared: np.ndarray, k: int) -> pd.DataFrame:
    """The k first points of each query, without hidden ones. A query that found none has a row without an id."""
    real = (positions >= 0) & ~own.hidden[np.maximum(positions, 0)] if len(own.hidden) else positions >= 0
    real &= np.cumsum(real, 1) <= k
    q, j = np.nonzero(real)
    value = far[q, j]
    found = pd.DataFrame({"qid": ids[q], "vec_id": pd.array(own.ids[positions[q, j]], "Int64"), "distance": -value if own.graph.metric == "ip" else value})
    found["first"] = ~found.duplicated("qid")
    none = pd.DataFrame({"qid": ids[~real.any(1)], "vec_id": pd.array([None] * int((~real.any(1)).sum()), "Int64"), "distance": np.nan, "first": True})
    found = pd.concat([found, none], ignore_index=True) if len(none) else found
    cost = dict(zip(ids.tolist(), zip(hops.tolist(), compared.tolist())))
    found["hops"] = [cost[i][0] if f else 0 for i, f in zip(found.qid, found["first"])]
    found["compared"] = [cost[i][1] if f else 0 for i, f in zip(found.qid, found["first"])]
    return found[["qid", "vec_id", "distance", "hops", "compared"]]


def answers(nodes: DataFrame, queries: DataFrame, look, metric: str, universal: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """What look(shard, query vectors, wanted marks, rows) finds in each shard: (positions, distances, hops, compared, k).
    Rows (qid, vec_id, distance, hops, compared) of all shards."""
    _check(metric)
    ship(nodes.sparkSession)
    ids, q, wanted = _queries(queries, metric)

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable").reset_index(drop=True)
        own, marks = Shard(rows, metric, universal=universal), None
        if not len(ids) or q.shape[1] != own.raw.shape[1]:
            return pd.DataFrame({c: [] for c in ("qid", "vec_id", "distance", "hops", "compared")})
        if wanted is not None:
            if own.graph.labels is None:
                own.graph.labels = np.zeros((len(own.ids), 1), bool)
            marks = np.zeros((len(ids), own.graph.labels.shape[1]), bool)
            at = {x: i for i, x in enumerate(own.names)}
            for i, labels in enumerate(wanted):
                marks[i, [at[x] for x in labels if x in at]] = True
                if universal in at:
                    marks[i, at[universal]] = True
        return _answers(ids, own, *look(own, q, marks, rows))

    return by_shard(nodes.select(*[c.split()[0] for c in NODES.split(", ")], *columns)).applyInPandas(shard, _ANSWERS)


def merged(found: DataFrame, k: int, metric: str) -> DataFrame:
    """qid, vec_id, distance, rank: the k best of all shards, each point once."""
    return best_of(found.where("vec_id IS NOT NULL").select("qid", "vec_id", "distance"), k, descending=metric == "ip")


def search(nodes: DataFrame, queries: DataFrame, k: int, width: int, beam: int = 1, metric: str = "l2", universal: str | None = None, deletes: DataFrame | None = None, nearest_start: bool = False, fast: bool = False) -> DataFrame:
    """qid, vec_id, distance, rank. Queries with a column wanted (a label, or labels of which one is enough) meet only
    points that have it. deletes: ids that are walked over but not returned. nearest_start: from each query's nearest
    start alone. fast: l2 by norms, from the start's neighbours and random points."""
    found = walked(nodes, queries, width if deletes is not None else k, width, beam, metric, universal, nearest_start, fast)
    if deletes is not None:
        found = found.join(deletes.select("vec_id"), "vec_id", "left_anti")
    return merged(found, k, metric)


def walked(nodes: DataFrame, queries: DataFrame, k: int, width: int, beam: int = 1, metric: str = "l2", universal: str | None = None, nearest_start: bool = False, fast: bool = False) -> DataFrame:
    """The same before shards are merged, with hops and compared (in a query's first row of a shard)."""
    if not 0 < k <= width:
        raise ValueError("k must be from 1 to the width")
    if beam < 1:
        raise ValueError("the beam must be positive")
    if fast and metric != "l2":
        raise ValueError("the fast layout is for l2")

    def look(own: Shard, q: np.ndarray, marks, rows):
        g = own.graph
        if fast:
            norms = (g.vectors * g.vectors).sum(1)
            first = g.table[g.starts].ravel()
            fill = np.random.default_rng(42).integers(0, len(own.ids), max(0, width - len(first)))
            starts = np.tile(np.concatenate([first, fill, g.starts]).astype(np.int64), (len(q), 1))
            parts = []
            for part in batches(len(q), len(own.ids)):
                own_q = q[part]
                parts.append(walk(g.table, g.vectors, own_q, starts[part], width, beam=beam, score=lambda i, p: norms[p] - 2 * np.einsum("qd,qpd->qp", own_q[i], g.vectors[p])))  # noqa: B023
            positions = np.concatenate([f.positions for f in parts])
            far = np.where(positions >= 0, distance("l2", q[:, None], g.vectors[np.maximum(positions, 0)]), np.inf)
            return positions, far, np.concatenate([f.hops for f in parts]), np.concatenate([f.compared for f in parts]), k
        if nearest_start and len(g.starts) > 1 and marks is None:
            near = distance(g.metric, q[:, None], g.vectors[g.starts][None]).argmin(1)
            every, found = list(g.starts), []
            for i in range(len(q)):
                g.starts = [every[near[i]]]
                found.append(g.search(q[i : i + 1], width, beam))
            return (*(np.concatenate([getattr(f, x) for f in found]) for x in ("positions", "distances", "hops", "compared")), k)
        f = g.search(q, width, beam) if marks is None else filtered(g, q, width, beam, marks)
        return f.positions, f.distances, f.hops, f.compared, k

    return answers(nodes, queries, look, metric, universal)


def filtered(g: Graph, q: np.ndarray, width: int, beam: int, marks: np.ndarray) -> Found:
    """Search among the points that have one of a query's labels."""
    wide = FILTERED * width
    out = Found(np.full((len(q), wide), -1, np.int64), np.full((len(q), wide), np.inf), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64))
    groups, group = np.unique(marks, axis=0, return_inverse=True)
    for number, wanted in enumerate(groups):
        asked = np.flatnonzero(group.ravel() == number)
        own = np.flatnonzero(g.labels[:, wanted].any(1) & g.linked)
        if len(own) > SCANNED * width:
            f = g.search(q[asked], wide, beam, marks[asked])
            out.positions[asked], out.distances[asked], out.hops[asked], out.compared[asked] = f.positions, f.distances, f.hops, f.compared
            continue
        for i in asked.tolist() if len(own) else []:
            d = distance(g.metric, q[i], g.vectors[own])
            order = np.lexsort((own, d))[:wide]
            out.positions[i, : len(order)], out.distances[i, : len(order)], out.compared[i] = own[order], d[order], len(own)
    return out


def search_codes(nodes: DataFrame, queries: DataFrame, codes: DataFrame, books: np.ndarray, k: int, width: int, beam: int = 4, most_reads: int | None = None, metric: str = "l2", universal: str | None = None, rerank: int | None = None) -> DataFrame:
    """Search guided by quantised vectors: candidates are ordered by the distance to their codes, beam nodes are read a
    round, and only nodes that were read are returned, by their whole vectors. codes: vec_id, codes (array<int>).
    books: chunks of (code, number), see quantize.Quantizer.tables. rerank: the nearest so many by code, read or not, are
    ordered by their whole vectors instead."""
    if metric != "l2":
        raise ValueError("codes are of l2")
    if not 0 < k <= width:
        raise ValueError("k must be from 1 to the width")

    def look(own: Shard, q: np.ndarray, marks, rows):
        g = own.graph
        table = np.stack(rows["codes"].to_numpy()).astype(np.int64)
        out_p, out_d, hops, compared = [], [], [], []
        for part in batches(len(q), len(own.ids)):
            own_q = q[part]
            looked = books.distances(own_q)  # query, chunk, code
            chunk = np.arange(table.shape[1])
            score = lambda i, p: looked[i[:, None, None], chunk, table[p]].sum(-1)  # noqa: E731,B023
            allowed = None if marks is None else (marks[part].astype(np.int32) @ g.labels.T.astype(np.int32)) > 0
            starts = np.tile(np.array([*g.starts, *sorted(g.start_of.values())], np.int64), (len(own_q), 1))
            f = walk(g.table, g.vectors, own_q, starts, width, beam=beam, allowed=allowed, score=score, most_hops=most_reads, keep=True)
            read = [p[:rerank][p[:rerank] >= 0] for p in f.positions] if rerank else f.expanded
            for i, p in enumerate(read):
                d = distance("l2", own_q[i], g.vectors[p])
                order = np.lexsort((p, d))[:width]
                out_p.append(np.pad(p[order], (0, width - len(order)), constant_values=-1))
                out_d.append(np.pad(d[order], (0, width - len(order)), constant_values=np.inf))
            hops.append(f.hops)
            compared.append(f.compared)
        return np.array(out_p), np.array(out_d), np.concatenate(hops), np.concatenate(compared), k

    return merged(answers(nodes.join(codes, "vec_id"), queries, look, metric, universal, ("codes",)), k, metric)


def within(nodes: DataFrame, queries: DataFrame, radius: float, low: int = 10, high: int = 400, metric: str = "l2") -> DataFrame:
    """qid, vec_id, distance, rank of the points within the radius: the width doubles until fewer than half of it are
    within, or it would exceed the most. For ip: an inner product of radius at least."""
    most = -radius if metric == "ip" else radius

    def look(own: Shard, q: np.ndarray, marks, rows):
        g, left, size = own.graph, np.arange(len(q)), low
        positions, far = np.full((len(q), high), -1, np.int64), np.full((len(q), high), np.inf)
        hops, compared = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        while len(left):
            f = g.search(q[left], size, beam=max(1, min(100, size // 5)))
            hit = f.distances <= most
            positions[left, :size] = np.where(hit, f.positions, -1)
            far[left, :size] = np.where(hit, f.distances, np.inf)
            hops[left] += f.hops
            compared[left] += f.compared
            left = left[hit.sum(1) >= size / 2] if 2 * size <= high else left[:0]
            size *= 2
        return positions, far, hops, compared, high

    found = answers(nodes, queries, look, metric)
    return merged(found, 1 << 30, metric)


def sweep(nodes: DataFrame, queries: DataFrame, truth: DataFrame, k: int, widths: list[int], beam: int = 1, metric: str = "l2") -> DataFrame:
    """A row for each width: queries, mean hops and distances a query, and the recall at k in percent, by a truth that
    has further rows where the k-th is tied."""
    from .evaluate import recall

    rows = None
    for width in widths:
        found = written(walked(nodes, queries, k, width, beam, metric))  # read twice
        cost = found.groupBy("qid").agg(F.sum("hops").alias("hops"), F.sum("compared").alias("compared")).agg(F.count("*").alias("queries"), F.avg("hops").alias("mean_hops"), F.avg("compared").alias("mean_compared"))
        share = recall(truth, merged(found, k, metric), k, descending=metric == "ip").agg(F.avg("recall").alias("recall"))
        row = cost.join(share).select(F.lit(width).alias("width"), "queries", "mean_hops", "mean_compared", "recall")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def tune_beam(run, first: int = 2, most: int = 64, slowest: float | None = None) -> int:
    """The beam up to which queries a second rise: run(beam) gives (queries a second, 99.9th percentile, mean) of the
    latencies. Beams grow by a tenth, one at least; a percentile beyond slowest + 2 means ends it."""
    best, beam, rate = first, first, 0.0
    while beam <= most:
        now, tail, mean = run(beam)
        if now <= rate or (slowest is not None and tail >= slowest + 2 * mean):
            break
        best, rate, beam = beam, now, max(beam + 1, int(beam * 1.1))
    return best


def visits(nodes: DataFrame, queries: DataFrame, width: int, most: int, metric: str = "l2") -> DataFrame:
    """vec_id and n: the nodes that searches expand most often, what a cache should hold."""
    ship(nodes.sparkSession)
    ids, q, _ = _queries(queries, metric)

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        own = Shard(rows, metric)
        seen = np.concatenate([np.zeros(0, np.int64), *own.graph.search(q, width, keep=True).expanded])
        at, n = np.unique(seen, return_counts=True)
        return pd.DataFrame({"vec_id": own.ids[at], "n": n.astype(np.int64)})

    found = by_shard(nodes).applyInPandas(shard, "vec_id bigint, n bigint").groupBy("vec_id").agg(F.sum("n").alias("n"))
    return found.orderBy(F.desc("n"), "vec_id").limit(most)


def insert(nodes: DataFrame, new: DataFrame, copies: int = 2, degree: int = 32, width: int = 64, metric: str = "l2", labelled: bool = False, universal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The index with the new points (vec_id, embedding, labels), and the rows that are rejected: an id that is there
    already or comes twice, a vector of another length, and, where labels are kept, a point without any. New points
    go to the shards whose starts are nearest."""
    ship(nodes.sparkSession)
    dim = nodes.select(F.size("embedding")).first()
    fit = usable(new, dim[0] if dim else None).dropDuplicates(["vec_id"])
    if labelled:
        fit = fit.where(F.size("labels") > 0)
    fit = fit.join(nodes.select("vec_id"), "vec_id", "left_anti")
    rejected = new.select("vec_id").exceptAll(fit.select("vec_id"))
    centers = [(r.shard, r.embedding) for r in nodes.where("start").dropDuplicates(["shard"]).select("shard", "embedding").collect()]
    dealt = near_shards(fit, centers, min(copies, len(centers))) if centers else fit.withColumn("shard", F.lit(0).cast("bigint"))

    def shard(old: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        if not len(more):
            return old
        more = more.assign(neighbours=None, distances=None, start=False, start_of=None, hidden=False)
        own = Shard(pd.concat([old, more[old.columns]], ignore_index=True) if len(old) else more, metric, degree, width, universal=universal, labelled=labelled)
        fresh = np.flatnonzero(~own.graph.linked)
        if not own.graph.starts:
            own.graph.build(fresh)
        else:
            if own.graph.labels is not None:  # a label that is new begins at its first point
                for k in range(len(own.names)):
                    own.graph.start_of.setdefault(k, int(np.flatnonzero(own.graph.labels[:, k])[0]))
            own.graph.insert(fresh)
            own.graph.prune_all()
        return own.rows()

    columns = [c.split()[0] for c in NODES.split(", ")]
    grown = nodes.select(columns).groupBy("shard").cogroup(dealt.select("shard", "vec_id", "embedding", "labels").groupBy("shard")).applyInPandas(shard, NODES)
    return grown, rejected


def remove(nodes: DataFrame, deletes: DataFrame, degree: int = 32, metric: str = "l2") -> DataFrame:
    """The index without the deleted points: who pointed to one points to its live neighbours, pruned if they are
    more than the degree."""
    ship(nodes.sparkSession)
    marked = nodes.join(deletes.select("vec_id").distinct().withColumn("gone", F.lit(True)), "vec_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable").reset_index(drop=True)
        gone = rows.gone.to_numpy(bool)
        own = Shard(rows, metric, degree)
        if gone.any():
            own.graph.remove(np.flatnonzero(gone))
        return own.rows(~gone)

    columns = [c.split()[0] for c in NODES.split(", ")]
    return by_shard(marked.select(*columns, "gone")).applyInPandas(shard, NODES)


def prune_edges(pairs: DataFrame, points: DataFrame, degree: int, metric: str = "l2", alphas: tuple[float, ...] = ALPHAS, fill: bool = False) -> DataFrame:
    """src, dst: each node's edges, pruned where they are more than the degree. A node's pool is one row."""
    import pyarrow as pa

    pool = pairs.where("src <> dst").select("src", "dst").distinct()
    counts = pool.groupBy("src").agg(F.count("*").alias("n"))
    own = points.select(F.col("vec_id").alias("src"), F.col("embedding").alias("here"))
    there = points.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("vector"))
    over = pool.join(counts.where(F.col("n") > degree).select("src"), "src", "left_semi")
    rows = over.join(there, "dst").groupBy("src").agg(F.collect_list(F.struct("dst", "vector")).alias("pool")).join(own, "src")

    def chosen(it):
        for batch in it:
            src, dst = [], []
            for r in batch.to_pylist():
                ids = np.array([x["dst"] for x in r["pool"]], np.int64)
                vectors = prepared(metric, np.array([x["vector"] for x in r["pool"]], float))
                far = distance(metric, prepared(metric, np.array([r["here"]], float)), vectors)
                order = np.lexsort((ids, far))
                kept = prune(np.arange(len(ids))[None], far[order][None], vectors[order], degree, metric, alphas, fill)[0]
                dst.append(ids[order][kept[kept >= 0]])
                src.append(np.full(len(dst[-1]), r["src"], np.int64))
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    few = pool.join(counts.where(F.col("n") <= degree).select("src"), "src", "left_semi")
    return few.unionByName(map_arrow(rows.select("src", "here", "pool"), chosen, "src bigint, dst bigint"))


def per_label(points: DataFrame, degree: int = 32, width: int = 64, rows: int = SHARD_ROWS, metric: str = "l2") -> DataFrame:
    """An index for each label (label, and the index's columns): a label of more rows has several shards."""
    each = usable(points).withColumn("label", F.explode(F.array_distinct("labels")))
    parts = each.groupBy("label").agg(F.ceil(F.count("*") / rows).alias("parts"))
    dealt = each.join(parts, "label").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).withColumn("shard", F.xxhash64("label", "part"))
    found = built(dealt.select("shard", "vec_id", "embedding", "labels"), degree, width, metric)
    return found.join(dealt.select("shard", "label").distinct(), "shard")


def stitched(points: DataFrame, degree: int = 32, width: int = 64, stitched_degree: int = 64, rows: int = SHARD_ROWS, metric: str = "l2") -> DataFrame:
    """src, dst: the edges of all labels' graphs, each once, pruned to the stitched degree."""
    return prune_edges(edges(written(per_label(points, degree, width, rows, metric))), usable(points), stitched_degree, metric)


def status(nodes: DataFrame, deletes: DataFrame) -> DataFrame:
    """One row: points, deleted, live, shards, edges, starts, hidden starts, mean degree."""
    own = nodes.where("NOT hidden").select("vec_id").distinct()
    points = own.agg(F.count("*").alias("points"))
    gone = own.join(deletes.select("vec_id"), "vec_id", "left_semi").agg(F.count("*").alias("deleted"))
    rest = nodes.agg(F.countDistinct("shard").alias("shards"), F.sum(F.size("neighbours")).alias("edges"), F.count_if("start").alias("starts"), F.count_if("hidden").alias("frozen"), F.avg(F.size("neighbours")).alias("mean_degree"))
    return points.join(gone).join(rest).withColumn("live", F.col("points") - F.col("deleted"))
