"""Exact nearest-neighbour joins.

The queries are a stated set. One of a checked size goes to every task with the function; each task scores its rows
against them in numpy blocks and keeps a running best, so the shuffle carries at most k rows a query and task, and a
ranking window makes the final cut. A larger set is cut into blocks of that size, which meet blocks of the base in a
join by block numbers; each pair of blocks is one task's work and again gives k rows a query at most. Scores add
dimension by dimension in double, which gives the same bits as a fold in SQL. Order is (distance, id); inner products
rank from the largest.

Null vectors and those of another length than the query's are left out, whatever lengths a batch has; fewer than k
matches give fewer rows; an empty query set gives an empty frame.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..shipping import map_arrow, ship

#: Query vectors' numbers that one call may send to every task: 256 MB in double.
MOST_NUMBERS = 1 << 25
#: Numbers of either side of a pair of blocks, where a larger set of queries is cut into blocks.
BLOCK_NUMBERS = 1 << 23
#: Numbers of a matrix of scores that a core's cache holds. Queries and rows of a matrix of rough scores; its rows at first.
CACHED, QUERIES, ROWS, FIRST = 1 << 15, 256, 8192, 512


def scores(metric: str, queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """A row for each query: the value by which the nearest come first. Worked out in blocks that stay in a core's cache."""
    out = np.zeros((len(queries), len(base)))
    wide = max(1, min(len(base), 4096))
    high = max(1, CACHED // wide)
    for j in range(0, len(base), wide):
        x = np.ascontiguousarray(base[j : j + wide].T, dtype=float)
        nb = _fold(x * x) if metric == "cosine" else None
        for i in range(0, len(queries), high):
            q = np.asarray(queries[i : i + high], float)
            sums = out[i : i + high, j : j + wide]
            term = np.empty(sums.shape)
            for d in range(len(x)):
                if metric in ("ip", "cosine"):
                    np.multiply(q[:, d, None], x[d], out=term)
                else:
                    np.subtract(q[:, d, None], x[d], out=term)
                    np.abs(term, out=term) if metric == "l1" else np.multiply(term, term, out=term)
                sums += term
            if metric == "cosine":
                out[i : i + high, j : j + wide] = _cosine(sums, _fold((q * q).T)[:, None], nb[None])
    return -out if metric == "ip" else out


def _fold(x: np.ndarray) -> np.ndarray:
    """The sum over the first axis, from the first row on."""
    out = np.zeros(x.shape[1:])
    for row in x:
        out += row
    return out


def _cosine(dots: np.ndarray, nq: np.ndarray, nb: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        cos = dots / (np.sqrt(nq) * np.sqrt(nb))
    return np.where((nq == 0) | (nb == 0), 1.0, 1 - np.clip(cos, -1, 1))


def _of_pairs(metric: str, q: np.ndarray, a: np.ndarray, x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The scores of the pairs (q[a], x[b]), bit for bit those of scores()."""
    out = np.zeros(len(a))
    for i in range(0, len(a), step := max(1, CACHED // max(1, x.shape[1]))):
        u, v = np.asarray(q[a[i : i + step]], float).T, np.asarray(x[b[i : i + step]], float).T
        if metric == "cosine":
            out[i : i + step] = _cosine(_fold(u * v), _fold(u * u), _fold(v * v))
        else:
            diff = u * v if metric == "ip" else u - v
            out[i : i + step] = _fold(diff if metric == "ip" else np.abs(diff) if metric == "l1" else diff * diff)
    return -out if metric == "ip" else out


class _Side:
    """Vectors ready for rough scores by a matrix product, in float or double: the matrix, the longest length, and
    whether the numbers allow it."""

    def __init__(self, x: np.ndarray, metric: str, kind, query: bool) -> None:
        x = np.asarray(x, float)
        with np.errstate(over="ignore", invalid="ignore"):
            norms = np.einsum("nd,nd->n", x, x)
            most = float(norms.max(initial=0.0))
        self.fits = np.isfinite(most) and most < (1e30 if kind is np.float32 else 1e290)
        self.length = math.sqrt(most) if self.fits else 0.0
        if not self.fits:
            return
        if metric == "cosine":
            root = np.sqrt(norms)[:, None]
            self.fits &= bool(norms[norms > 0].min(initial=1.0) > 1e-30)  # smaller ones lose their digits
            x, self.length = np.divide(x, root, out=np.zeros_like(x), where=root > 0), 1.0
        if metric == "l2":
            x = np.concatenate([-2 * x, np.ones((len(x), 1)), norms[:, None]] if query else [x, norms[:, None], np.ones((len(x), 1))], 1)
        self.matrix = np.ascontiguousarray(-x if query and metric != "l2" else x, dtype=kind)


def _candidates(metric: str, q: np.ndarray, x: np.ndarray, base: dict, limit: np.ndarray, k: int | None = None, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of rows of q and x among which are all whose score is at the query's limit or below; with k, at the
    k-th smallest of x or below. same: marks of pairs that do not count. base: x's sides, kept from one call to the next.

    Rough scores come from a matrix product in float, or in double if those let too many pairs through; the bound of
    their rounding is added to the limit. Numbers that no product can take, and l1, are scored as they are."""

    def pairs(s: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        most = limit - (1.0 if metric == "cosine" and slack else 0.0)  # which rough scores lack
        if k is not None and k < s.shape[1]:
            near = s if same is None else np.where(same, np.inf, s)
            kth = np.partition(near, k - 1, axis=1)[:, k - 1].astype(float)
            most = np.minimum(most, np.where(np.isnan(kth), np.inf, kth) + slack)
        with np.errstate(over="ignore"):
            most = np.nextafter((most + slack).astype(s.dtype), s.dtype.type(np.inf))  # no limit is rounded down
        at = np.flatnonzero(s <= most[:, None])
        return at // s.shape[1], at % s.shape[1]

    found = None
    for kind in () if metric == "l1" else (np.float32, np.float64):
        if kind not in base:
            base[kind] = _Side(x, metric, kind, False)
        own = _Side(q, metric, kind, True) if base[kind].fits else base[kind]
        if base[kind].fits and own.fits:
            length = own.length + base[kind].length
            # a bound for the rounding of the numbers, their products and sums, twice over, and for underflow
            slack = 2 * (own.matrix.shape[1] + 8) * float(np.finfo(kind).eps) * length * length + 1e3 * float(np.finfo(kind).tiny)
            found = pairs(own.matrix @ base[kind].matrix.T, slack)
            if len(found[0]) <= max(64 * (k or 1), len(x) // 64) * len(q):
                return found
    return pairs(scores(metric, q, x), 0.0) if found is None else found


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: the rows that have a whole vector of it, and these vectors as a matrix."""
    if not len(column):
        return []
    flat = column.flatten()  # without the null rows
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64)
    values = flat.to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(np.maximum(sizes, 0))
    broken = np.zeros(len(column), bool)
    if flat.null_count:
        at = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))
        broken[np.searchsorted(ends, at, "right")] = True
    out = []
    for size in np.unique(sizes[(sizes >= 0) & ~broken]).tolist():
        rows = np.flatnonzero((sizes == size) & ~broken)
        out.append((rows, values[(ends[rows] - size)[:, None] + np.arange(size)]))
    return out


def collected(queries: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """qid and vectors (qid, q), as arrays, for each length of the whole vectors; floats stay floats."""
    table = queries.select(F.col("qid").cast("bigint"), "q").toArrow().combine_chunks()
    kind = table.schema.field("q").type
    narrow = pa.types.is_list(kind) and pa.types.is_float32(kind.value_type)
    names = table.column(0).to_numpy()
    if not len(names):
        return []
    column = pa.concat_arrays(table.column(1).chunks)
    return [(names[at].astype(np.int64), matrix.astype(np.float32) if narrow else matrix) for at, matrix in _vectors(column)]


def gather(queries: DataFrame) -> tuple[list, np.ndarray]:
    """qid and vector of all queries; their size is checked before they are collected."""
    n, d = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    if n * (d or 0) > MOST_NUMBERS:
        raise ValueError(f"{n} queries of {d} numbers are too many to send to every task: deal them to several calls")
    found = collected(queries)
    if len(found) > 1:
        raise ValueError("the queries' vectors have different lengths")
    return (found[0][0].tolist(), found[0][1].astype(float)) if found else ([], np.zeros((0, d or 0)))


class Best:
    """The k best of each query so far: distance, then id. The rows that are offered come in any order.

    A matrix product in float tells which pairs may be among the best (in double, if too many may); only these are
    scored exactly. Numbers that it cannot take, and l1, are scored without it."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str, skip_self: bool) -> None:
        self.ids, self.q, self.k, self.metric, self.skip_self = ids, q, k, metric, skip_self
        self.names = np.zeros((len(ids), 0), np.int64)
        self.scores = np.zeros((len(ids), 0))
        self.seen = 0

    def offer(self, names: np.ndarray, matrix: np.ndarray) -> None:
        names, at = np.asarray(names, np.int64), 0
        while at < len(names) and len(self.ids):
            size = min(max(FIRST, self.seen), ROWS)  # few rows first: their limits leave few pairs of those that follow
            own, x = names[at : at + size], matrix[at : at + size]
            wide = min(self.k, self.scores.shape[1] + len(own))
            more = ((0, 0), (0, wide - self.scores.shape[1]))
            self.names, self.scores = np.pad(self.names, more), np.pad(self.scores, more, constant_values=np.inf)
            base: dict = {}
            for i in range(0, len(self.ids), QUERIES):
                self._offer(slice(i, i + QUERIES), own, x, base)
            self.seen += len(own)
            at += len(own)

    def _offer(self, part: slice, names: np.ndarray, x: np.ndarray, base: dict) -> None:
        q, wide = self.q[part], self.scores.shape[1]
        limit = self.scores[part, self.k - 1] if wide == self.k else np.full(len(q), np.inf)
        full = bool(np.isfinite(limit).all())
        same = None if full or not self.skip_self else self.ids[part][:, None] == names[None]
        a, b = _candidates(self.metric, q, x, base, limit, None if full else self.k, same)
        if self.skip_self:
            other = self.ids[part][a] != names[b]
            a, b = a[other], b[other]
        if not len(a):
            return
        value = _of_pairs(self.metric, q, a, x, b)
        some = np.unique(a)
        row = np.concatenate([np.repeat(some, wide), a])
        name = np.concatenate([self.names[part][some].ravel(), names[b]])
        value = np.concatenate([self.scores[part][some].ravel(), np.where(np.isnan(value), np.inf, value)])
        order = np.lexsort((name, value, row))
        row, name, value = row[order], name[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < wide
        self.names[part.start + row[keep], place[keep]] = name[keep]
        self.scores[part.start + row[keep], place[keep]] = value[keep]

    def batch(self) -> pa.RecordBatch:
        keep = np.isfinite(self.scores)
        value = -self.scores[keep] if self.metric == "ip" else self.scores[keep]
        qid = np.broadcast_to(self.ids[:, None], self.scores.shape)[keep]
        return pa.RecordBatch.from_arrays([pa.array(qid), pa.array(self.names[keep]), pa.array(value)], ["qid", "vec_id", "distance"])


def _near(names: np.ndarray, matrix: np.ndarray, ids: np.ndarray, q: np.ndarray, metric: str, within: float, skip_self: bool):
    most = -within if metric == "ip" else within
    for j in range(0, len(names), ROWS):
        own, x, base = names[j : j + ROWS], matrix[j : j + ROWS], {}
        for i in range(0, len(ids), QUERIES):
            part = slice(i, i + QUERIES)
            a, b = _candidates(metric, q[part], x, base, np.full(len(ids[part]), float(most)))
            value = _of_pairs(metric, q[part], a, x, b)
            keep = value <= most
            if skip_self:
                keep &= ids[part][a] != own[b]
            a, b, value = a[keep], b[keep], value[keep]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[part][a]), pa.array(own[b]), pa.array(-value if metric == "ip" else value)], ["qid", "vec_id", "distance"])


_FOUND = "qid bigint, vec_id bigint, distance double"


def _scored(base: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, metric: str, skip_self: bool, within: float | None) -> DataFrame:
    def rows(it):
        best = Best(ids, q, k, metric, skip_self)
        for batch in it:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for at, matrix in _vectors(batch.column(1)):
                if len(ids) and matrix.shape[1] == q.shape[1]:
                    if within is not None:
                        yield from _near(names[at], matrix, ids, q, metric, within, skip_self)
                    else:
                        best.offer(names[at], matrix)
        if within is None and best.names.shape[1]:
            yield best.batch()

    return map_arrow(base, rows, _FOUND)


def _blocks(base: DataFrame, queries: DataFrame, n: int, numbers: int, k: int, metric: str, skip_self: bool, within: float | None, most: int) -> DataFrame:
    """Blocks of queries against blocks of the base: every pair of blocks once, each a partition of its own."""
    left, right, parts = block_pairs(base, queries.select("qid", "q"), n, numbers, most)
    left, right = left.select("p", "id", F.col("v").cast("array<double>").alias("v"), F.lit(True).alias("asks")), right.select("p", "id", F.col("v").cast("array<double>").alias("v"), F.lit(False).alias("asks"))

    def pair(it):
        sides = {}
        for batch in it:
            p, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            names = batch.column(1).to_numpy(zero_copy_only=False)
            for at, matrix in _vectors(batch.column(2)):
                for side in (True, False):
                    own = asks[at].astype(bool) == side
                    for number in np.unique(p[at[own]]).tolist():
                        rows = own & (p[at] == number)
                        sides.setdefault((number, side, matrix.shape[1]), []).append((names[at[rows]], matrix[rows]))
        for (number, side, d), left in sides.items():
            if not side or (number, False, d) not in sides:
                continue
            asked, q = np.concatenate([x[0] for x in left]), np.concatenate([x[1] for x in left])
            best = Best(asked, q, k, metric, skip_self)
            for names, matrix in sides[number, False, d]:
                if within is not None:
                    yield from _near(names, matrix, asked, q, metric, within, skip_self)
                else:
                    best.offer(names, matrix)
            if within is None:
                yield best.batch()

    return map_arrow(left.unionByName(right).repartitionById(parts, "p"), pair, _FOUND)


def block_pairs(base: DataFrame, queries: DataFrame, n: int, numbers: int, most: int) -> tuple[DataFrame, DataFrame, int]:
    """The queries and the base (p, id, v) with a row for each pair of blocks that they are in, whose number is p, and how
    many pairs there are. A block has most numbers at most (but for chance), or BLOCK_NUMBERS if those are fewer."""
    most = min(most, BLOCK_NUMBERS)
    across, down = math.ceil(numbers / most), max(1, math.ceil(base.count() * max(1, numbers // max(1, n)) / most))
    number = lambda name, parts: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = queries.select(number("qid", across).alias("a"), every(down).alias("b"), F.col("qid").cast("bigint").alias("id"), F.col("q").alias("v"))
    right = base.select(every(across).alias("a"), number("vec_id", down).alias("b"), F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("v"))
    p = (F.col("a") * down + F.col("b")).cast("int").alias("p")
    return left.select(p, "id", "v"), right.select(p, "id", "v"), across * down


def against(base: DataFrame, queries: DataFrame, most: int = MOST_NUMBERS) -> DataFrame:
    """Every row of the base beside every query (qid, q, ...): a query set of a checked size goes to every task, a
    larger one meets the base in blocks."""
    n, d = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    if n * (d or 0) <= most:
        return base.join(F.broadcast(queries))
    across, down = math.ceil(n * d / most), max(1, math.ceil(base.count() * d / most))
    number = lambda name, parts: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = base.withColumn("__a", every(across)).withColumn("__b", number("vec_id", down))
    return left.join(queries.withColumn("__a", number("qid", across)).withColumn("__b", every(down)), ["__a", "__b"]).drop("__a", "__b")


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return -scores("ip", q, x)


def _powers(q: np.ndarray, x: np.ndarray, p: float) -> np.ndarray:
    out = np.empty((len(q), len(x)))
    for j in range(0, len(x), 4096):
        columns = np.ascontiguousarray(x[j : j + 4096].T)
        for i in range(0, len(q), step := max(1, CACHED // columns.shape[1])):
            sums = np.zeros((len(q[i : i + step]), columns.shape[1]))
            for d in range(len(columns)):
                sums += np.power(np.abs(q[i : i + step, d, None] - columns[d]), p)
            out[i : i + step, j : j + 4096] = sums
    return np.power(out, 1.0 / p)


#: Name -> the values of all pairs of queries and points, bit for bit those of functions.vectors (powers but for rounding).
VALUES = {
    "l2sq": lambda q, x: scores("l2", q, x),
    "l2": lambda q, x: np.sqrt(scores("l2", q, x)),
    "l1": lambda q, x: scores("l1", q, x),
    "ip": _dots,
    "ip_distance": lambda q, x: 1 - _dots(q, x),
    "cosine": lambda q, x: scores("cosine", q, x),
    "fast_l2": lambda q, x: _fold((x * x).T)[None] - 2 * _dots(q, x),
    "minkowski3": lambda q, x: _powers(q, x, 3.0),
}


def distances(base: DataFrame, queries: DataFrame, name: str, value, most: int = MOST_NUMBERS) -> DataFrame:
    """qid, vec_id, distance of every query and every row of the base. name: of VALUES, for vectors of finite numbers and
    of the queries' largest length. value(q, embedding) is the same as a column, for pairs with any other vector. Nothing
    but what is sent with the function moves: a task's rows meet all queries, a block of results at a time."""
    base = base.select(F.col("vec_id").cast("bigint"), "embedding")
    queries = queries.select(F.col("qid").cast("bigint"), "q")
    n, d = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    odd = lambda pairs: pairs.select("qid", "vec_id", value(F.col("q"), F.col("embedding")).cast("double").alias("distance"))
    if n * (d or 0) > most:
        return odd(against(base, queries, most))
    finite = lambda c: ~F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) > 1e100))
    plain = lambda name, c: F.coalesce(F.col(name).isNotNull() & (F.size(c) == (d or -2)) & finite(c), F.lit(False))
    there, asks = plain("vec_id", "embedding"), plain("qid", "q")
    ids, q = next(iter(collected(queries.where(asks))), (np.zeros(0, np.int64), np.zeros((0, 0))))
    q = q.astype(float)

    def rows(it):
        for batch in it:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for at, matrix in _vectors(batch.column(1)):
                for i in range(0, len(at) if len(ids) else 0, step := max(1, (1 << 19) // len(ids))):
                    own, x = names[at[i : i + step]], matrix[i : i + step]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(x))), pa.array(np.tile(own, len(ids))), pa.array(VALUES[name](q, x).ravel())], ["qid", "vec_id", "distance"])

    found = map_arrow(base.where(there), rows, _FOUND)
    if not base.where(~there).isEmpty():
        found = found.unionByName(odd(against(base.where(~there), queries, most)))
    if len(ids) < n:
        found = found.unionByName(odd(against(base.where(there), queries.where(~asks), most)))
    return found


def nearest_of_labels(base: DataFrame, queries: DataFrame, k: int, most: int = MOST_NUMBERS) -> DataFrame:
    """The k nearest of each query among the points of each label. base: vec_id, embedding, labels. qid, vec_id, label,
    distance (squared), rank. A task keeps the best of each label that it meets, as long as they are not too many numbers;
    then it gives them and begins anew."""
    each = base.select(F.col("vec_id").cast("bigint"), "embedding", F.explode(F.array_distinct("labels")).alias("label"))
    n, d = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    near = Window.partitionBy("qid", "label").orderBy("distance", "vec_id")
    if n * (d or 0) > most:
        found = against(each, queries, most).where("embedding IS NOT NULL AND q IS NOT NULL").select("qid", "vec_id", "label", V.l2sq(F.col("q"), F.col("embedding")).alias("distance")).where("distance < double('infinity')")
        return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    sides = collected(queries)
    kept = max(1, (1 << 22) // max(1, k * sum(len(ids) for ids, _ in sides)))  # labels at once

    def rows(it):
        best: dict[str | None, list[Best]] = {}

        def given():
            for label, all_lengths in best.items():
                for one in all_lengths:
                    found = one.batch()
                    yield pa.RecordBatch.from_arrays([*found.columns[:2], pa.array([label] * len(found), pa.string()), found.column(2)], ["qid", "vec_id", "label", "distance"])
            best.clear()

        for batch in it:
            names, labels = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(2).to_pylist(), object)
            for at, matrix in _vectors(batch.column(1)):
                by: dict = {}
                for i, label in enumerate(labels[at].tolist()):
                    by.setdefault(label, []).append(i)
                for label, own in by.items():
                    if label not in best and len(best) >= kept:
                        yield from given()
                    for one in best.setdefault(label, [Best(ids, q, k, "l2", False) for ids, q in sides]):
                        if one.q.shape[1] == matrix.shape[1]:
                            one.offer(names[at[own]], matrix[own])
        yield from given()

    found = map_arrow(each, rows, "qid bigint, vec_id bigint, label string, distance double")
    return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def nearest(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", skip_self: bool = False, within: float | None = None, most: int = MOST_NUMBERS) -> DataFrame:
    """base: vec_id, embedding; queries: qid, q. Returns qid, vec_id, distance and rank (from 1). With within,
    all rows at that distance or nearer (ip: of that inner product or more), k being ignored. most: the queries'
    numbers that go to every task; beyond, blocks are joined."""
    if k < 1 and within is None:
        raise ValueError("k must be positive")
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric}: one of {sorted(V.METRICS)}")
    base = base.select(F.col("vec_id").cast("bigint"), "embedding")
    n, d = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    if n * (d or 0) > most:
        found = _blocks(base, queries, n, n * d, k, metric, skip_self, within, most)
    else:
        # queries of several lengths go out one length after another
        found = None
        for ids, q in collected(queries) or [(np.zeros(0, np.int64), np.zeros((0, 0)))]:
            part = _scored(base, ids, q, k, metric, skip_self, within)
            found = part if found is None else found.unionByName(part)
    near = F.desc("distance") if metric == "ip" else F.asc("distance")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(near, "vec_id")))
    return found if within is not None else found.where(F.col("rank") <= k)


def best_of(scored: DataFrame, k: int, by: str = "qid", descending: bool = False) -> DataFrame:
    """The k best rows of each query, each vec_id once. scored: qid, vec_id, distance and more. descending: the
    largest first, as for inner products."""
    near = F.desc("distance") if descending else F.asc("distance")
    best = scored.withColumn("again", F.row_number().over(Window.partitionBy(by, "vec_id").orderBy(near))).where("again = 1").drop("again")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(near, "vec_id"))).where(F.col("rank") <= k)



def nearest_centers(points: DataFrame, centers: DataFrame, k: int = 1) -> DataFrame:
    """points: vec_id, embedding; centers: center, embedding. vec_id, center, distance, rank: here every point
    is a query over the few centers, so the centers are what is sent, and nothing is shuffled."""
    names, c = gather(centers.select(F.col("center").alias("qid"), F.col("embedding").alias("q")))
    names = np.array(names, np.int64)

    def rows(it):
        for batch in it:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at, matrix in _vectors(batch.column(1)):
                if not len(names) or matrix.shape[1] != c.shape[1]:
                    continue
                for i in range(0, len(at), step := max(1, (1 << 22) // len(names))):
                    ids = every[at[i : i + step]]
                    s = scores("l2", c, matrix[i : i + step]).T
                    m = min(k, len(names))
                    order = np.lexsort((np.broadcast_to(names, s.shape), s), axis=1)[:, :m]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids, m)), pa.array(names[order.ravel()]), pa.array(np.take_along_axis(s, order, 1).ravel()), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(ids)))],
                        ["vec_id", "center", "distance", "rank"],
                    )

    return map_arrow(points.select(F.col("vec_id").cast("bigint"), "embedding"), rows, "vec_id bigint, center bigint, distance double, rank int")
