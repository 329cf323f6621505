"""Product quantisation: chunks, codebooks, codes, decoding, distances by code, and exact search behind them.

A point's codes are one array, and a Quantizer (bounded by chunks times codes times numbers, whatever the data) goes to
the tasks with the functions that use it; so nothing is shuffled but the k best rows of each task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow, ship
from .knn import Best, _vectors, best_of, gather, scores

MOST_TRAINING_ROWS, MOST_ROTATION_ROWS, MOST_CHUNKS = 256_000, 32_768, 512
#: Rows whose distances to centers, and numbers of a matrix of distances by code, that are worked out at once.
ROWS, AT_ONCE = 1 << 14, 1 << 20


def chunk_sizes(dim: int, chunks: int) -> list[int]:
    """dim mod chunks chunks take one number more, the larger ones first."""
    return [dim // chunks + (i < dim % chunks) for i in range(chunks)]


def chunk_count(ram_gb: float, points: int, dim: int) -> int:
    """Bytes a point that fit the memory, at least one, at most dim and MOST_CHUNKS."""
    return max(1, min(int(ram_gb * (1 << 30) // max(1, points)), dim, MOST_CHUNKS))


@dataclass(frozen=True)
class Quantizer:
    """books: a matrix of centroids for each chunk. Vectors are taken less the mean, then rotated."""

    books: list[np.ndarray]
    mean: np.ndarray
    rotation: np.ndarray | None = None

    @property
    def dim(self) -> int:
        return sum(b.shape[1] for b in self.books)

    @property
    def bounds(self) -> list[tuple[int, int]]:
        ends = np.cumsum([0, *(b.shape[1] for b in self.books)]).tolist()
        return list(zip(ends, ends[1:]))

    def prepared(self, x: np.ndarray) -> np.ndarray:
        """Vectors as the books see them."""
        x = np.asarray(x, float) - self.mean
        return x if self.rotation is None else x @ self.rotation

    def distances(self, queries: np.ndarray, metric: str = "l2") -> np.ndarray:
        """[query, chunk, code]: of each query's chunk to each centroid; codes that a book lacks are at infinity."""
        q, most = self.prepared(queries), max(len(b) for b in self.books)
        out = np.full((len(q), len(self.books), most), np.inf)
        for j, ((a, b), book) in enumerate(zip(self.bounds, self.books)):
            out[:, j, : len(book)] = scores(metric, q[:, a:b], book)
        return out

    def encode(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each chunk, ties to the smaller code."""
        if not len(x):
            return np.zeros((0, len(self.books)), np.int64)
        x = self.prepared(x)
        return np.stack([scores("l2", x[:, a:b], book).argmin(1) for (a, b), book in zip(self.bounds, self.books)], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        x = np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], 1)
        return (x if self.rotation is None else x @ self.rotation.T) + self.mean

    @classmethod
    def of(cls, codebook: DataFrame) -> Quantizer:
        """codebook: chunk, code, centroid."""
        books: dict[int, list] = {}
        for r in sorted(codebook.select("chunk", "code", "centroid").collect()):
            books.setdefault(r.chunk, []).append(r.centroid)
        matrices = [np.array(books[j], float) for j in sorted(books)]
        return cls(matrices, np.zeros(sum(m.shape[1] for m in matrices)))


def plus_plus(x: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """First centers by squared distance: each is a row drawn in proportion to its distance from those before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    d = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        total = d.sum()
        i = int(np.searchsorted(np.cumsum(d), rng.random() * total, "right")) if total > 0 else len(chosen)
        chosen.append(min(i, len(x) - 1))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen].copy()


def lloyd(x: np.ndarray, centers: np.ndarray, rounds: int, gain: float = 1e-5) -> np.ndarray:
    """Until the summed distance falls by less than the gain; a center without rows becomes zero."""
    before = None
    for _ in range(rounds):
        norms, turned = (centers * centers).sum(1), -2 * centers.T
        own = np.concatenate([np.zeros(0, np.int64), *((norms + x[i : i + ROWS] @ turned).argmin(1) for i in range(0, len(x), ROWS))])
        n = np.bincount(own, minlength=len(centers))
        sums = np.stack([np.bincount(own, x[:, j], len(centers)) for j in range(x.shape[1])], 1)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], 0.0)
        now = float(((x - centers[own]) ** 2).sum())
        if now < 1e-12 or before is not None and (before - now) / now < gain:
            break
        before = now
    return centers


def _sample(points: DataFrame, most: int) -> DataFrame:
    """The rows whose ids hash lowest: a documented bound on what a quantiser learns from."""
    return points.where("embedding IS NOT NULL").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most)


def train(points: DataFrame, chunks: int, codes: int, rounds: int = 12, centre: bool = True, rotate: int = 0, sample: int = MOST_TRAINING_ROWS, seed: int = 42) -> Quantizer:
    """k-means in each chunk, the chunks side by side, over the sample. centre: less the sample's mean (for l2).
    rotate: so many rounds of a rotation that is fitted to the codes, on the driver, over MOST_ROTATION_ROWS rows."""
    ship(points.sparkSession)
    sample_rows = _sample(points, sample)
    dim = points.select(F.max(F.size("embedding"))).first()[0]
    mean = np.zeros(dim)
    if centre:
        sums = sample_rows.agg(*(F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"m{i}") for i in range(dim))).first()
        mean = np.array([x or 0.0 for x in sums])
    bounds = np.cumsum([0, *chunk_sizes(dim, chunks)]).tolist()
    if rotate:
        x = np.array([r.embedding for r in _sample(points, min(sample, MOST_ROTATION_ROWS)).collect()], float) - mean
        rotation, books = random_rotation(dim, seed), None
        for _ in range(rotate):
            y = x @ rotation
            parts = [y[:, a:b] for a, b in zip(bounds, bounds[1:])]
            books = [lloyd(p, plus_plus(p, codes, seed) if books is None else book, rounds if books is None else 1) for p, book in zip(parts, books or [None] * chunks)]
            near = np.concatenate([book[scores("l2", p, book).argmin(1)] for p, book in zip(parts, books)], 1)
            u, _, v = np.linalg.svd(x.T @ near)  # the rotation that brings x nearest to its codes
            rotation = u @ v
        return Quantizer(books, mean, rotation)

    def kmeans(key, rows: pd.DataFrame) -> pd.DataFrame:
        j = key[0]
        x = np.stack(rows.sort_values("seq").part.to_list()).astype(float) - mean[bounds[j] : bounds[j + 1]]
        c = lloyd(x, plus_plus(x, codes, seed), rounds)
        return pd.DataFrame({"chunk": j, "code": range(len(c)), "centroid": list(c)})

    cut = F.array(*(F.slice("embedding", a + 1, b - a) for a, b in zip(bounds, bounds[1:])))
    parts = sample_rows.select(F.xxhash64("vec_id").alias("seq"), F.posexplode(cut).alias("chunk", "part"))
    book = Quantizer.of(parts.groupBy("chunk").applyInPandas(kmeans, "chunk int, code int, centroid array<double>"))
    return Quantizer(book.books, mean)


def random_rotation(dim: int, seed: int = 42) -> np.ndarray:
    """An orthogonal matrix, spread evenly over all of them."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _rows(points: DataFrame, column: str, schema: str, function) -> DataFrame:
    """function(ids, matrix) -> arrays, over the rows whose vector is whole; column is the second one."""

    def rows(it):
        for batch in it:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, matrix in _vectors(batch.column(1)):
                yield pa.RecordBatch.from_arrays(*function(ids[at], matrix))

    return map_arrow(points.select(F.col("vec_id").cast("bigint"), column), rows, schema)


def _listed(matrix: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1] or 1, dtype=np.int32)), pa.array(matrix.ravel(), kind))


def encode(points: DataFrame, quantizer: Quantizer) -> DataFrame:
    """vec_id, codes (array, one a chunk) and error, the distance of a point from its decoded codes."""

    def coded(ids, matrix):
        if matrix.shape[1] != quantizer.dim:
            ids, matrix = ids[:0], np.zeros((0, quantizer.dim))
        codes = quantizer.encode(matrix)
        error = np.sqrt(((matrix - quantizer.decode(codes)) ** 2).sum(1))
        return [pa.array(ids), _listed(codes, pa.int32()), pa.array(error)], ["vec_id", "codes", "error"]

    return _rows(points, "embedding", "vec_id bigint, codes array<int>, error double", coded)


def decode(codes: DataFrame, quantizer: Quantizer) -> DataFrame:
    """vec_id, embedding: what the codes stand for."""

    def back(ids, matrix):
        return [pa.array(ids), _listed(quantizer.decode(matrix.astype(np.int64)), pa.float64())], ["vec_id", "embedding"]

    return _rows(codes, "codes", "vec_id bigint, embedding array<double>", back)


def _looked_up(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """[query, point]: summed in the order of chunks."""
    out = np.zeros((len(table), len(codes)))
    for j in range(codes.shape[1]):
        out += table[:, j, codes[:, j]]
    return out


def adc(queries: DataFrame, codes: DataFrame, quantizer: Quantizer, k: int | None = None, metric: str = "l2") -> DataFrame:
    """qid, vec_id, distance: each query's table of distances to all centroids, looked up by code. With k, the k
    nearest of each query (and rank), of which each task keeps its own."""
    ids, q = gather(queries)
    ids = np.array(ids, np.int64)
    table = quantizer.distances(q, metric) if len(ids) else np.zeros((0, 0, 0))
    sign = -1 if metric == "ip" else 1

    def rows(it):
        for batch in it:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for at, matrix in _vectors(batch.column(1)):
                for i in range(0, len(at) if len(ids) else 0, step := max(1, (1 << 22) // max(1, len(ids)))):
                    own = names[at[i : i + step]]
                    d = _looked_up(table, matrix[i : i + step].astype(np.int64))
                    n = np.broadcast_to(own, d.shape)
                    if k is not None:
                        order = np.lexsort((n, d), axis=1)[:, :k]
                        d, n = np.take_along_axis(d, order, 1), np.take_along_axis(n, order, 1)
                    qid = np.broadcast_to(ids[:, None], d.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(qid.ravel()), pa.array(n.ravel()), pa.array(sign * d.ravel())], ["qid", "vec_id", "distance"])

    found = map_arrow(codes.select(F.col("vec_id").cast("bigint"), "codes"), rows, "qid bigint, vec_id bigint, distance double")
    return found if k is None else best_of(found, k, descending=metric == "ip")


def by_code(queries: DataFrame, codes: DataFrame, quantizer: Quantizer, metric: str | tuple[str, ...] = "l2") -> DataFrame:
    """qid, vec_id, distance (l2, or the inner product) of the query and what a point's codes stand for, without a
    table of distances. Several metrics give a column each, by their names."""
    return decoded_distances(queries, decode(codes, quantizer), metric)


def decoded_distances(queries: DataFrame, decoded: DataFrame, metric: str | tuple[str, ...]) -> DataFrame:
    ids, q = gather(queries)
    ids = np.array(ids, np.int64)
    metrics, columns = ((metric,), ["distance"]) if isinstance(metric, str) else (metric, list(metric))

    def rows(it):
        for batch in it:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for at, matrix in _vectors(batch.column(1)):
                for i in range(0, len(at) if len(ids) else 0, step := max(1, (1 << 19) // max(1, len(ids)))):
                    own, x = names[at[i : i + step]], matrix[i : i + step]
                    values = [pa.array((-scores(m, q, x) if m == "ip" else scores(m, q, x)).ravel()) for m in metrics]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(x))), pa.array(np.tile(own, len(ids))), *values], ["qid", "vec_id", *columns])

    return map_arrow(decoded.select(F.col("vec_id").cast("bigint"), "embedding"), rows, "qid bigint, vec_id bigint, " + ", ".join(f"{c} double" for c in columns))


def search(points: DataFrame, codes: DataFrame, queries: DataFrame, quantizer: Quantizer, k: int) -> DataFrame:
    """The k nearest in l2, exactly: codes rule rows out, whole vectors rank the rest. A row lies within its own
    quantisation error of its decoded vector, so one whose least possible distance exceeds the k-th smallest greatest
    one is not among the k. The first pass reads codes and errors alone."""
    ids, q = gather(queries)
    ids = np.array(ids, np.int64)
    table = quantizer.distances(q) if len(ids) else np.zeros((0, 0, 0))

    def bounds(it):
        far = np.full((len(ids), k), np.inf)
        for batch in it:
            error = batch.column(2).to_numpy(zero_copy_only=False)
            for at, matrix in _vectors(batch.column(1)):
                for i in range(0, len(at) if len(ids) else 0, step := max(1, AT_ONCE // max(1, len(ids)))):
                    own = np.sqrt(_looked_up(table, matrix[i : i + step].astype(np.int64))) + error[at[i : i + step]]
                    far = np.partition(np.concatenate([far, own], 1), k - 1, axis=1)[:, :k]
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(far.ravel())], ["qid", "far"])

    upper = map_arrow(codes.select("vec_id", "codes", "error"), bounds, "qid bigint, far double").where("far < double('infinity')")
    upper = upper.groupBy("qid").agg(F.sort_array(F.collect_list("far")).alias("far")).select("qid", F.get("far", F.lit(k - 1)).alias("most"))
    most = {r.qid: r.most for r in upper.collect()}  # a number a query
    limit = np.array([np.inf if most.get(i) is None else most[i] for i in ids.tolist()]) * (1 + 1e-9)  # for rounding

    def ranked(it):
        best = Best(ids, q, k, "l2", False)
        for batch in it:
            names, error = batch.column(0).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            for at, matrix in _vectors(batch.column(1)):
                if len(ids) and matrix.shape[1] == q.shape[1]:
                    own = np.stack(batch.column(2).take(pa.array(at)).to_numpy(zero_copy_only=False)).astype(np.int64)
                    near = np.zeros(len(at), bool)
                    for i in range(0, len(at), step := max(1, AT_ONCE // max(1, len(ids)))):
                        near[i : i + step] = ((np.sqrt(_looked_up(table, own[i : i + step])) - error[at[i : i + step]]) <= limit[:, None]).any(0)
                    if near.any():
                        best.offer(names[at[near]], matrix[near])
        if best.names.shape[1]:
            yield best.batch()

    both = points.select(F.col("vec_id").cast("bigint"), "embedding").join(codes, "vec_id").select("vec_id", "embedding", "codes", "error")
    return best_of(map_arrow(both, ranked, "qid bigint, vec_id bigint, distance double"), k)
