"""Clustering: medoids, seeding, Lloyd steps, residuals, samples and shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2sq
from ..shipping import map_arrow
from .knn import BLOCK_NUMBERS, _vectors, block_pairs, gather, nearest_centers, scores
from .quantize import plus_plus

#: Blocks on each side of all pairs of points at least, where there are points enough: their pairs are what tasks share.
AT_LEAST_BLOCKS = 6


def centroid(points: DataFrame, *keys: str) -> DataFrame:
    """The mean of each dimension, as an array, by the keys (at most one, a whole number): each task adds up its rows'
    vectors, and a row a task and key is shuffled."""
    key = F.col(keys[0]).cast("bigint") if keys else F.lit(0).cast("bigint")

    def sums(it):
        total: dict[tuple, list] = {}
        for batch in it:
            by = batch.column(0).to_numpy(zero_copy_only=False)
            for at, matrix in _vectors(batch.column(1)):
                for k in np.unique(by[at]).tolist():
                    own = matrix[by[at] == k]
                    now = total.setdefault((k, matrix.shape[1]), [0, 0.0])
                    now[0] += len(own)
                    now[1] = now[1] + own.sum(0)
        for (k, _), (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.float64()))], ["k", "n", "s"])

    parts = map_arrow(points.select(key.alias("k"), F.col("embedding").cast("array<double>")), sums, "k bigint, n bigint, s array<double>")
    add = lambda rows: F.aggregate(F.transform(rows, lambda r: r["s"]), F.transform(F.get(rows, F.lit(0))["s"], lambda x: F.lit(0.0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    found = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("n", "s"))).alias("rows"))  # a row a task
    return found.select(*([F.col("k").alias(keys[0])] if keys else []), F.transform(add(F.col("rows")), lambda x: x / F.col("n")).alias("embedding"))


def medoid(points: DataFrame) -> DataFrame:
    """vec_id of the point nearest the centroid, ties to the smaller id."""
    c = centroid(points).select(F.col("embedding").alias("c"))
    near = points.join(F.broadcast(c)).select("vec_id", l2sq(F.col("embedding"), F.col("c")).alias("distance"))
    return near.agg(F.min(F.struct("distance", "vec_id")).alias("m")).select("m.vec_id")


def distance_sums(points: DataFrame, numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """vec_id and total: the sum of a point's distances to all points of its length. Blocks of points, of so many numbers,
    meet blocks of points, each pair of blocks a partition of its own, which gives a number a point."""
    n, d = points.agg(F.count("*"), F.max(F.size("embedding"))).first()
    own = points.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    most = min(numbers, max(1, n * (d or 0) // AT_LEAST_BLOCKS))
    left, right, parts = block_pairs(own, own.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), n, max(1, n * (d or 0)), most)

    def pair(it):
        sides: dict[tuple, list] = {}
        for batch in it:
            p, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            names = batch.column(1).to_numpy(zero_copy_only=False)
            for at, matrix in _vectors(batch.column(2)):
                for number in np.unique(p[at]).tolist():
                    for side in (True, False):
                        rows = (p[at] == number) & (asks[at].astype(bool) == side)
                        sides.setdefault((number, matrix.shape[1], side), []).append((names[at[rows]], matrix[rows]))
        for (number, d, side), rows in sides.items():
            if side and (number, d, False) in sides:
                others = np.concatenate([x[1] for x in sides[number, d, False]])
                for ids, x in rows:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_summed(x, others))], ["vec_id", "part"])

    both = left.withColumn("asks", F.lit(True)).unionByName(right.withColumn("asks", F.lit(False))).repartitionById(parts, "p")
    return map_arrow(both, pair, "vec_id bigint, part double").groupBy("vec_id").agg(F.sum("part").alias("total"))


def _summed(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Each row's sum of distances to the others. Squares come from a matrix product; where its rounding would show in
    the root, as between near points, they are worked out from the differences."""
    out, middle = np.zeros(len(x)), others.mean(0) if len(others) else 0.0
    with np.errstate(over="ignore", invalid="ignore"):
        x, others = x - middle, others - middle
        nx, no = np.einsum("nd,nd->n", x, x), np.einsum("nd,nd->n", others, others)
        left = np.concatenate([-2 * x, np.ones((len(x), 1)), nx[:, None]], 1)
        right = np.concatenate([others, no[:, None], np.ones((len(others), 1))], 1)
        if not np.isfinite(left).all() or not np.isfinite(right).all():
            return np.sqrt(scores("l2", x, others)).sum(1)
        for j in range(0, len(others), 2048):
            for i in range(0, len(x), 128):
                s = left[i : i + 128] @ right[j : j + 2048].T
                least = 1e-3 * (nx[i : i + 128].max(initial=0.0) + no[j : j + 2048].max(initial=0.0))
                close = np.flatnonzero(s.ravel() < least)
                if len(close):
                    a, b = close // s.shape[1], close % s.shape[1]
                    for c in range(0, len(a), 4096):
                        diff = x[i + a[c : c + 4096]] - others[j + b[c : c + 4096]]
                        s[a[c : c + 4096], b[c : c + 4096]] = np.einsum("nd,nd->n", diff, diff)
                out[i : i + 128] += np.sqrt(s, out=s).sum(1)
    return out


def medoid_by_sum(points: DataFrame, digits: int = 6) -> DataFrame:
    """vec_id of the point with the smallest sum of distances to all points, sums rounded, ties to the smaller id."""
    total = distance_sums(points).select(F.round("total", digits).alias("total"), "vec_id")
    return total.agg(F.min(F.struct("total", "vec_id")).alias("m")).select("m.vec_id")


def lloyd_step(points: DataFrame, centers: DataFrame) -> DataFrame:
    """center and its new embedding: the mean of the points nearest it; a center without points becomes zero. Points
    are scored and added up in one pass, and a row a task and center is shuffled."""
    names, c = gather(centers.select(F.col("center").alias("qid"), F.col("embedding").alias("q")))
    order = np.argsort(np.array(names, np.int64), kind="stable")
    names, c = np.array(names, np.int64)[order], c[order]

    def sums(it):
        n, total = np.zeros(len(names), np.int64), np.zeros(c.shape)
        for batch in it:
            for _, matrix in _vectors(batch.column(0)):
                if matrix.shape[1] == c.shape[1]:
                    own = scores("l2", matrix, c).argmin(1)
                    np.add.at(total, own, matrix)
                    n += np.bincount(own, minlength=len(names))
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(names[hit]), pa.array(n[hit]), pa.array(total[hit].tolist(), pa.list_(pa.float64()))], ["center", "n", "s"])

    parts = map_arrow(points.select(F.col("embedding").cast("array<double>")), sums, "center bigint, n bigint, s array<double>")
    rows = parts.groupBy("center").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("s")).alias("rows"))  # a row a task
    total = F.aggregate("rows", F.transform(F.get("rows", F.lit(0)), lambda x: F.lit(0.0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    new = rows.select("center", F.transform(total, lambda x: x / F.col("n")).alias("embedding"))
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    return centers.select("center", zero.alias("zero")).join(new, "center", "left").select("center", F.coalesce("embedding", "zero").alias("embedding"))


def seeds(points: DataFrame, k: int, sample: int = 65_536, seed: int = 42) -> DataFrame:
    """center and embedding: k-means++ over the sample whose ids hash lowest, which is the bound."""
    rows = points.where("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    found = plus_plus(x, k, seed) if len(x) else x
    return points.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(found)], "center bigint, embedding array<double>")


def kmeans(points: DataFrame, centers: DataFrame, rounds: int = 12, gain: float = 1e-5) -> DataFrame:
    """Lloyd steps until the summed distance falls by less than the gain. The centers are few, and are the
    only thing that comes to the driver between rounds."""
    spark, before = points.sparkSession, None
    for _ in range(rounds):
        centers = spark.createDataFrame(lloyd_step(points, centers).collect(), "center bigint, embedding array<double>")
        now = nearest_centers(points, centers).agg(F.sum("distance")).first()[0] or 0.0
        if now < 1e-12 or before is not None and (before - now) / now < gain:
            break
        before = now
    return centers


def residuals(points: DataFrame, centers: DataFrame) -> DataFrame:
    """vec_id, center, residual: the point minus its nearest center. Centers are a set of a checked size."""
    names, c = gather(centers.select(F.col("center").alias("qid"), F.col("embedding").alias("q")))
    names = np.array(names, np.int64)

    def rows(it):
        for batch in it:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, matrix in _vectors(batch.column(1)):
                if len(names) and matrix.shape[1] == c.shape[1]:
                    s = scores("l2", matrix, c)
                    own = np.lexsort((np.broadcast_to(names, s.shape), s), axis=1)[:, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(names[own]), pa.array((matrix - c[own]).tolist(), pa.list_(pa.float64()))], ["vec_id", "center", "residual"])

    return map_arrow(points.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")), rows, "vec_id bigint, center bigint, residual array<double>")


def drawn(rows: DataFrame, share: float, id_col: str = "vec_id", seed: int = 0) -> DataFrame:
    """About that share of the rows, by a hash of their ids: the same rows whatever the partitions."""
    return rows.where(_uniform(id_col, seed) < share)


def _uniform(id_col: str, seed: int):
    """From 0 to 1, by the first 8 hex digits of an MD5: any engine gives the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def some_ids(rows: DataFrame, n: int, id_col: str = "vec_id", seed: int = 0) -> DataFrame:
    """n different ids at random, in ascending order."""
    return rows.select(id_col).distinct().orderBy(_uniform(id_col, seed), id_col).limit(n).orderBy(id_col)


def partition(points: DataFrame, parts: int, copies: int = 2, rounds: int = 12) -> DataFrame:
    """vec_id, center: seeded, run and dealt to the nearest centers, for a fixed count of parts."""
    return nearest_centers(points, kmeans(points, seeds(points, parts), rounds), copies).select("vec_id", "center")


def shards_within(points: DataFrame, budget: float, dim: int, degree: int = 32, copies: int = 2, most: int = 64) -> DataFrame:
    """vec_id, center: three parts, and two more as long as the largest part's estimated memory exceeds the budget
    (bytes), up to most."""
    n = 3
    while True:
        homes = partition(points, n, copies, 4)
        largest = homes.groupBy("center").count().agg(F.max("count")).first()[0] or 0
        if n + 2 > most or ram_estimate(largest, dim, degree) <= budget:
            return homes
        n += 2


def ram_estimate(points: int, dim: int, degree: int = 32) -> float:
    """Bytes of an index in memory: vectors and edges, a tenth more for the rest."""
    return points * (dim * 4 + degree * 4 * 1.3) * 1.1
