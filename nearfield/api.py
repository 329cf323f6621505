"""VectorIndex and its specification, searches asked for in JSON, and SQL functions."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import METRICS
from .operators import knn, maintenance, vamana
from .operators.proximity import ALPHAS
from .shipping import ship
from .sources.vector_files import load_index, save_index
from .storage import written


class BuildError(ValueError):
    """Points that no index can be built from."""


class SearchError(ValueError):
    """A search that cannot be met."""


def error_code(error: BaseException | None) -> int:
    """0 success, 1 invalid argument, 2 out of memory, 3 files, 4 build, 5 search."""
    if error is None:
        return 0
    return next((code for kind, code in ((BuildError, 4), (SearchError, 5), (MemoryError, 2), (OSError, 3)) if isinstance(error, kind)), 1)


class Searches(Protocol):
    """What can be searched: queries (qid, q) to (qid, vec_id, distance, rank)."""

    def search(self, queries: DataFrame, k: int, width: int, beam: int = 1) -> DataFrame: ...


class Quantizes(Protocol):
    """What can stand for vectors by codes."""

    def encode(self, x: np.ndarray) -> np.ndarray: ...

    def decode(self, codes: np.ndarray) -> np.ndarray: ...

    def distances(self, queries: np.ndarray, metric: str = "l2") -> np.ndarray: ...


@dataclass(frozen=True)
class IndexSpec:
    """What an index is built with. labelled: pruning and entry points heed labels. universal: the label that answers
    any filter. fill: nodes are filled up to the degree. frozen: random start points a shard."""

    dim: int
    metric: str = "l2"
    degree: int = 32
    build_width: int = 64
    shard_rows: int = vamana.SHARD_ROWS
    copies: int = 2
    alphas: tuple[float, ...] = field(default=ALPHAS)
    fill: bool = False
    labelled: bool = False
    universal: str | None = None
    frozen: int = 0
    seed: int = 42

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric}")
        if min(self.dim, self.degree, self.build_width, self.shard_rows, self.copies) < 1:
            raise ValueError("dim, degree, build_width, shard_rows and copies must be positive")
        if self.frozen < 0 or not self.alphas or min(self.alphas) < 1:
            raise ValueError("frozen must not be negative, and alphas are 1 at least")
        if self.universal is not None and not self.labelled:
            raise ValueError("a universal label needs labels")


class VectorIndex:
    """A searchable collection: nodes (see vamana) and the ids that are deleted but not yet taken out."""

    def __init__(self, nodes: DataFrame, spec: IndexSpec, deletes: DataFrame | None = None) -> None:
        self.nodes, self.spec = nodes, spec
        self.deletes = nodes.sparkSession.createDataFrame([], "vec_id bigint") if deletes is None else deletes

    @classmethod
    def build(cls, points: DataFrame, spec: IndexSpec) -> VectorIndex:
        """points: vec_id, embedding, labels if the spec wants them. The nodes are written, so that no search builds
        them again."""
        n, different, low, high = points.agg(F.count("*"), F.countDistinct("vec_id"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if not n:
            raise BuildError("an index needs points")
        if different != n:
            raise BuildError(f"{n - different} points have no id or one that another has")
        if low is not None and (low, high) != (spec.dim, spec.dim):
            raise BuildError(f"vectors have {low} to {high} numbers, not {spec.dim}")
        if spec.labelled and "labels" not in points.columns:
            raise BuildError("the points have no labels")
        return cls(written(vamana.build(points, spec.degree, spec.build_width, spec.shard_rows, spec.copies, spec.metric, spec.alphas, spec.fill, spec.labelled, spec.universal, spec.frozen, spec.seed)), spec)

    @property
    def points(self) -> DataFrame:
        """vec_id, embedding and labels of the points that are live."""
        rows = self.nodes.where("NOT hidden").select("vec_id", "embedding", "labels").dropDuplicates(["vec_id"])
        return maintenance.live(rows, self.deletes)

    @property
    def edges(self) -> DataFrame:
        return vamana.edges(self.nodes, self.spec.degree)

    def exact(self, queries: DataFrame, k: int) -> DataFrame:
        return knn.nearest(self.points, queries, k, self.spec.metric)

    def search(self, queries: DataFrame, k: int, width: int, beam: int = 1, nearest_start: bool = False, fast: bool = False) -> DataFrame:
        """qid, vec_id, distance, rank. With a column wanted, a query meets only points that have such a label; a
        label that no point has is an error, unless points have the universal one."""
        if "wanted" in queries.columns:
            kind = dict(queries.dtypes)["wanted"]
            wanted = queries.select((F.explode("wanted") if kind.startswith("array") else F.col("wanted")).alias("label"))
            vamana.known_labels(self.nodes, wanted.where("label IS NOT NULL"), self.spec.universal)
        if not 0 < k <= width or beam < 1:
            raise SearchError("k must be from 1 to the width, and the beam positive")
        return vamana.search(self.nodes, queries, k, width, beam, self.spec.metric, self.spec.universal, self.deletes, nearest_start, fast)

    def search_with_points(self, queries: DataFrame, k: int, width: int, beam: int = 1) -> DataFrame:
        """The same with the points' vectors and labels."""
        return self.search(queries, k, width, beam).join(self.points, "vec_id")

    def within(self, queries: DataFrame, radius: float, exact: bool = True, low: int = 10, high: int = 400) -> DataFrame:
        """qid, vec_id, distance, rank of all live points within the radius, or those that walks of a width from low
        to high reach."""
        if exact:
            return knn.nearest(self.points, queries, 1, self.spec.metric, within=radius)
        found = vamana.within(self.nodes, queries, radius, low, high, self.spec.metric)
        return knn.best_of(maintenance.live(found.drop("rank"), self.deletes), 1 << 30, descending=self.spec.metric == "ip")

    def insert(self, new: DataFrame) -> DataFrame:
        """Links the new points; returns the ids that are rejected."""
        s = self.spec
        new = written(new)
        grown, rejected = vamana.insert(self.nodes, new, s.copies, s.degree, s.build_width, s.metric, s.labelled, s.universal)
        rejected = written(rejected)
        self.nodes = written(grown)
        return rejected

    def delete(self, ids: DataFrame) -> DataFrame:
        """Marks the ids deleted; returns those that are not live."""
        own = self.nodes.where("NOT hidden").select("vec_id").distinct()
        deletes, failed = maintenance.lazy_delete(own, self.deletes, ids)
        failed = written(failed)
        self.deletes = written(deletes)
        return failed

    def consolidate(self) -> DataFrame:
        """Takes the deleted points out of the graph; returns a report of one row."""
        before = self.status().select("points", "deleted", "live", F.col("edges").alias("edges_before"))
        before = written(before)
        self.nodes = written(vamana.remove(self.nodes, self.deletes, self.spec.degree, self.spec.metric))
        self.deletes = self.nodes.sparkSession.createDataFrame([], "vec_id bigint")
        return before.join(self.status().select(F.col("edges").alias("edges_after")))

    def status(self) -> DataFrame:
        return vamana.status(self.nodes, self.deletes)

    def by_id(self, ids: list[int]) -> DataFrame:
        """vec_id, embedding and neighbours of live points."""
        rows = self.nodes.where(F.col("vec_id").isin(*ids) & ~F.col("hidden")).groupBy("vec_id").agg(F.first("embedding").alias("embedding"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("neighbours")))).alias("neighbours"))
        return maintenance.live(rows, self.deletes)

    def starts(self) -> DataFrame:
        """shard, vec_id and embedding of the entry points."""
        return self.nodes.where("start").select("shard", "vec_id", "embedding")

    def save(self, folder: str) -> None:
        save_index(folder, self.nodes, {"spec": asdict(self.spec)}, self.deletes)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> VectorIndex:
        nodes, deletes, meta = load_index(spark, folder)
        spec = meta["spec"]
        return cls(nodes, IndexSpec(**spec | {"alphas": tuple(spec["alphas"])}), deletes)


REQUEST = "query_id bigint, query array<float>, k int, Ls int"


def answer(points: DataFrame, requests: DataFrame, metric: str = "l2", tags: DataFrame | None = None, partition: int | None = None, timed: bool = False) -> DataFrame:
    """requests: value, JSON with query_id, query, k and Ls. A JSON answer each: query_id, indices, distances; or
    query_id and error for an empty query or k outside 1..Ls. tags: vec_id and tag, answered beside the ids. partition:
    answered as given. timed: also time_taken_in_us, a request's share of the search."""
    asked = requests.select(F.from_json("value", REQUEST).alias("r")).select("r.*")
    bad = F.when(F.col("query").isNull() | (F.size("query") == 0), "empty query").when(F.col("k").isNull() | (F.col("k") < 1) | (F.col("k") > F.coalesce("Ls", "k")), "k must be from 1 to Ls")
    asked = asked.withColumn("error", bad)
    good = asked.where("error IS NULL")
    began = time.time()
    most, n = good.agg(F.max("k"), F.count("*")).first()
    found = knn.nearest(points, good.select(F.col("query_id").alias("qid"), F.col("query").alias("q")), most or 1, metric)
    if timed:
        found = written(found)
    took = int((time.time() - began) * 1e6 / max(1, n))
    if tags is not None:
        found = found.join(tags.select("vec_id", "tag"), "vec_id", "left")
    rows = found.join(good.select(F.col("query_id").alias("qid"), "k"), "qid").where("rank <= k").groupBy(F.col("qid").alias("query_id"))
    columns = ["rank", "vec_id", "distance", *(["tag"] if tags is not None else [])]
    rows = rows.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("x"))
    out = asked.select("query_id", "error").join(rows, "query_id", "left")
    part = lambda name: F.transform("x", lambda y: y[name])
    more = [part("tag").alias("tags")] if tags is not None else []
    more += [F.lit(partition).alias("partition")] if partition is not None else []
    more += [F.lit(took).alias("time_taken_in_us")] if timed else []
    return out.select(F.to_json(F.struct("query_id", part("vec_id").alias("indices"), part("distance").alias("distances"), *more, "error")).alias("value"))


class AnnSearch:
    """The table function ann_search: of one shard's nodes, the nearest to a query."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.asked: tuple | None = None

    def eval(self, row, query: list, k: int, width: int, metric: str):
        self.rows.append(row.asDict())
        self.asked = query, k, width, metric

    def terminate(self):
        if self.asked is None:
            return
        from nearfield.operators.proximity import prepared

        query, k, width, metric = self.asked
        own = vamana.Shard(pd.DataFrame(self.rows), metric)
        found = own.graph.search(prepared(metric, np.array([query], float)), max(k, width))
        for p, d in list(zip(found.positions[0].tolist(), found.distances[0].tolist()))[:k]:
            if p >= 0 and not own.hidden[p]:
                yield int(own.ids[p]), float(-d if metric == "ip" else d)


_SQL_FUNCTIONS = {
    "vec_dot": "aggregate(zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)",
    "vec_l2sq": "CASE WHEN size(a) <> size(b) THEN double('infinity') ELSE aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, x) -> s + x) END",
    "vec_l1": "CASE WHEN size(a) <> size(b) THEN double('infinity') ELSE aggregate(zip_with(a, b, (x, y) -> abs(double(x) - double(y))), 0D, (s, x) -> s + x) END",
}


def register(spark: SparkSession) -> None:
    """vec_dot, vec_l2sq and vec_l1 as SQL functions, and the table function ann_search(TABLE(nodes) PARTITION BY (shard),
    query, k, width, metric), which gives k rows a shard."""
    ship(spark)
    for name, body in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN {body}")
    spark.udtf.register("ann_search", F.udtf(AnnSearch, returnType="vec_id bigint, distance double"))
