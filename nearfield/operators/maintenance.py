"""Inserts, lazy deletes and consolidation on tables of points (vec_id, ...), edges and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import repaired


def insert(points: DataFrame, new: DataFrame) -> DataFrame:
    """Points with the new ones; an id that is there already keeps its row."""
    return points.unionByName(new.dropDuplicates(["vec_id"]).join(points.select("vec_id"), "vec_id", "left_anti").select(points.columns))


def rejected(points: DataFrame, new: DataFrame) -> DataFrame:
    """The ids that insert leaves out."""
    return new.select("vec_id").join(points.select("vec_id"), "vec_id", "left_semi").distinct()


def live(points: DataFrame, deletes: DataFrame) -> DataFrame:
    return points.join(deletes.select("vec_id"), "vec_id", "left_anti")


def lazy_delete(points: DataFrame, deletes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All deletes with the new ones, and the ids that are not live and so fail."""
    now = live(points, deletes).select("vec_id")
    asked = ids.select("vec_id").distinct()
    return deletes.select("vec_id").unionByName(asked.join(now, "vec_id", "left_semi")).distinct(), asked.join(now, "vec_id", "left_anti")


def consolidate(points: DataFrame, edges: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Live points, repaired edges, and a report of one row."""
    left, fixed = live(points, deletes), repaired(edges, deletes)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    report = count(points, "points").join(count(points.join(deletes, "vec_id", "left_semi"), "deleted")).join(count(left, "live")).join(count(edges, "edges_before")).join(count(fixed, "edges_after"))
    return left, fixed, report
