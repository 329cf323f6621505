"""Proximity graphs as edge tables (src, dst): statistics, walks, unions and repair after deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Tables of levels that one plan reads.
MOST_PARTS = 16

def degree_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Over all nodes (vec_id), also those without edges."""
    degree = nodes.join(edges.groupBy(F.col("src").alias("vec_id")).agg(F.count("*").alias("d")), "vec_id", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    return degree.agg(F.max("d").alias("max_degree"), F.avg("d").alias("avg_degree"), F.min("d").alias("min_degree"), F.count_if(F.col("d") < 2).alias("below_two"))


def levels(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """vec_id and level of every node that can be reached from the starts (vec_id), or is within so many steps of them.
    Each round joins only the newest level with the edges."""
    edges = written(edges.select("src", "dst"))  # read in every round
    return levels_by(lambda front: edges.join(front.select(F.col("vec_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("vec_id")), starts, most)


def levels_by(step, starts: DataFrame, most: int | None = None, enough: int | None = None) -> DataFrame:
    """The same, where step(front) gives the neighbours (vec_id) of a level's nodes. enough: ends with the level that
    brings so many nodes. Rounds are written, and joined to one table now and then, so plans do not grow."""
    front = written(starts.select("vec_id").distinct().withColumn("level", F.lit(0)))
    seen, level, parts, n = front, 0, 1, front.count() if enough else 0
    while (most is None or level < most) and (enough is None or n < enough):
        level += 1
        front = written(step(front).distinct().join(seen, "vec_id", "left_anti").select("vec_id", F.lit(level).alias("level")))
        new = front.count()
        if not new:
            break
        seen, parts, n = seen.unionByName(front), parts + 1, n + new
        if parts > MOST_PARTS:
            seen, parts = written(seen), 1
    return seen


def capped(edges: DataFrame, most: int) -> DataFrame:
    """edges with a distance: each node's nearest so many, each neighbour once, without loops."""
    best = edges.where("src <> dst").groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))).where(F.col("place") <= most).drop("place")


def repaired(edges: DataFrame, deletes: DataFrame) -> DataFrame:
    """Edges among live nodes: a deleted neighbour gives way to its own live neighbours."""
    gone = deletes.select("vec_id")
    live = edges.join(gone.withColumnRenamed("vec_id", "src"), "src", "left_anti")
    kept = live.join(gone.withColumnRenamed("vec_id", "dst"), "dst", "left_anti").select("src", "dst")
    cut = live.join(gone.withColumnRenamed("vec_id", "dst"), "dst", "left_semi").select("src", F.col("dst").alias("via"))
    beyond = edges.join(gone.withColumnRenamed("vec_id", "dst"), "dst", "left_anti").select(F.col("src").alias("via"), "dst")
    return kept.unionByName(cut.join(beyond, "via").select("src", "dst")).where("src <> dst").distinct()


def compacted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the nodes only, renumbered from 0 in the order of vec_id.

    Numbers come from counts of id ranges, so no task sorts all nodes: a range's first number is the count of
    all ranges before it."""
    width = 1 << 16
    ranged = nodes.select("vec_id").distinct().withColumn("part", F.floor(F.col("vec_id") / width))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("vec_id")) - 1
    number = ranged.withColumn("at", place).join(before, "part").select("vec_id", (F.col("base") + F.col("at")).alias("number"))
    out = edges.join(number.select(F.col("vec_id").alias("src"), F.col("number").alias("new_src")), "src")
    return out.join(number.select(F.col("vec_id").alias("dst"), F.col("number").alias("new_dst")), "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))
