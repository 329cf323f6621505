"""Point labels: parsing, dictionaries, universal labels, splitting of dense points, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse(line: Column) -> Column:
    """A comma-separated line, without carriage returns and line feeds, as a sorted array."""
    return F.array_sort(F.split(F.regexp_replace(line, "[\r\n]", ""), ","))


def matches(labels: Column, wanted: Column, universal: str | None = None) -> Column:
    """Whether a point with these labels answers a filter; the universal label answers any."""
    hit = F.array_contains(labels, wanted)
    return hit | F.array_contains(labels, F.lit(universal)) if universal is not None else hit


def dictionary(points: DataFrame, universal: str | None = None) -> DataFrame:
    """points: vec_id, labels. label and its number by first appearance (vec_id, then place in the array):
    from 1, or from 2 where there is a universal label, which has 0. Sorts the different labels, not points."""
    seen = points.select("vec_id", F.posexplode("labels").alias("at", "label")).groupBy("label").agg(F.min(F.struct("vec_id", "at")).alias("first"))
    if universal is None:
        return seen.select("label", F.row_number().over(Window.orderBy("first")).alias("number"))
    rest = seen.where(F.col("label") != universal).select("label", (F.row_number().over(Window.orderBy("first")) + 1).alias("number"))
    return rest.unionByName(seen.where(F.col("label") == universal).select("label", F.lit(0).alias("number")))


def expanded(points: DataFrame, universal: str) -> DataFrame:
    """vec_id, label: a point with the universal label gets every label. The label list is what is sent."""
    each = points.select("vec_id", F.explode("labels").alias("label")).distinct()
    every = each.select("label").where(F.col("label") != universal).distinct()
    wide = each.where(F.col("label") == universal).select("vec_id").join(every)
    return each.where(F.col("label") != universal).unionByName(wide).distinct()


def broken_up(points: DataFrame, most: int, first_new: int) -> DataFrame:
    """vec_id, real_id, labels: a point of more than so many labels is split; its first part keeps its id, the
    others are numbered from first_new in the order of (vec_id, part)."""
    parts = points.select("vec_id", F.posexplode("labels").alias("at", "label")).groupBy("vec_id", F.floor(F.col("at") / most).alias("part"))
    parts = parts.agg(F.sort_array(F.collect_list(F.struct("at", "label"))).alias("x")).select("vec_id", "part", F.transform("x", lambda y: y["label"]).alias("labels"))
    # numbers come from counts of id ranges, so no task sorts all extra parts
    extra = parts.where("part > 0").withColumn("range", F.floor(F.col("vec_id") / (1 << 16)))
    before = extra.groupBy("range").agg(F.count("*").alias("n"))
    before = before.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("vec_id", "part")) - 1
    extra = extra.withColumn("place", place).join(before, "range").withColumn("new", F.col("base") + F.col("place") + first_new)
    return parts.where("part = 0").select("vec_id", F.col("vec_id").alias("real_id"), "labels").unionByName(extra.select(F.col("new").cast("bigint").alias("vec_id"), F.col("vec_id").alias("real_id"), "labels"))


def unknown(points: DataFrame, wanted: DataFrame, universal: str | None = None) -> DataFrame:
    """wanted: label. The labels that no point answers: none, where some point has the universal label."""
    each = points.select(F.explode("labels").alias("label")).distinct()
    found = wanted.select("label").distinct().join(each, "label", "left_anti")
    if universal is None:
        return found
    return found.join(each.where(F.col("label") == universal).select(F.lit(1).alias("one")).limit(1), how="left_anti")


def of_shards(points: DataFrame, shards: DataFrame) -> DataFrame:
    """points: vec_id, labels; shards: shard, vec_id. The label lines of each shard's points."""
    return shards.select("shard", "vec_id").join(points.select("vec_id", F.array_join("labels", ",").alias("line")), "vec_id")


def by_frequency(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n labels at random, a label in proportion to how many points have it: those of the (point, label) rows that
    hash lowest. A row a draw, numbered from 0."""
    each = points.select("vec_id", F.posexplode("labels").alias("at", "label"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string"), F.col("at").cast("string")))
    drawn = each.withColumn("order", order).orderBy("order", "vec_id", "at").limit(n)
    return drawn.select((F.row_number().over(Window.orderBy("order", "vec_id", "at")) - 1).alias("draw"), "label")  # n rows


def stats(points: DataFrame, dense: int) -> DataFrame:
    """One row: points, labels, pairs, labels a point, points a label, share of points with so many labels."""
    n = F.size("labels")
    by_point = points.agg(F.count("*").alias("points"), F.sum(n).cast("bigint").alias("pairs"), (F.count_if(n >= dense) / F.count("*")).alias("dense_share"))
    by_label = points.select(F.explode("labels").alias("label")).agg(F.countDistinct("label").alias("labels"))
    return by_point.join(by_label).select("points", "labels", "pairs", (F.col("pairs") / F.col("points")).alias("labels_a_point"), (F.col("pairs") / F.col("labels")).alias("points_a_label"), "dense_share")
