"""Recall and percentile reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall(truth: DataFrame, found: DataFrame, k: int, descending: bool = False) -> DataFrame:
    """qid, recall in percent. The truth's first k rows count, and all further ones as near as the k-th. descending: the
    largest distance is the best, as for inner products."""
    near = Window.partitionBy("qid").orderBy(F.desc("distance") if descending else F.asc("distance"))
    right = truth.withColumn("place", F.rank().over(near)).where(F.col("place") <= k).select("qid", "vec_id")
    hits = found.where(F.col("rank") <= k).select("qid", "vec_id").distinct().join(right, ["qid", "vec_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("n"))
    return right.select("qid").distinct().join(hits, "qid", "left").select("qid", (F.coalesce("n", F.lit(0)) * 100.0 / k).alias("recall"))


def recall_of_sets(truth: DataFrame, found: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, recall in percent of all true rows; a query without any has 100."""
    n = truth.groupBy("qid").agg(F.count("*").alias("n"))
    hits = truth.join(found, ["qid", "vec_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("h"))
    out = queries.select("qid").join(n, "qid", "left").join(hits, "qid", "left")
    return out.select("qid", F.when(F.coalesce("n", F.lit(0)) == 0, 100.0).otherwise(F.coalesce("h", F.lit(0)) * 100.0 / F.col("n")).alias("recall"))


def percentiles(values: DataFrame, column: str, shares: list[float], ranges: int = 256) -> DataFrame:
    """share and the value at position floor(share * n) of the sorted values, the last at most. Equal values are
    counted first; the different ones are dealt to ranges, whose counts are all that the driver sees, and each range is
    ranked by itself."""
    spark = values.sparkSession
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    bounds = sorted(set(counts.approxQuantile("value", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    number = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= F.col("value"))) if bounds else F.lit(0)
    counts = counts.withColumn("range", number)
    sizes = sorted((r.range, r.n) for r in counts.groupBy("range").agg(F.sum("n").alias("n")).collect())
    total, before, wanted = sum(n for _, n in sizes), 0, []
    for number, n in sizes:
        for share in shares:
            at = min(math.floor(share * total), total - 1)
            if before <= at < before + n:
                wanted.append((number, share, at - before))
        before += n
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("range").orderBy("value")))
    asked = spark.createDataFrame(wanted, "range int, share double, at bigint")
    return upto.join(asked, (upto["range"] == asked["range"]) & (F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at"))).select("share", "value")


def gate(recalls: DataFrame, least: float) -> float:
    """The mean of the queries' recall in percent; an error if it is below the least."""
    mean = recalls.agg(F.avg("recall")).first()[0] or 0.0
    if mean < least:
        raise ValueError(f"recall {mean:.2f} is below {least:.2f}")
    return mean


def merged_recall(spark, parts: int, k: int, each: int, queries: int, seed: int = 42) -> DataFrame:
    """qid and recall in percent, by throws: if the true k nearest lie in parts at random and each part gives its each
    best, so many of them are found."""
    rows = spark.range(queries).select(F.col("id").alias("qid"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i"))
    part = F.pmod(F.xxhash64(F.lit(seed), "qid", "i"), F.lit(parts))
    found = rows.groupBy("qid", part.alias("part")).agg(F.least(F.count("*"), F.lit(each)).alias("n"))
    return found.groupBy("qid").agg((F.sum("n") * 100.0 / k).alias("recall"))


def latencies(times: DataFrame, column: str = "seconds") -> DataFrame:
    """One row: count, queries a second of one thread, mean, 99.9th percentile (the value at that position)."""
    n = times.agg(F.count("*").alias("n"), F.avg(column).alias("mean"), (F.count("*") / F.sum(column)).alias("a_second"))
    return n.join(percentiles(times, column, [0.999]).select(F.col("value").alias("p999")))
