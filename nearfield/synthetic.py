"""Synthetic vectors and labels, the same for a seed whatever the partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_LABELS = 5000


def uniform(*parts) -> Column:
    """From 0 to 1, exclusive of both, by a hash of the parts."""
    return (F.pmod(F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(*parts) -> Column:
    return F.sqrt(-2 * F.log(uniform("radius", *parts))) * F.cos(2 * math.pi * uniform("angle", *parts))


def vectors(spark: SparkSession, n: int, dim: int, kind: str = "float", norm: float | None = None, scale: float | None = None, seed: int = 42) -> DataFrame:
    """vec_id and embedding. float: normal numbers, of that norm if one is given, else times the scale; int8 and uint8:
    whole numbers over the type's range, or, with a norm, rounded vectors of that norm."""
    if kind not in ("float", "int8", "uint8") or n < 0 or dim < 1:
        raise ValueError("kinds are float, int8 and uint8; n is not negative and dim positive")
    rows = spark.range(n).select(F.col("id").alias("vec_id"))
    place = F.sequence(F.lit(1), F.lit(dim))
    if kind == "float" or norm is not None:
        raw = F.transform(place, lambda i: normal(seed, F.col("vec_id"), i))
        rows = rows.withColumn("v", raw)
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        factor = F.lit(float(norm)) / length if norm is not None else F.lit(float(scale or 1.0))
        made = F.transform("v", lambda x: x * factor)
        if kind == "int8":
            made = F.transform(made, lambda x: F.greatest(F.least(F.round(x), F.lit(127.0)), F.lit(-128.0)))
        if kind == "uint8":
            made = F.transform(made, lambda x: F.least(F.abs(F.round(x)), F.lit(255.0)))
        return rows.select("vec_id", made.cast("array<float>").alias("embedding"))
    low = -128 if kind == "int8" else 0
    made = F.transform(place, lambda i: F.floor(uniform(seed, F.col("vec_id"), i) * 256) + low)
    return rows.select("vec_id", made.cast("array<float>").alias("embedding"))


def labels(spark: SparkSession, n: int, count: int, kind: str = "zipf", seed: int = 42) -> DataFrame:
    """vec_id and labels (numbers from 1, as text). zipf: the i-th with probability 0.7 / i, up to its share of the
    points; random: each with one half; one_per_point: one each. A point without any gets 0."""
    if not 1 <= count <= MOST_LABELS:
        raise ValueError(f"from 1 to {MOST_LABELS} labels")
    rows = spark.range(n).select(F.col("id").alias("vec_id"))
    every = F.sequence(F.lit(1), F.lit(count))
    if kind == "one_per_point":
        made = F.array(F.floor(uniform(seed, F.col("vec_id")) * count).cast("int") + 1)
    elif kind == "random":
        made = F.filter(every, lambda i: uniform(seed, F.col("vec_id"), i) < 0.5)
    elif kind == "zipf":
        made = F.filter(every, lambda i: uniform(seed, F.col("vec_id"), i) < F.lit(0.7) / i)
    else:
        raise ValueError("kinds are zipf, random and one_per_point")
    named = F.transform(made, lambda i: i.cast("string"))
    return rows.select("vec_id", F.when(F.size(made) == 0, F.array(F.lit("0"))).otherwise(named).alias("labels"))
