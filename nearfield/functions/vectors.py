"""Vector functions as column expressions over array<float> (or any number), worked out in double.

Sums run from the first element to the last, so that results agree bit for bit with any engine that does the
same. Vectors of different length are infinitely far apart; a null vector gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _pairs(a: Column, b: Column, term) -> Column:
    return total(F.zip_with(a, b, lambda x, y: term(_d(x), _d(y))))


def _checked(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.lit(float("inf"))).otherwise(value)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return _pairs(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y)


def l2sq(a: Column, b: Column) -> Column:
    return _checked(a, b, _pairs(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2sq(a, b))


def l1(a: Column, b: Column) -> Column:
    return _checked(a, b, _pairs(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: float) -> Column:
    if p in (1, 2):
        return l1(a, b) if p == 1 else l2(a, b)
    return _checked(a, b, F.pow(_pairs(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(1.0 / p)))


def norm2(v: Column) -> Column:
    return total(F.transform(v, lambda x: _d(x) * _d(x)))


def norm(v: Column) -> Column:
    return F.sqrt(norm2(v))


def norm1(v: Column) -> Column:
    return total(F.transform(v, lambda x: F.abs(_d(x))))


def cosine(a: Column, b: Column) -> Column:
    """1 - cos, in [0, 2]; 1 if either vector is zero."""
    na, nb = norm2(a), norm2(b)
    cos = _pairs(a, b, lambda x, y: x * y) / (F.sqrt(na) * F.sqrt(nb))
    return _checked(a, b, F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1 - F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0))))


def ip_distance(a: Column, b: Column) -> Column:
    return _checked(a, b, F.when(F.size(a) == 0, F.lit(0.0)).otherwise(1 - dot(a, b)))


def fast_l2(base: Column, query: Column) -> Column:
    """|x|^2 - 2<x, q>: orders points as the squared distance does."""
    return norm2(base) - 2 * dot(base, query)


def normalize(v: Column) -> Column:
    """A zero vector stays as it is."""
    return normalize_whole(v)


def normalize_whole(v: Column) -> Column:
    """normalize, with the norm worked out once for the vector and not for each number. A zero vector stays."""
    return F.get(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n == 0, _d(x)).otherwise(_d(x) / n))), F.lit(0))


def inverse_root(x: Column) -> Column:
    """1 / sqrt(x); null unless x is positive."""
    return F.when(x > 0, 1 / F.sqrt(_d(x)))


def mips_base(v: Column, most: Column) -> Column:
    """Scaled by the largest norm, with the coordinate that makes it a unit vector."""
    return F.concat(F.transform(v, lambda x: _d(x) / most), F.array(F.sqrt(F.greatest(F.lit(0.0), 1 - norm2(v) / (most * most)))))


def mips_query(v: Column) -> Column:
    return F.concat(normalize(v), F.array(F.lit(0.0)))


def int8_encode(v: Column, bias: float, scale: float) -> Column:
    """Scalar quantisation, cut off towards zero; what is beyond a byte becomes its nearest end."""
    return F.transform(v, lambda x: F.greatest(F.least(((_d(x) - bias) * 254 / scale).cast("int"), F.lit(127)), F.lit(-128)).cast("tinyint"))


def uint8_encode(v: Column, bias: float, scale: float) -> Column:
    """(x - bias) * scale, cut off towards zero and held within a byte."""
    return F.transform(v, lambda x: F.greatest(F.least(((_d(x) - bias) * scale).cast("int"), F.lit(255)), F.lit(0)).cast("smallint"))


def int8_decode(v: Column, bias: float, scale: float) -> Column:
    return F.transform(v, lambda x: (_d(x) - bias) * scale)


#: Name -> (column expression, whether smaller is nearer, whether it is a metric).
METRICS = {"l2": (l2sq, True, True), "l1": (l1, True, True), "cosine": (cosine, True, False), "ip": (dot, False, False)}
