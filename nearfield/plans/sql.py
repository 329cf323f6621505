"""Pieces of DuckDB SQL that the queries' SQL is put together from."""

from __future__ import annotations


def total(v: str) -> str:
    return f"list_reduce({v}, lambda s, x: s + x, 0.0::DOUBLE)"


def pairs(a: str, b: str, term: str) -> str:
    """The sum of a term in x and y over both lists, from the first element on."""
    term = term.replace("x", "p[1]::DOUBLE").replace("y", "p[2]::DOUBLE")
    return total(f"list_transform(list_zip({a}, {b}), lambda p: {term})")


def l2sq(a: str, b: str) -> str:
    return pairs(a, b, "(x - y) * (x - y)")


def dot(a: str, b: str) -> str:
    return pairs(a, b, "x * y")


def l1(a: str, b: str) -> str:
    return pairs(a, b, "@(x - y)")


def norm2(v: str) -> str:
    return total(f"list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)")


def cosine(a: str, b: str) -> str:
    cos = f"{dot(a, b)} / (sqrt({norm2(a)}) * sqrt({norm2(b)}))"
    return f"(CASE WHEN {norm2(a)} = 0 OR {norm2(b)} = 0 THEN 1.0::DOUBLE ELSE 1 - greatest(least({cos}, 1.0), -1.0) END)"


Q = "q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 100 = 0)"
POINTS = """pts AS (SELECT vec_id, embedding, list_concat(list_concat([label::VARCHAR], CASE WHEN vec_id % 50 = 0 THEN ['U'] ELSE [] END),
  CASE WHEN vec_id % 3 = 0 THEN [((label + vec_id) % 10)::VARCHAR] ELSE [] END) AS labels FROM embeddings)"""
DELETES = "dels AS (SELECT vec_id FROM embeddings WHERE vec_id % 7 = 3)"
CENTERS = "cen AS (SELECT vec_id AS center, embedding FROM embeddings WHERE vec_id < 8)"


def ranked(distance: str = "distance", k: int = 10, by: str = "qid", order: str = "") -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {distance} {order}, vec_id) <= {k}"


def knn(distance: str, k: int = 10, base: str = "embeddings", where: str = "true", order: str = "") -> str:
    """qid, vec_id, distance, rank."""
    return f"""SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance {order}, vec_id)::INTEGER AS rank
      FROM (SELECT qid, vec_id, {distance} AS distance FROM q CROSS JOIN {base} WHERE {where}) {ranked('distance', k, order=order)}"""


#: The exact graph: each point's eight nearest others.
GRAPH = f"""edges AS (SELECT src, dst, distance FROM (SELECT a.vec_id AS src, b.vec_id AS dst, {l2sq('a.embedding', 'b.embedding')} AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY src ORDER BY distance, dst) <= 8)"""
