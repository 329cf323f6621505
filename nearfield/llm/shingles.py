"""Sets of word shingles: their hashes, min-hash bands that find similar ones, and the exact similarity.

Two texts are similar if the Jaccard similarity of their sets of shingles (runs of WORDS words, lower-cased) reaches
SIMILARITY. Candidates agree in all ROWS min-hashes of one of BANDS bands; at similarity 0.8 a pair fails to become
one with probability 0.00007. Every candidate is confirmed by its shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow, ship

WORDS, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 24, 5, 42
#: Rows of a crowded cell that meet in a task, twice.
BLOCK = 256
_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_TIMES, _MIX = _RANDOM[0] | np.uint64(1), _RANDOM[1]


def hashes_of(text: bytes, words: int) -> np.ndarray:
    """XXH64 of the text's shingles in order, repeats included. Fewer words are one shingle; no words, none."""
    parts = text.lower().split()  # both of ASCII alone, for bytes
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    w = min(words, len(parts))
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(parts) - w + 1].tolist(), ends[w - 1 :].tolist())), np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The hashes of the text's different shingles, sorted."""
    return np.unique(hashes_of(text, words))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of shingles; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def bands(found: np.ndarray) -> list[int]:
    """A signed long a band; none for a text without words."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1 << 12):
        least = np.minimum(least, ((found[i : i + (1 << 12)][None] ^ _MIX) * _TIMES).min(1))
    return [long_hash(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]


def long_hash(data: bytes, seed: int = SEED) -> int:
    x = xxhash.xxh64_intdigest(data, seed)
    return x - (1 << 64) if x >> 63 else x


def confirmed(pairs: DataFrame, texts: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """pairs: a, b; texts: node, text. The pairs whose texts are similar."""
    schema = pairs.select("a", "b").schema

    def rows(it):
        for batch in it:
            a, b = (batch.column(i).cast(pa.binary()) for i in (2, 3))
            near = [similarity(shingles(x.as_py(), words), shingles(y.as_py(), words)) >= least for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    left, right = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b"), rows, schema)


def linked(sets: list[np.ndarray], roots: list, least: float = SIMILARITY, columns: int = 1 << 13) -> list[tuple[int, int]]:
    """Places of similar sets, so many pairs as join all roots that similar sets join. Shared shingles are counted for
    all pairs at once, some columns at a time."""
    n, sizes = len(sets), np.array([len(s) for s in sets], float)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often > 1
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)
    for first in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(column, [first, first + columns])
        marks = np.zeros((n, columns), np.float32)
        marks[owner[lo:hi], column[lo:hi] - first] = 1
        common += marks @ marks.T
    near = common >= least * (sizes[:, None] + sizes[None] - common.astype(float)) - 1e-9
    top = {r: r for r in roots}

    def find(r):
        while top[r] != r:
            top[r] = top[top[r]]
            r = top[r]
        return r

    out = []
    for i, j in np.argwhere(np.triu(near, 1)).tolist():
        a, b = find(roots[i]), find(roots[j])
        if a != b:
            top[b] = a
            out.append((i, j))
    return out


def linked_within(rows: DataFrame, texts: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """rows: cell, n (of its rows), node, root; texts: node, text. Links a, b between similar texts of a cell, enough to
    join their roots. A cell is cut into blocks of BLOCK rows, and every two blocks meet in a task: no pair is a row."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root").join(texts, "node")

    def group(table: pa.Table) -> pa.Table:
        nodes, roots = table.column("node").to_pylist(), table.column("root").to_pylist()
        found = linked([shingles(t, words) for t in table.column("text").cast(pa.binary()).to_pylist()], roots, least) if len(set(roots)) > 1 else []
        return pa.table({"a": pa.array([min(nodes[x], nodes[y]) for x, y in found], pa.int64()), "b": pa.array([max(nodes[x], nodes[y]) for x, y in found], pa.int64())})

    ship(rows.sparkSession)
    return rows.groupBy("cell", "i", "j").applyInArrow(group, "a bigint, b bigint").distinct()
