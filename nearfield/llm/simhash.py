"""SimHash near-duplicates: fingerprints, a popcount grid, and components.

A fingerprint's 32 two-bit segments are mapped to their bit counts. The Manhattan distance of two such count
vectors never exceeds the Hamming distance of the fingerprints, so pairs within DISTANCE bits lie within
DISTANCE of each other there. The grid cuts the vector into blocks: of b blocks at most DISTANCE can differ,
so b - DISTANCE of them agree exactly, and each choice of that many blocks with their counts is a cell. Two
fingerprints that link share a cell, and a range join by cell finds all links; a coarse Manhattan bound
and then the exact distance are checked. More blocks make finer cells and more copies of a fingerprint; their
number follows that of the fingerprints and changes only the cost.

Equal fingerprints are one node. Since only components are wanted, dense groups need not be expanded into
pairs: each cell's members are first linked to a few pivots of the cell; then the join looks only for links
between different components, in cells that still hold several. Every link is thus found or implied.

near_duplicates links by the fingerprints alone. similar_texts asks for a similarity of the texts' sets of shingles:
the grid's links are confirmed by it exactly, and since a text that is 0.8 similar has about 10 other bits, which no
grid of 4 bits reaches, min-hash bands add the candidates beyond, between components that the grid has left apart.

Cases: null counts as empty; texts without words have fingerprint zero and link like any other; fewer than
WORDS words are one shingle; repeated rows give a row each; a row without an id links like any other and lends no id to
its component, which is null where no row has one; other columns are not read. Texts are taken whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import shingles
from .components import components
from .ranges import LEAST
from .shared import written
from .shingles import hashes_of
from .text import pick, whole
from .word_bpe import parts

WORDS, DISTANCE = 4, 4
#: Members that a cell may hold on average before blocks are made finer.
CROWD = 64
#: A cell of more texts that are not linked yet is compared in blocks.
FEW = 8


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes. The result is a signed long."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    return fingerprint_of(hashes_of(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and fp, a long."""

    def rows(it):
        for batch in it:
            for part in parts(batch, rows=500):
                fps = [fingerprint(t, words) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_arrow(pick(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint")), rows, "doc_id bigint, fp bigint")


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """The fewest blocks whose cells hold CROWD random fingerprints or fewer on average: a two-bit segment's
    count has 1.5 bits of information."""
    b = distance + 2
    while b < 16 and n / 2 ** (48 * (b - distance) / b) > CROWD:
        b += 1
    return b


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(fp: Column, blocks: int, distance: int = DISTANCE) -> Column:
    """The fingerprint's cells: array of the counts in each choice of blocks, by the choice's number."""
    pairs = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(pairs), F.call_function("shiftrightunsigned", fp, F.lit(1)).bitwiseAND(pairs)
    counts = low.bitwiseXOR(high).bitwiseOR(F.call_function("shiftleft", low.bitwiseAND(high), F.lit(1)))  # low + high
    edges = [32 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << 2 * edges[i + 1]) - 1) ^ ((1 << 2 * edges[i]) - 1) for i in range(blocks)]
    return F.array(*(counts.bitwiseAND(F.lit(_signed(sum(chosen)))) for chosen in combinations(masks, blocks - distance)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def manhattan(a: Column, b: Column, segments: int = 8) -> Column:
    """The distance of the counts in 8-bit segments: at most that of the finer ones, and cheaper."""
    total = F.lit(0)
    for i in range(segments):
        mask = F.lit(_signed(0xFF << 8 * i))
        total = total + F.abs(F.bit_count(a.bitwiseAND(mask)) - F.bit_count(b.bitwiseAND(mask)))
    return total


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _within_cells(grid: DataFrame, near, checked, known: DataFrame | None = None, crowded=None) -> DataFrame:
    """grid: cell, node, root (what the node is known to link to) and what near compares of x and y. known: the links
    behind the roots, as node and root. node and root of all nodes that link after the links within cells. crowded: takes
    the rows (with n, their cell's number) of cells that hold more than FEW after the pivots and gives their links, so that
    no pair becomes a row there."""
    columns = [c for c in grid.columns if c != "cell"]
    ways = {"p": F.min_by, "q": F.max_by, "r": lambda c, by: F.min_by(c, F.xxhash64(by))}
    pivots = grid.groupBy("cell").agg(*(way(c, "node").alias(f"{k}_{c}") for k, way in ways.items() for c in columns)).where("p_node <> q_node")
    y = F.explode(F.array(*(F.struct(*(F.col(f"{k}_{c}").alias(c) for c in columns)) for k in ways))).alias("y")
    apart = lambda test: test & near(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
    to_pivots = grid.join(pivots, "cell").select(F.struct(*columns).alias("x"), y).where(apart(F.col("x.root") != F.col("y.root")))
    edges = checked(to_pivots.select(*_pairs(F.col("x.node"), F.col("y.node"))).distinct())
    if known is not None:
        edges = edges.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b")))
    first = written(components(edges))

    grid = grid.drop("root").join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = grid.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("cell", "n")
    grid = written(grid.join(mixed, "cell"))
    few = grid if crowded is None else grid.where(F.col("n") <= FEW)
    x, y = few.alias("x"), few.alias("y")
    between = x.join(y, (F.col("x.cell") == F.col("y.cell")) & apart(F.col("x.root") < F.col("y.root")))
    found = checked(between.select(*_pairs(F.col("x.node"), F.col("y.node"))).distinct())
    if crowded is not None:
        found = found.unionByName(crowded(grid.where(F.col("n") > FEW).select("cell", "n", "node", "root")))
    return components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))


def link(nodes: DataFrame, distance: int = DISTANCE, checked=lambda pairs: pairs) -> DataFrame:
    """nodes: node, of any type that has an order, and fp. node and root, the smallest node that links lead to, for the
    nodes that link to another. checked: takes pairs a, b within the distance and gives those that link."""
    nodes = written(nodes)
    choices = F.posexplode(cells(F.col("fp"), blocks_for(nodes.count(), distance), distance)).alias("choice", "counts")
    grid = nodes.select("node", "fp", choices).select(F.struct("choice", "counts").alias("cell"), "node", "fp", F.col("node").alias("root"))

    def near(x, y) -> Column:
        return (manhattan(x("fp"), y("fp")) <= distance) & (hamming(x("fp"), y("fp")) <= distance)

    return _within_cells(grid, near, checked)


def _components_of(rows: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """rows (doc_id and key) with root and component_id; a key without links is its own component. The smallest ids of the
    components are written, so that a join by a component of a great many keys can be split."""
    own = rows.groupBy(key).agg(F.min("doc_id").alias("least")).join(roots, F.col(key) == F.col("node"), "left").select(key, "least", F.coalesce("root", key).alias("root"))
    own = written(own)
    ids = written(own.groupBy("root").agg(F.min("least").alias("component_id")))
    return rows.join(own.join(ids, "root").select(key, "root", "component_id"), key)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links lead to. A row for each input row."""
    fps = written(fingerprints(docs, id_col, text_col, words))
    roots = written(link(fps.select(F.col("fp").alias("node"), "fp").distinct(), distance))
    return _components_of(fps, roots, "fp").select("doc_id", "fp", "component_id")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = shingles.WORDS, similarity: float = shingles.SIMILARITY, distance: int = DISTANCE) -> DataFrame:
    """doc_id, mark (the text's hash), root (the component) and component_id, the smallest doc_id that links of such
    similarity lead to. A row for each input row."""
    docs = pick(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("mark", F.xxhash64("text"))

    def signed(it):
        for batch in it:
            for part in parts(batch, text=2, rows=500):
                found = [shingles.hashes_of(t, words) for t in part.column(2).cast(pa.binary()).to_pylist()]
                sets = [np.unique(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([shingles.long_hash(x.tobytes()) for x in sets], pa.int64()), pa.array(map(fingerprint_of, found), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(shingles.bands, sets), pa.list_(pa.int64()))],
                    ["doc_id", "mark", "key", "fp", "size", "bands"],
                )

    rows = written(map_arrow(docs.select("doc_id", "mark", "text"), signed, "doc_id bigint, mark bigint, key bigint, fp bigint, size bigint, bands array<bigint>"))
    # one of the rows that have a set of shingles stands for it: their texts may differ in order and in repeats
    own_id = F.coalesce("doc_id", F.lit(LEAST)).alias("id")
    chosen = rows.groupBy("key").agg(F.min(F.struct(own_id, "mark", "fp", "size", "bands")).alias("s"))
    nodes = written(chosen.select(F.col("key").alias("node"), "s.*"))
    texts = written(docs.select(own_id, "mark", "text").join(nodes.select("id", "mark", "node"), ["id", "mark"]).groupBy("node").agg(F.min("text").alias("text")))
    checked = lambda pairs: shingles.confirmed(pairs, texts, words, similarity)

    roots = written(link(nodes.select("node", "fp"), distance, checked))
    grid = nodes.select("node", "size", F.explode("bands").alias("cell")).join(roots, "node", "left").select("cell", "node", "size", F.coalesce("root", "node").alias("root"))
    mixed = grid.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell")
    # sets that differ in size by more cannot be so similar
    sizes = lambda x, y: F.least(x("size"), y("size")) >= F.lit(similarity - 1e-9) * F.greatest(x("size"), y("size"))
    crowded = lambda cells: shingles.linked_within(cells, texts, words, similarity)
    every = _within_cells(written(grid.join(mixed, "cell", "left_semi")), sizes, checked, roots, crowded)
    return _components_of(rows.select("doc_id", "mark", "key"), written(every), "key").select("doc_id", "mark", "root", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = shingles.WORDS, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """The rows of docs, unchanged: of each component of similar texts the one of smallest id, of that id the text whose
    hash is smallest, once. A row without an id cannot be told from others like it and stays."""
    groups = similar_texts(docs, id_col, text_col, words, similarity).where("doc_id IS NOT NULL")
    first = groups.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("f")).select(F.col("f.doc_id").alias("__id"), F.col("f.mark").alias("__mark"))
    own = docs.withColumn("__id", F.col(f"`{id_col}`").cast("bigint")).withColumn("__mark", F.xxhash64(whole(F.col(f"`{text_col}`"))))
    stay = own.join(first, ["__id", "__mark"], "left_semi").dropDuplicates(["__id", "__mark"])
    return stay.unionByName(own.where("__id IS NULL")).drop("__id", "__mark")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    df = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
