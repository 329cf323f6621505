"""Vector, graph, truth and tag files as DataFrames.

A binary matrix is [rows int32][dim int32][row-major numbers]; per-row files repeat the dimension before each
row. Files are read in ranges of rows, each by its own task, through a file system that all machines reach. To write one
file, tasks write parts in the order of ids, and the driver joins the parts' bytes, a bounded piece at a time. Numbers of
32-bit integers stay whole numbers.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ..storage import get, opened, put, shared_dir, written

TYPES = {"float": np.dtype("<f4"), "int8": np.dtype("i1"), "uint8": np.dtype("u1"), "uint32": np.dtype("<u4"), "int32": np.dtype("<i4"), "uint64": np.dtype("<u8")}
#: Kinds whose numbers a float would not hold.
WHOLE = ("uint32", "int32", "uint64")
ROWS_PER_TASK, PIECE = 100_000, 1 << 26


def _schema(kind: str) -> str:
    return f"vec_id bigint, embedding array<{'bigint' if kind in WHOLE else 'float'}>"


def _lists(ids, x: np.ndarray, kind: str) -> pa.RecordBatch:
    n, d = x.shape
    numbers = pa.array(x.ravel().astype(np.int64 if kind in WHOLE else "<f4"))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(np.arange(0, n * d + 1, d, dtype=np.int32), numbers)], ["vec_id", "embedding"])


_open = opened


def header(path: str) -> tuple[int, int]:
    """Rows and dimension of a binary matrix; negative rows or no dimension is an error, as is a short file."""
    where, name = _open(path)
    with where.open_input_file(name) as f:
        data = f.read(8)
    if len(data) < 8:
        raise ValueError(f"{path}: no header")
    n, d = np.frombuffer(data, "<i4").tolist()
    if n < 0 or d <= 0:
        raise ValueError(f"{path}: {n} rows of {d} numbers")
    return n, d


def _ranges(spark: SparkSession, path: str, n: int, rows: int) -> DataFrame:
    return spark.range(0, max(n, 0), rows, max(1, -(-n // rows))).select(F.lit(path).alias("path"), "id")


def read_bin(spark: SparkSession, path: str, kind: str = "float", start: int = 0, count: int | None = None, rows: int = ROWS_PER_TASK) -> DataFrame:
    """vec_id (the row's number) and embedding; start and count read a part."""
    n, d = header(path)
    stop, item = min(n, n if count is None else start + count), TYPES[kind]

    def part(it):
        for batch in it:
            for i in batch.column(1).to_pylist():
                a, b = start + i, min(start + i + rows, stop)
                where, name = _open(path)
                with where.open_input_file(name) as f:
                    f.seek(8 + a * d * item.itemsize)
                    x = np.frombuffer(f.read((b - a) * d * item.itemsize), item).reshape(b - a, d)
                yield _lists(np.arange(a, b), x, kind)

    return map_arrow(_ranges(spark, path, stop - start, rows), part, _schema(kind))


def read_rows(spark: SparkSession, path: str, kind: str = "float", rows: int = ROWS_PER_TASK) -> DataFrame:
    """Per-row files (fvecs, bvecs, ivecs)."""
    where, name = _open(path)
    item = TYPES[kind]
    size = where.get_file_info(name).size
    if not size:
        return spark.createDataFrame([], _schema(kind))
    with where.open_input_file(name) as f:
        d = int(np.frombuffer(f.read(4), "<i4")[0])
    wide = 4 + d * item.itemsize
    if d <= 0 or size % wide:
        raise ValueError(f"{path}: rows of {d} numbers do not fill it")
    n = size // wide

    def part(it):
        for batch in it:
            for a in batch.column(1).to_pylist():
                b = min(a + rows, n)
                where, name = _open(path)
                with where.open_input_file(name) as f:
                    f.seek(a * wide)
                    raw = np.frombuffer(f.read((b - a) * wide), np.uint8).reshape(b - a, wide)
                yield _lists(np.arange(a, b), np.ascontiguousarray(raw[:, 4:]).view(item), kind)

    return map_arrow(_ranges(spark, path, n, rows), part, _schema(kind))


def _joined(rows: DataFrame, order: list[str], encode, path: str, head: bytes, offset: int = 0) -> None:
    """One file of what encode (columns of a batch -> bytes) makes of the rows, in order."""
    spark = rows.sparkSession
    folder = shared_dir(spark)
    parts = max(1, spark.sparkContext.defaultParallelism)
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(it):
        from pyspark import TaskContext

        name, k = f"{folder}/{TaskContext.get().partitionId():08d}", 0
        for batch in it:
            put(f"{name}-{k:08d}", encode(batch))
            yield pa.RecordBatch.from_pydict({"path": [f"{name}-{k:08d}"]})
            k += 1

    parts = sorted(r.path for r in map_arrow(ranged, write, "path string").collect())
    where, name = opened(path)
    before = b""
    if offset:
        with where.open_input_file(name) as f:
            before = f.read(offset)
        if len(before) < offset:
            raise ValueError(f"{path}: shorter than the offset {offset}")
    with where.open_output_stream(name) as out:
        out.write(before)
        out.write(head)
        for part in parts:
            there, file = opened(part)
            with there.open_input_stream(file) as data:
                while piece := data.read(PIECE):
                    out.write(piece)


def _matrix(column, kind: str) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(TYPES[kind]).reshape(len(column), -1)


def _size(points: DataFrame) -> tuple[int, int]:
    n, low, high = points.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if n and low != high:
        raise ValueError(f"vectors have {low} to {high} numbers")
    return n, high or 0


def write_bin(points: DataFrame, path: str, kind: str = "float", offset: int = 0) -> int:
    """One binary matrix in the order of vec_id, after the first offset bytes of what the file holds. The number of
    rows is returned."""
    n, d = _size(points)
    _joined(points.select("vec_id", "embedding"), ["vec_id"], lambda batch: _matrix(batch.column(1), kind).tobytes(), path, np.array([n, d], "<i4").tobytes(), offset)
    return n


def write_rows(points: DataFrame, path: str, kind: str = "float") -> int:
    """A per-row file in the order of vec_id."""
    n, d = _size(points)

    def encode(batch) -> bytes:
        x = _matrix(batch.column(1), kind)
        return np.concatenate([np.tile(np.array([d], "<i4").view(np.uint8), (len(x), 1)), x.view(np.uint8).reshape(len(x), -1)], 1).tobytes()

    _joined(points.select("vec_id", "embedding"), ["vec_id"], encode, path, b"")
    return n


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an id and numbers, between tabs or spaces."""
    cells = F.split(F.trim(F.col("value")), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(cells, F.lit(0)).cast("bigint").alias("vec_id"), F.transform(F.slice(cells, 2, F.size(cells)), lambda x: x.cast("float")).alias("embedding"))


def _text(numbers):
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), "\t")


def write_tsv(points: DataFrame, path: str) -> None:
    points.select(F.concat_ws("\t", F.col("vec_id").cast("string"), _text("embedding")).alias("value")).write.text(path)


def write_index_tsv(nodes: DataFrame, path: str) -> None:
    """Id, vector and neighbours of each node, between tabs; lists between commas."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    nodes.select(F.concat_ws("\t", F.col("vec_id").cast("string"), listed("embedding"), listed("neighbours")).alias("value")).write.text(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0) and value of a text file, read as a stream by one task: the order is the file's."""

    def rows(it):
        for batch in it:
            for name in batch.column(0).to_pylist():
                where, file = opened(name)
                rest, number = b"", 0
                with where.open_input_stream(file) as data:
                    while piece := data.read(1 << 22):
                        *own, rest = (rest + piece).split(b"\n")
                        if own:
                            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(own))), pa.array([x.rstrip(b"\r").decode() for x in own], pa.string())], ["line", "value"])
                            number += len(own)
                if rest:
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([rest.rstrip(b"\r").decode()], pa.string())], ["line", "value"])

    return map_arrow(spark.createDataFrame([(path,)], "path string"), rows, "line bigint, value string")


def read_filters(spark: SparkSession, path: str, unique: bool = False, queries: int | None = None) -> DataFrame:
    """qid (the line) and wanted: a label for each query, or one for all. unique: a label that comes twice is an error."""
    found = lines(spark, path).where("value <> ''").select(F.col("line").alias("qid"), F.col("value").alias("wanted"))
    if unique and not found.groupBy("wanted").count().where("count > 1").isEmpty():
        raise ValueError(f"{path}: a label comes twice")
    if queries is not None:
        n = found.count()
        if n == 1:
            return spark.range(queries).select(F.col("id").alias("qid")).join(found.select("wanted"))
        if n != queries:
            raise ValueError(f"{path}: {n} labels for {queries} queries")
    return found


def read_tags(spark: SparkSession, path: str, kind: str = "uint32") -> DataFrame:
    """vec_id (the row) and tag, of a binary matrix of one column."""
    if header(path)[1] != 1:
        raise ValueError(f"{path}: tags have one column")
    return read_bin(spark, path, kind).select("vec_id", F.get("embedding", F.lit(0)).alias("tag"))


def write_truth(truth: DataFrame, path: str, k: int, distances: bool = True) -> None:
    """truth: qid, rank, vec_id, distance, k rows a query: [n][k][ids][distances] in the order of qid and rank."""
    rows = truth.where(F.col("rank") <= k).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "distance"))).alias("x"))
    rows = written(rows)  # read three times
    n, low = rows.agg(F.count("*"), F.min(F.size("x"))).first()
    if n and low != k:
        raise ValueError(f"a query has {low} of {k} rows")
    ids = rows.select("qid", F.transform("x", lambda r: r["vec_id"]).alias("v"))
    _joined(ids, ["qid"], lambda b: _matrix(b.column(1), "uint32").tobytes(), path, np.array([n, k], "<i4").tobytes())
    if distances:
        far = rows.select("qid", F.transform("x", lambda r: r["distance"]).alias("v"))
        _joined(far, ["qid"], lambda b: _matrix(b.column(1), "float").tobytes(), path, b"", 8 + 4 * n * k)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """qid, rank, vec_id, distance (null in a file of ids alone, which its size tells)."""
    n, k = header(path)
    where, name = opened(path)
    size = where.get_file_info(name).size
    if size not in (8 + 4 * n * k, 8 + 8 * n * k):
        raise ValueError(f"{path}: {size} bytes are not {n} rows of {k}")
    far = size == 8 + 8 * n * k

    def part(it):
        for batch in it:
            for a in batch.column(1).to_pylist():
                b = min(a + ROWS_PER_TASK, n)
                where, name = opened(path)
                with where.open_input_file(name) as f:
                    f.seek(8 + 4 * a * k)
                    ids = np.frombuffer(f.read(4 * (b - a) * k), "<u4").astype(np.int64)
                    f.seek(8 + 4 * (n + a) * k)
                    d = np.frombuffer(f.read(4 * (b - a) * k), "<f4").astype(float) if far else None
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(a, b), k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b - a)), pa.array(ids), pa.array(d) if far else pa.nulls(len(ids), pa.float64())], ["qid", "rank", "vec_id", "distance"])

    return map_arrow(_ranges(spark, path, n, ROWS_PER_TASK), part, "qid bigint, rank int, vec_id bigint, distance double")


def write_range_truth(truth: DataFrame, path: str, queries: DataFrame) -> None:
    """truth: qid, rank, vec_id; queries: qid. [n][total][counts][ids], also of queries that have none."""
    counts = queries.select("qid").distinct().join(truth.groupBy("qid").agg(F.count("*").alias("c")), "qid", "left").select("qid", F.array(F.coalesce("c", F.lit(0))).alias("v"))
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum(F.get("v", F.lit(0))), F.lit(0))).first()
    _joined(counts, ["qid"], lambda b: _matrix(b.column(1), "int32").tobytes(), path, np.array([n, total], "<i4").tobytes())
    ids = truth.select("qid", "rank", F.array("vec_id").alias("v"))
    _joined(ids, ["qid", "rank"], lambda b: _matrix(b.column(2), "uint32").tobytes(), path, b"", 8 + 4 * n)


def read_range_truth(spark: SparkSession, path: str) -> DataFrame:
    """qid and ids, a row for each query. The counts, four bytes a query, are read by every task."""
    where, name = opened(path)
    with where.open_input_file(name) as f:
        n, total = np.frombuffer(f.read(8), "<i4").tolist()
    if n < 0 or where.get_file_info(name).size != 8 + 4 * (n + total):
        raise ValueError(f"{path}: not {n} queries with {total} ids")

    def part(it):
        for batch in it:
            for a in batch.column(1).to_pylist():
                b = min(a + ROWS_PER_TASK, n)
                where, name = opened(path)
                with where.open_input_file(name) as f:
                    f.seek(8)
                    counts = np.frombuffer(f.read(4 * b), "<i4").astype(np.int64)
                    first, own = int(counts[:a].sum()), counts[a:]
                    f.seek(8 + 4 * (n + first))
                    ids = np.frombuffer(f.read(4 * int(own.sum())), "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(own)]).astype(np.int32), pa.array(ids))], ["qid", "ids"])

    return map_arrow(_ranges(spark, path, n, ROWS_PER_TASK), part, "qid bigint, ids array<bigint>")


def write_graph(nodes: DataFrame, path: str, start: int = 0, frozen: int = 0) -> int:
    """nodes: vec_id from 0 on without gaps, and neighbours. [bytes u64][largest degree u32][start u32][frozen u64], and
    for each node its degree and neighbours (u32)."""
    n, most, total, high = nodes.agg(F.count("*"), F.max(F.size("neighbours")), F.sum(F.size("neighbours")), F.max("vec_id")).first()
    if n and high != n - 1:
        raise ValueError("a graph file's ids are 0, 1, ... without gaps")

    def encode(batch) -> bytes:
        own = batch.column(1).to_pylist()
        return np.concatenate([np.array([len(x), *x], "<u4") for x in own]).tobytes()

    head = np.array([24 + 4 * ((total or 0) + n)], "<u8").tobytes() + np.array([most or 0, start], "<u4").tobytes() + np.array([frozen], "<u8").tobytes()
    _joined(nodes.select("vec_id", "neighbours"), ["vec_id"], encode, path, head)
    return n


def graph_header(path: str) -> dict:
    """bytes, degree, start and frozen (how many start points are none of the data)."""
    where, name = opened(path)
    with where.open_input_file(name) as f:
        data = f.read(24)
    if len(data) < 24:
        raise ValueError(f"{path}: no header")
    (size,), (degree, start), (frozen,) = np.frombuffer(data[:8], "<u8").tolist(), np.frombuffer(data[8:16], "<u4").tolist(), np.frombuffer(data[16:], "<u8").tolist()
    if where.get_file_info(name).size != size:
        raise ValueError(f"{path}: the header says {size} bytes")
    return {"bytes": size, "degree": degree, "start": start, "frozen": frozen}


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """vec_id and neighbours. Rows differ in length, so one task reads the file as a stream."""
    graph_header(path)

    def rows(it):
        for batch in it:
            for name in batch.column(0).to_pylist():
                where, file = opened(name)
                with where.open_input_stream(file) as data:
                    data.read(24)
                    rest, number = np.zeros(0, "<u4"), 0
                    while piece := data.read(1 << 22):
                        rest, at, out = np.concatenate([rest, np.frombuffer(piece, "<u4")]), 0, []
                        while at < len(rest) and at + 1 + int(rest[at]) <= len(rest):
                            out.append(rest[at + 1 : at + 1 + int(rest[at])].astype(np.int64))
                            at += 1 + int(rest[at])
                        rest = rest[at:]
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(out))), pa.array(out, pa.list_(pa.int64()))], ["vec_id", "neighbours"])
                            number += len(out)

    return map_arrow(spark.createDataFrame([(path,)], "path string"), rows, "vec_id bigint, neighbours array<bigint>")


def write_results(found: DataFrame, folder: str) -> None:
    """qid, rank, id and distance as a table of comma-separated values with a header."""
    found.select("qid", "rank", F.col("vec_id").alias("id"), "distance").write.mode("overwrite").option("header", True).csv(folder)


def write_result_matrices(found: DataFrame, prefix: str, k: int) -> list[str]:
    """found: width, qid, rank, vec_id, distance, k rows a query: two binary matrices for each width."""
    out = []
    for width in sorted(r.width for r in found.select("width").distinct().collect()):
        rows = found.where((F.col("width") == width) & (F.col("rank") <= k)).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "distance"))).alias("x"))
        for name, part, kind in (("idx_uint32", "vec_id", "uint32"), ("dists_float", "distance", "float")):
            out.append(f"{prefix}_{width}_{name}.bin")
            write_bin(rows.select(F.col("qid").alias("vec_id"), F.transform("x", lambda r: r[part]).alias("embedding")), out[-1], kind)  # noqa: B023
    return out


def read_passages(spark: SparkSession, text_path: str, vectors_path: str) -> DataFrame:
    """vec_id, passage_id, text and embedding: lines of an id and a text between a tab, and a binary matrix of as many
    rows in the same order."""
    rows = lines(spark, text_path).where("value <> ''")
    n, m = rows.count(), header(vectors_path)[0]
    if n != m:
        raise ValueError(f"{n} passages and {m} vectors")
    cells = F.split("value", "\t", 2)
    return rows.select(F.col("line").alias("vec_id"), F.get(cells, F.lit(0)).alias("passage_id"), F.coalesce(F.get(cells, F.lit(1)), F.lit("")).alias("text")).join(read_bin(spark, vectors_path), "vec_id")


def save_index(folder: str, nodes: DataFrame, meta: dict, deletes: DataFrame | None = None) -> None:
    """An index as a folder: nodes by shard, deletes, and meta.json with what it was built with and how many rows and
    edges it has. meta.json is written last."""
    spark = nodes.sparkSession
    nodes.repartition("shard").sortWithinPartitions("shard", "vec_id").write.mode("overwrite").parquet(f"{folder}/nodes")
    gone = spark.createDataFrame([], "vec_id bigint") if deletes is None else deletes.select("vec_id")
    gone.distinct().write.mode("overwrite").parquet(f"{folder}/deletes")
    now = spark.read.parquet(f"{folder}/nodes").agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("neighbours")), F.lit(0)).alias("edges"), F.countDistinct("shard").alias("shards")).first().asDict()
    put(f"{folder}/meta.json", json.dumps(meta | {"counts": now}).encode())


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """Nodes, deletes and meta; other counts than those saved, or an edge to a node that its shard lacks, are errors."""
    meta = json.loads(get(f"{folder}/meta.json"))
    nodes, deletes = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/deletes")
    now = nodes.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("neighbours")), F.lit(0)).alias("edges"), F.countDistinct("shard").alias("shards")).first().asDict()
    if now != meta["counts"]:
        raise ValueError(f"{folder}: {now} where {meta['counts']} were saved")
    ends = nodes.select("shard", F.explode("neighbours").alias("vec_id")).distinct()
    if not ends.join(nodes, ["shard", "vec_id"], "left_anti").isEmpty():
        raise ValueError(f"{folder}: edges to points that are not there")
    return nodes, deletes, meta
