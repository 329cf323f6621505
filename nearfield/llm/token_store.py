"""Binary files of token ids with a shared zstandard dictionary.

The dictionary is trained on the serialized ids of a bounded sample of documents: of the SAMPLE document ids that
hash lowest, one whole text each, if it has at most SAMPLE_CHARS code points. A sample too small to train on is itself
the dictionary, as raw content. Every document is compressed by itself with it, so one document is read without its
neighbours. A file holds, little-endian:

    8 bytes   magic
    32 bytes  SHA-256 of the dictionary, which lies in the folder as <hash>.dict
    4 bytes   bytes an id takes: 2 if the vocabulary has at most 65,536 ids, else 4
    ...       the documents' compressed ids, one after another
    8 n       document ids (int64)
    8 (n+1)   where each document starts, from the start of the file (uint64); the last is the documents' end
    8 n       ids in each document (uint64)
    16 bytes  n, and where the document ids start (uint64 each)

Files hold contiguous ranges of document ids in ascending order; the manifest has, for each file, how many
ids all files before it have. Each range is written by one task; a range of many ids or bytes makes several files, so
that a task holds FILE_BYTES and a document at most. An id that more than a range's rows share gets ranges of its own,
by the hash of the text. Tasks write a file under another name and move it, so a lost task is repeated without harm, and
only the manifest's files are read.

Cases: null text counts as empty and has the end id only; a null id sorts first and reads back as null;
rows that share an id are kept, ordered by the hash of their texts; other columns are not read; an empty table makes
a manifest without files. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .ranges import LEAST, spread
from .shared import get, opened, put, shared_dir
from .text import pick
from .word_bpe import parts, word_bpe

MOST_TASKS = 1 << 14
MAGIC, HEAD = b"NFTOKEN1", 44
NULL_ID = LEAST
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL = 2000, 1 << 15, 1 << 16, 3
ROWS_PER_FILE, FILE_BYTES = 2048, 1 << 25
#: Different pieces of text whose ids a worker keeps.
KEPT = 1_000_000
END = 2


def _encoded(texts: pa.Array, path: str, end: int, wide: int) -> list[bytes]:
    kind = "<u2" if wide == 2 else "<u4"
    last = np.array([end], kind).tobytes()
    return [x.astype(kind).tobytes() + last for x in word_bpe(path, KEPT).encode(texts)]


def train(docs: DataFrame, path: str, end: int, wide: int) -> bytes:
    """The dictionary; empty only where no document is short enough."""

    def ids(it):
        for batch in it:
            for part in parts(batch):
                yield pa.RecordBatch.from_arrays([pa.array(_encoded(part.column(1), path, end, wide), pa.binary())], ["ids"])

    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.join(F.broadcast(chosen), "doc_id").where(F.length("text") <= SAMPLE_CHARS).groupBy("doc_id").agg(F.min("text").alias("text"))
    samples = sorted(bytes(r.ids) for r in map_arrow(texts, ids, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _zdict(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


def pack_file(rows: list[tuple[int, int, bytes]], digest: bytes, wide: int) -> bytes:
    """rows: (document id, number of ids, compressed ids)."""
    ids, counts, blobs = zip(*rows)
    starts = np.cumsum([HEAD, *map(len, blobs)]).astype("<u8")
    body = b"".join([MAGIC, digest, struct.pack("<I", wide), *blobs])
    return b"".join([body, np.asarray(ids, "<i8").tobytes(), starts.tobytes(), np.asarray(counts, "<u8").tobytes(), struct.pack("<QQ", len(ids), len(body))])


class TokenFile:
    """Opens a file's index; ids(i) reads and decompresses the i-th document alone."""

    def __init__(self, path: str) -> None:
        self.folder = path.rpartition("/")[0]
        where, name = opened(path)
        self.data = where.open_input_file(name)
        size = self.data.size()
        if self._at(0, 8) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.digest, (self.wide,) = self._at(8, 32), struct.unpack("<I", self._at(40, 4))
        n, at = struct.unpack("<QQ", self._at(size - 16, 16))
        index = self._at(at, 8 * (3 * n + 1))
        self.doc_ids, self.starts, self.counts = np.frombuffer(index, "<i8", n), np.frombuffer(index, "<u8", n + 1, 8 * n), np.frombuffer(index, "<u8", n, 8 * (2 * n + 1))
        dictionary = get(f"{self.folder}/{self.digest.hex()}.dict")
        if hashlib.sha256(dictionary).digest() != self.digest:
            raise ValueError(f"{path}: the dictionary is another one")
        self.reader = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))

    def _at(self, at: int, size: int) -> bytes:
        self.data.seek(at)
        return self.data.read(size)

    def ids(self, i: int) -> np.ndarray:
        blob = self._at(int(self.starts[i]), int(self.starts[i + 1] - self.starts[i]))
        return np.frombuffer(self.reader.decompress(blob, max_output_size=int(self.counts[i]) * self.wide), "<u2" if self.wide == 2 else "<u4").astype("<u4")


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = ROWS_PER_FILE, file_bytes: int = FILE_BYTES) -> list[dict]:
    """Writes all documents' ids below the folder, and its manifest.json: a list of path, docs, start, tokens."""
    from tokenizers import Tokenizer

    docs = pick(docs, id_col, text_col).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)))
    wide = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    dictionary = train(docs, tokenizer, end, wide)
    digest = hashlib.sha256(dictionary).digest()
    put(f"{folder}/{digest.hex()}.dict", dictionary)
    ranges = spread(docs, rows_per_file)

    def compressed(it):
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zdict(dictionary), write_content_size=False).compress
        for batch in it:
            for part in parts(batch):
                rows = _encoded(part.column(1), tokenizer, end, wide)
                at = ranges.find(part.column(0).to_numpy(), part.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), part.column(0), part.column(2), pa.array([len(x) // wide for x in rows], pa.int64()), pa.array([compress(x) for x in rows], pa.binary())], ["range", "doc_id", "tie", "n", "ids"])

    def files(it):
        rows, now, size, made = [], None, 0, 0

        def end_file():
            nonlocal rows, size, made
            path = f"{folder}/{now:010d}-{made:06d}.ids"
            put(path, pack_file(rows, digest, wide))
            out = {"range": now, "part": made, "path": path, "docs": len(rows), "tokens": sum(r[1] for r in rows)}
            rows, size, made = [], 0, made + 1
            return pa.RecordBatch.from_pylist([out])

        for batch in it:
            for i in range(0, batch.num_rows, 1000):
                for r, doc_id, _, n, ids in zip(*(c.to_pylist() for c in batch.slice(i, 1000).columns)):
                    if rows and (r != now or size >= file_bytes or len(rows) >= 4 * rows_per_file):
                        yield end_file()
                    if r != now:
                        now, made = r, 0
                    rows.append((doc_id, n, ids))
                    size += len(ids)
        if rows:
            yield end_file()

    rows = map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("tie")), compressed, "range int, doc_id bigint, tie bigint, n bigint, ids binary")
    rows = rows.repartitionById(ranges.count, "range").sortWithinPartitions("range", "doc_id", "tie", "n", "ids")
    made = map_arrow(rows, files, "range bigint, part bigint, path string, docs bigint, tokens bigint").collect()
    manifest, start = [], 0
    for r in sorted(made, key=lambda r: (r.range, r.part)):
        manifest.append({"path": r.path, "docs": r.docs, "start": start, "tokens": r.tokens})
        start += r.tokens
    put(f"{folder}/manifest.json", json.dumps(manifest).encode())
    return manifest


def read(spark: SparkSession, folder: str, digest_only: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, unless digest_only, ids: from the files alone."""
    manifest = json.loads(get(f"{folder}/manifest.json"))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ("" if digest_only else ", ids array<bigint>")

    def rows(it):
        for batch in it:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file, out = TokenFile(path), []
                for i, (doc_id, n) in enumerate(zip(file.doc_ids.tolist(), file.counts.tolist())):
                    ids = file.ids(i)
                    row = {"doc_id": None if doc_id == NULL_ID else doc_id, "start": start, "n_tokens": n, "ids_crc32": zlib.crc32(ids.tobytes())}
                    out.append(row if digest_only else row | {"ids": ids.tolist()})
                    start += n
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_pylist(out, want)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, want)

    want = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([] if digest_only else [("ids", pa.list_(pa.int64()))])])
    table = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start bigint")
    return map_arrow(table.repartition(max(1, min(len(manifest), MOST_TASKS))), rows, schema)


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark)
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, folder, digest_only=True)
