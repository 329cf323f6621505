"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each task packs its own documents. A document's full windows are cut off first; what is left over, a piece
shorter than a window, joins a group. A group ends at about PIECES pieces, its last one cut so that its ids fill
their windows but for SPARE of each. It is packed by differencing: every piece starts as a partial partition of its
own, and the two partial partitions of largest imbalance are merged so that the larger loads of one meet the smaller
loads of the other, until one partition into near-equal windows remains. Where a window still exceeds the capacity,
what is over is cut off and goes to the emptiest windows; their number rises by one as often as they have no room.
So about SPARE of the ids' number is padding, and few documents are cut. A task's last group may put some pieces in a
sequence whose length is a power of two, where that leaves less padding.

Nothing is shuffled, and memory is bounded by a group and a part of a batch. A sequence's id is made of its
partition's number and a count within it.

Cases: null counts as empty, which still has its end id; a null id is carried along; repeated rows and ids are packed
one by one; other columns are not read; an empty table gives no pieces. Texts are encoded whole.
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .text import pick
from .word_bpe import parts, word_bpe

WINDOW, PIECES, END = 4096, 256, 2
SPARE = 0.005
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k near-equal groups of the sizes' positions. A partial partition holds its loads from the largest on;
    loads that are zero are left out."""
    heap = [(-s, i, [(s, i, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        both = max(0, len(a) + len(b) - k)  # a's smallest loads meet b's, largest to smallest
        kept = a[: len(a) - both] + b[: len(b) - both]
        met = [(x[0] + y[0], min(x[1], y[1]), (x[2], y[2])) for x, y in zip(a[len(a) - both :], reversed(b[len(b) - both :]))]
        merged = sorted(kept + met, key=lambda x: (-x[0], x[1]))
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], count, merged))
        count += 1

    def members(tree) -> list[int]:
        out, todo = [], [tree]
        while todo:
            x = todo.pop()
            todo.extend(reversed(x)) if isinstance(x, tuple) else out.append(x)
        return out

    return [members(x[2]) for x in heap[0][2]] if heap else []


def windows_of(sizes: list[int], capacity: int, least: int = 1) -> list[list[tuple[int, int, int]]]:
    """Windows of (position, start, length) that hold the capacity at most: near-equal ones, so many at least, in
    which only what is over the capacity was cut off and moved. No size may exceed the capacity."""
    k = max(least, -(-sum(sizes) // capacity))
    groups = [[(i, 0, sizes[i]) for i in g] for g in differencing(sizes, k)]
    loads = [sum(x[2] for x in g) for g in groups]
    over = []
    for g, load in zip(groups, loads):
        while load > capacity:
            i, start, length = g.pop()
            cut = min(length, load - capacity)
            if cut < length:
                g.append((i, start, length - cut))
            over.append((i, start + length - cut, cut))
            load -= cut
    room = [(-capacity + sum(x[2] for x in g), n) for n, g in enumerate(groups) if sum(x[2] for x in g) < capacity]
    heapq.heapify(room)
    while over:
        i, start, length = over.pop()
        if not room:
            groups.append([])
            room = [(-capacity, len(groups) - 1)]
        free, n = heapq.heappop(room)
        part = min(length, -free)
        groups[n].append((i, start, part))
        if part < length:
            over.append((i, start + part, length - part))
        if part < -free:
            heapq.heappush(room, (free + part, n))
    return groups


def sequences_of(sizes: list[int], capacity: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of a task's last group: of what is over the full ones, the smallest pieces may become a sequence
    whose length is a power of two."""
    rest = sum(sizes) % capacity
    short = 1 << max(0, rest - 1).bit_length()
    if not rest or short >= capacity or short > sum(sizes):
        return windows_of(sizes, capacity)
    tail, left = [], {i: n for i, n in enumerate(sizes)}
    for i in sorted(left, key=lambda i: (sizes[i], i)):
        if not short:
            break
        part = min(short, left[i])
        tail.append((i, sizes[i] - part, part))
        left[i] -= part
        short -= part
    kept = [i for i in left if left[i]]
    return [[(kept[j], start, n) for j, start, n in g] for g in windows_of([left[i] for i in kept], capacity) if g] + [tail]


def pack(docs: DataFrame, tokenizer: str, end: int = END, window: int = WINDOW, pieces: int = PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: its document, place and length in it, checksum, sequence and place there."""
    schema = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])
    last = end.to_bytes(4, "little")
    room = max(1, int(window * (1 - SPARE)))

    def rows(it):
        number = TaskContext.get().partitionId() << 40
        waiting: list[tuple[int, int, int, bytes]] = []  # doc_id, start, doc_tokens, ids
        held = 0
        out: list[tuple] = []

        def piece(doc_id, start, ids, tokens, offset):
            out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, number, offset))

        def batch_of():
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
            out.clear()
            return made

        def put(groups):
            nonlocal number
            for group in groups:
                offset = 0
                for i, start, length in group:
                    doc_id, at, tokens, ids = waiting[i]
                    piece(doc_id, at + start, ids[4 * start : 4 * (start + length)], tokens, offset)
                    offset += length
                number += 1

        def pack_waiting():
            """All but the end of the last piece, which waits for the next group."""
            nonlocal held
            fits = held // room * room
            doc_id, at, tokens, ids = waiting.pop()
            held -= len(ids) // 4
            cut = max(0, fits - held)
            more = [(doc_id, at + cut, tokens, ids[4 * cut :])] if 4 * cut < len(ids) else []
            if cut:
                waiting.append((doc_id, at, tokens, ids[: 4 * cut]))
            put(windows_of([len(w[3]) // 4 for w in waiting], window, fits // room))
            waiting[:] = more
            held = sum(len(w[3]) // 4 for w in more)

        for batch in it:
            for part in parts(batch):
                for doc_id, found in zip(part.column(0).to_pylist(), word_bpe(tokenizer).encode(part.column(1))):
                    ids = found.tobytes() + last
                    tokens = len(ids) // 4
                    whole = tokens - tokens % window
                    for start in range(0, whole, window):
                        piece(doc_id, start, ids[4 * start : 4 * (start + window)], tokens, 0)
                        number += 1
                    if whole < tokens:
                        waiting.append((doc_id, whole, tokens, ids[4 * whole :]))
                        held += tokens - whole
                        # only now could the last piece be cut where the windows' room ends
                        if len(waiting) >= pieces and held >= room and held % room <= tokens - whole:
                            pack_waiting()
                if out:
                    yield batch_of()
        if waiting:
            put(sequences_of([len(w[3]) // 4 for w in waiting], window))
            yield batch_of()

    return map_arrow(pick(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint")), rows, SCHEMA)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
