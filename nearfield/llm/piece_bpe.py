"""SentencePiece byte-pair encoding in vectorised merge rounds, and decoding.

A text is cut where no piece of the vocabulary can reach across: before a space mark that follows another
character, around characters that stand in no longer piece, and between ASCII characters that stand side by side in no
piece. Different parts are encoded together: all their symbols lie in one flat numpy array with the number of their
part. A round takes each part's lowest rank of a neighbouring pair, merges every occurrence of that pair from the
left without overlap, looks up the ranks of the pairs that are new, and drops the merged symbols from the arrays; rounds
go on until no pair has a rank.

The library merges one pair at a time. Merging all occurrences at once gives the same unless a merge makes a
pair that ranks before the one just merged, in a part where that pair occurred more than once; such a part is
encoded again one merge at a time, as is one where several pairs merge by a score that different pieces share and one
of more than LONG characters, which would hold up the rounds of all others: a heap of pairs over linked neighbours, so
n log n in its length.

Arrow finds a batch's different parts. Those that were encoded are kept by a worker, up to MOST of MOST_CHARS
characters, with their ids in one flat array, so a frequent word is worked out once and a text's ids are gathered.

Cases: null counts as empty, which has no ids and decodes to the empty text; a null id is carried along; repeated
rows give a row each; other columns are not read. Texts are taken whole. A literal space mark decodes to a space, as in the library.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .text import pick
from .word_bpe import parts as split_batch

MARK, MOST, MOST_CHARS, LONG, NONE = "▁", 400_000, 1 << 24, 200, np.iinfo(np.int64).max
#: Bytes of text that are encoded at a time, unless one text has more; slots of the table of pairs, as a power of two.
SPLIT, SLOTS = 1 << 21, 19
codecs.register_error("nearfield_bytes", lambda e: ("�", e.start + 1))  # one mark for each byte


class PieceBpe:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.unknown = model.unk_id()
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # ranks: a higher score merges first
        order = sorted({-model.get_score(i) for i in self.ids.values()})
        place = {s: r for r, s in enumerate(order)}
        self.rank = {i: place[-model.get_score(i)] for i in self.ids.values()}
        shared = np.bincount(list(self.rank.values())) > 1
        # symbols are ids, or from n on characters that are no piece; a pair's key leads to what it merges to
        self.n = n
        pairs = {}
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in keys.tolist()] + [0], np.int64)
        self.shared = np.append(shared, False)  # by rank; the last stands for none
        self.ranks = np.array([self.rank[m] for m in self.merged[:-1].tolist()] + [NONE], np.int64)
        # an open table: a key lies in the first free slot from its own on
        self.slots, self.at = np.full((1 << SLOTS) + len(keys), -1), np.full((1 << SLOTS) + len(keys), len(keys))
        for i, (k, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.slots[slot] >= 0:
                slot += 1
            self.slots[slot], self.at[slot] = k, i
        self.codes = np.arange(n, n + 0x110000)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.codes[ord(p)] = i
        inner = set("".join(p for p in self.ids if len(p) > 1))
        if any(p[j] == MARK and p[j - 1] != MARK for p in self.ids for j in range(1, len(p))):
            raise ValueError("a piece reaches across the start of a word")
        # by the bytes before and after, with a space for the mark: whether a text is cut there
        cut = np.zeros((256, 256), bool)
        cut[:128, :128] = True
        for p in self.ids:
            for a, b in zip(p.replace(MARK, " "), p.replace(MARK, " ")[1:]):
                if a < "\x80" and b < "\x80":
                    cut[ord(a), ord(b)] = False
        for b in [b for b in range(128) if chr(b) not in inner and b != 32]:
            cut[b] = cut[:, b] = True
        cut[:, 32] |= np.arange(256) != 32
        self.cut = cut.ravel()
        text = [b"" if model.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for b, i in enumerate(self.byte):
            text[i] = bytes([b])
        text[self.unknown] = " ⁇ ".encode()
        self.text = text
        # the second half: as the first piece of a text, without the space that encoding puts in front
        self.pieces = pa.array(text + [t.removeprefix(b" ") for t in text], pa.binary())
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.chars, self.used, self.store = 0, 0, np.zeros(1 << 16, np.int32)
        self.starts, self.lengths = np.zeros((2, 1 << 12), np.int64)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; NONE where it does not merge."""
        key = np.where((left < self.n) & (right < self.n), left * self.n + right, -2)
        slot = self._slot(key)
        found = self.slots[slot]
        more = np.flatnonzero((found != key) & (found >= 0))
        while len(more):
            slot[more] += 1
            found[more] = here = self.slots[slot[more]]
            more = more[(here != key[more]) & (here >= 0)]
        at = np.where(found == key, self.at[slot], -1)
        return self.ranks[at], self.merged[at]

    def merge(self, parts: list[str]) -> list[list[int]]:
        """Each part's symbols after all merges."""
        if any(len(p) > LONG for p in parts):
            short = iter(self.merge([p for p in parts if len(p) <= LONG]))
            return [self._one_by_one(p) if len(p) > LONG else next(short) for p in parts]
        symbols = self.codes[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        again, last = np.zeros(len(parts), bool), np.full(len(parts), -1)
        live_symbols, live_part, done = symbols, part, []
        rank, result = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
        new = np.arange(len(symbols) - 1)
        while len(live_symbols):
            r, result[new] = self._lookup(live_symbols[new], live_symbols[new + 1])
            rank[new] = np.where(live_part[new] == live_part[new + 1], r, NONE)
            starts = np.nonzero(np.diff(live_part, prepend=-1))[0]
            lowest = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(live_part)))
            own = live_part[starts]
            again[own] |= lowest < last[own]  # a pair that ranks before the one merged last
            every = np.repeat(lowest, length)
            take = (rank == every) & (every != NONE)
            # of a run of overlapping occurrences every other one, from the left
            first = take & ~np.concatenate([[False], take[:-1]])
            run = np.maximum.accumulate(np.where(first, np.arange(len(take)), 0))
            take &= (np.arange(len(take)) - run) % 2 == 0
            several = np.add.reduceat(take.astype(np.int64), starts) > 1
            again[own] |= several & self.shared[np.minimum(lowest, len(self.shared) - 1)]
            last[own] = np.where(several, lowest, -1)
            over = every == NONE
            if over.any():
                done.append((live_part[over], live_symbols[over]))
            live_symbols = np.where(take, result, live_symbols)
            keep = ~over & ~np.concatenate([[False], take[:-1]])
            live_symbols, live_part, rank, result = live_symbols[keep], live_part[keep], rank[keep], result[keep]
            new = take[keep]  # pairs of which either is a new symbol
            new[:-1] |= new[1:]
            rank[new] = NONE
            new = np.flatnonzero(new[:-1])
        at, all_symbols = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(len(parts) + 1)).tolist()
        flat = all_symbols[order].tolist()
        return [self._one_by_one(p) if again[i] else flat[bounds[i] : bounds[i + 1]] for i, p in enumerate(parts)]

    def _one_by_one(self, part: str) -> list[int]:
        """The lowest rank first, of equal ones the leftmost."""
        n, pairs, rank = self.n, self.pairs, self.rank
        s = [self.ids.get(c, n + ord(c)) for c in part]
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < len(s) and s[i] < n and s[j] < n and (m := pairs.get(s[i] * n + s[j])) is not None:
                heapq.heappush(heap, (rank[m], i, s[i], s[j], m))

        for i in range(len(s) - 1):
            offer(i)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= len(s) or s[j] != b:
                continue  # one of the two has merged with another
            s[i], s[j], after[i] = m, -1, after[j]
            if after[j] < len(s):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in s if x >= 0]

    def _finished(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            out.extend([s] if s < self.n else (self.byte[b] for b in chr(s - self.n).encode("utf-8", "surrogatepass")))
        return out

    def _learn(self, parts: list[str]) -> None:
        """Keeps the ids of new parts."""
        first, n = len(self.known), self.n
        found = [self._finished(s) if max(s) >= n else s for s in self.merge([p.replace(" ", MARK) for p in parts])]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        total = int(lengths.sum())
        while self.used + total > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while first + len(parts) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.store[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.int32, total)
        self.starts[first : first + len(parts)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + len(parts)] = lengths
        self.used += total
        self.chars += sum(map(len, parts))
        self.known.update(zip(parts, range(first, first + len(parts))))

    def encoded(self, texts: pa.Array) -> pa.ListArray:
        """Each text's ids."""
        if len(self.known) > MOST or self.chars > MOST_CHARS:
            self._empty()
        texts = pc.replace_substring(texts, MARK, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or bounds[0] == bounds[-1]:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
        chars = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        begins = np.ones(len(chars), bool)
        begins[1:] = self.cut[chars[:-1].astype(np.uint16) * 256 + chars[1:]]
        begins[bounds[bounds < len(chars)]] = True
        begins = np.flatnonzero(begins)
        ends = np.append(begins, len(chars)).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(chars))).dictionary_encode()
        found, get = parts.dictionary.to_pylist(), self.known.get
        if new := [p for p in found if p not in self.known]:
            self._learn(new)
        slots = np.array([get(p) for p in found])[parts.indices.to_numpy()]
        lengths = self.lengths[slots]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[slots] - ends + lengths, lengths)
        at += np.arange(len(at))
        ends = np.concatenate([[0], ends])[np.searchsorted(begins, bounds)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.store[at]))

    def encode(self, texts: list[str]) -> list[list[list[int]]]:
        """Each text's ids, in one part."""
        return [[ids] for ids in self.encoded(pa.array(texts, pa.string())).to_pylist()]

    def decoded(self, ids: pa.ListArray) -> pa.Array:
        """Each list's text, as decode gives it."""
        values, bounds = ids.flatten().to_numpy().astype(np.int64), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        values[bounds[:-1][np.diff(bounds) > 0]] += len(self.text)
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), self.pieces.take(pa.array(values))), b"")
        try:
            return whole.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no characters
            return pa.array([self.decode(x) for x in ids.to_pylist()], pa.string())

    def decode(self, ids: list[int]) -> str:
        """The pieces' bytes together, without the space that encoding puts in front."""
        data = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "nearfield_bytes")
        return data[1:] if ids and self.text[ids[0]].startswith(b" ") else data


@lru_cache(maxsize=2)
def piece_bpe(path: str) -> PieceBpe:
    """One encoder a worker process."""
    return PieceBpe(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array) and decoded, a row for each input row."""
    return _mapped(docs, model, id_col, text_col, "doc_id bigint, ids array<bigint>, decoded string", lambda ids, texts: [ids.cast(pa.list_(pa.int64())), texts])


def _mapped(docs: DataFrame, model: str, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    """doc_id and the columns that a function makes of ids and decoded texts, a row for each input row."""
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(it):
        coder = piece_bpe(model)
        for batch in it:
            for part in split_batch(batch, size=SPLIT):
                ids = coder.encoded(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns(ids, coder.decoded(ids))], names)

    return map_arrow(pick(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint")), rows, schema)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    sha = lambda texts: pa.array([hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()], pa.string())

    def digest(ids, texts):
        numbers = pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string()))
        return [pc.list_value_length(ids).cast(pa.int64()), sha(pc.binary_join(numbers, ",")), sha(texts)]

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _mapped(docs, public_tokenizers.path("piece_bpe_32k.model"), "doc_id", "text", "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest)
