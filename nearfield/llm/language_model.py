"""Scoring by a gated recurrent language model with a class-factored output.

Counts come first: every word of every training text is counted, over the whole corpus. The HEAD most frequent words
are dealt to classes of like frequency, small ones for the most frequent; all other words, seen or not, are the tail
class. A token's probability is P(class | state) P(token | class). Both are softmaxes that look at the state, in every
head class; the tail's words share P(tail | state) by (c + 0.5) / (n + 0.5 (v + 1)), by the tail's counts. The tail's
counts grow with the corpus and are joined by word; those of the COUNTED most frequent words, a bounded list, are
broadcast.

The state is a gated recurrent unit of STATE numbers in numpy. Texts are dealt to lanes of like length, LANES at most; a lane
reads one text after another, from an empty state each. Training propagates back through windows of WINDOW tokens; the
state is carried from window to window, in training as in scoring, so a document's score is the log-likelihood of the
whole. The unit learns from every training text once: the first of ROUNDS holds one text in FIRST, the second the
rest. In a round each task trains on its own texts, all from the same weights, and the weights are averaged by tokens.
In training alone, a text of more than SEGMENT tokens is read as several. The output starts as the words' counts, so an
untrained model scores like the counts.

Cases: null counts as empty: its end is scored; a null id counts as a training text; repeated rows are scored one by
one; other columns are not read; an empty table gives no rows; with no training text all words are unseen; texts that
are all words of one count may leave no head, and then all words are the tail. Texts are taken whole.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow, ship
from .shared import written
from .text import pick
from .word_bpe import parts

COUNTED, HEAD, READ = 65_536, 8192, 1024
#: Up to which rank classes hold so many words.
CLASSES = ((256, 32), (2048, 128), (HEAD, 256))
STATE, WINDOW, LANES = 12, 16, 512
FIRST, RATE, MOST_WEIGHT = 8, 0.12, 6
#: Tokens that a task trains on at a time, and those of a text that are read as one.
TOGETHER, SEGMENT = 1_000_000, 2048
#: Tokens that a task scores at a time; lanes are then so many that they are about as long as the longest text.
SCORED = 3_000_000
#: Tokens of a full window: gradients are shares of it, so that a window of few lanes moves the weights less.
FULL = LANES * WINDOW
#: Bytes of text that are split into words at a time, unless one text has more.
SPLIT = 1 << 21
#: Tokens whose classes are worked out at a time, so that they stay near the processor.
BLOCK = 1024
#: Different words that a task counts before it hands them on; weights a row when they are averaged.
MOST_WORDS, ROW = 600_000, 16_384
LOG10 = np.log(10)
FOLDS, HELD_OUT = 5, 1


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, A-Z in lower case, and where each text's end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, ends = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
    some = pc.binary_length(words).to_numpy() > 0  # a split leaves empty ends
    return words.filter(pa.array(some)), np.concatenate([[0], np.cumsum(some)])[ends]


class Layout:
    """How the counts deal words to classes. Tokens are numbers: the head's words by rank, the end, a word that is
    not among the counted ones, and from then on the counted words of the tail."""

    def __init__(self, counted: list[tuple[bytes, int]], ends: int, total: int, distinct: int, head: int = HEAD) -> None:
        """counted: the most frequent words with their counts, in order. ends: training texts. total, distinct: of
        all training tokens, ends included."""
        n = min(head, len(counted))
        c = np.array([x for _, x in counted], float)
        self.n, self.end, self.tail = n, n, n + 1
        self.counted = pa.array([w for w, _ in counted], pa.binary())
        first = [0]
        for upto, size in CLASSES:
            while first[-1] < min(n, upto):
                first.append(min(first[-1] + size, n, upto))
        self.first, self.heads = first, len(first) - 1
        cls = np.searchsorted(first, np.arange(n), "right") - 1
        self.cls = np.concatenate([cls, [self.heads, self.heads + 1]]).astype(np.uint16)
        self.classes = self.heads + 2
        tail_count, tail_distinct = total - ends - int(c[:n].sum()), distinct - n - (ends > 0)
        tail_mass = tail_count + 0.5 * (tail_distinct + 1)
        mass = np.bincount(cls, c[:n] + 0.5, self.classes).astype(float)
        mass[self.heads :] = ends + 0.5, tail_mass
        self.class_bias = np.log(mass / mass.sum())
        self.word_bias = np.log((c[:n] + 0.5) / mass[cls])
        # what the unit reads: one of the most frequent words itself, else the class
        own = min(READ, n)
        self.input = np.concatenate([np.arange(own), own + self.cls[own:]]).astype(np.uint16)
        self.inputs = own + self.classes
        # log10 of the base score, and of P(token | tail); a word that is not counted gets its part later
        more = np.concatenate([np.log10(c[:n] + 0.5), [np.log10(ends + 0.5), 0.0], np.log10(c[n:] + 0.5)])
        self.base = more - np.log10(total + 0.5 * (distinct + 1))
        self.within = np.where(np.arange(len(more)) > n, more - np.log10(tail_mass), 0.0)
        self.known = np.concatenate([np.ones(n, bool), [ends > 0, False], np.ones(len(c) - n, bool)])

    @property
    def index(self) -> dict[bytes, int]:
        """The counted words' numbers."""
        return {w: i if i < self.n else i + 2 for i, w in enumerate(self.counted.to_pylist())}

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Each word's token number."""
        at = pc.fill_null(pc.index_in(words, value_set=self.counted), -1).to_numpy()
        return np.where(at < 0, self.tail, at + 2 * (at >= self.n)).astype(np.int32)

    def ended(self, numbers: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Each text's token numbers, the end last."""
        flat, after = np.insert(numbers, ends, self.end), (ends + np.arange(1, len(ends) + 1)).tolist()
        return [flat[a:b] for a, b in zip([0, *after], after)]

    def read(self, words: list[bytes]) -> np.ndarray:
        """One text's token numbers, the end last."""
        return self.ended(self.numbers(pa.array(words, pa.binary())), np.array([len(words)]))[0]


def dealt(sizes: np.ndarray, lanes: int) -> list[list[int]]:
    """Positions by lane, of like total size, the largest lane first."""
    k = min(lanes, len(sizes))
    heap, own = [(0, i) for i in range(k)], [[] for _ in range(k)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, lane = heapq.heappop(heap)
        own[lane].append(i)
        heapq.heappush(heap, (load + int(sizes[i]), lane))
    return sorted(own, key=lambda o: -int(sizes[o].sum()))


class Model:
    """weights: what the unit reads, its recurrence, the classes' and the words' outputs (their bias last)."""

    def __init__(self, layout: Layout, weights: list[np.ndarray] | None = None) -> None:
        self.layout = layout
        if weights is None:
            rng = np.random.default_rng(0)
            small = lambda scale, *s: (rng.standard_normal(s) * scale).astype(np.float32)
            output = lambda bias: np.concatenate([np.zeros((len(bias), STATE)), bias[:, None]], 1).astype(np.float32)
            weights = [small(0.1, layout.inputs, 3 * STATE), small(0.2, STATE, 3 * STATE), output(layout.class_bias), output(layout.word_bias)]
        self.weights = weights
        self.squares = [np.full(w.shape, 1e-8, w.dtype) for w in weights]

    def _steps(self, x: np.ndarray, h: np.ndarray, y: np.ndarray, keep: np.ndarray, first: int) -> None:
        """From step `first` on, h[t + 1] gets the state after h[t]; a lane's numbers stand in a column. x: what the read
        inputs add, the gates' negated; it becomes the gates and what is new. y: becomes what the recurrence adds."""
        u = self.weights[1].T.copy()
        u[: 2 * STATE] *= -1
        for t in range(first, len(x)):
            gates, n, add, after = x[t, : 2 * STATE], x[t, 2 * STATE :], y[t], h[t + 1]
            np.dot(u, h[t], out=add)
            gates += add[: 2 * STATE]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            n += gates[STATE:] * add[2 * STATE :]
            np.tanh(n, out=n)
            np.subtract(h[t], n, out=after)
            after *= gates[:STATE]
            after += n
            after *= keep[t]

    def _update(self, i: int, at, gradient: np.ndarray) -> None:
        """A step down the gradient of the i-th weights, less the more gradient they have had."""
        square = self.squares[i][at]
        square += gradient * gradient
        self.squares[i][at] = square
        self.weights[i][at] -= RATE * gradient / np.sqrt(square)

    def _output(self, states: np.ndarray, target: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log P of each target after its state (a one follows the state's numbers); to learn, also updates
        the outputs and gives the gradient of the loss over FULL by state."""
        layout, (_, _, by_class, by_word) = self.layout, self.weights
        cls, n = layout.cls[target], len(target)
        one = np.ones(max(layout.classes, *np.diff(layout.first), 1), states.dtype)
        p, sums = np.zeros(n, states.dtype), np.ones(n, states.dtype)
        back, gradient = (np.zeros_like(states), np.zeros_like(by_class)) if learn else (None, None)
        for lo in range(0, n, BLOCK):
            hi = min(lo + BLOCK, n)
            x = states[lo:hi]
            e = x @ by_class.T
            flat, own = e.ravel(), np.arange(0, e.size, layout.classes) + cls[lo:hi]
            p[lo:hi] = flat[own]
            np.exp(e, out=e)
            s = np.matmul(e, one[: layout.classes], out=sums[lo:hi])
            if learn:
                flat[own] -= s
                share = (1 / (s * FULL))[:, None]
                np.multiply(e @ by_class, share, out=back[lo:hi])
                gradient += e.T @ (x * share)
        out = p.astype(float) - np.log(sums)
        if learn:
            self._update(2, slice(None), gradient)
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(layout.heads + 1)).tolist()
        order = order[: bounds[-1]]
        states, target = states[order], target[order]
        p, sums = np.zeros(len(order), states.dtype), np.ones(len(order), states.dtype)
        own_back, gradient = np.zeros_like(states), np.zeros_like(by_word) if learn else None
        for lo, hi, a, b in zip(bounds, bounds[1:], layout.first, layout.first[1:]):
            if lo == hi:
                continue
            x, w = states[lo:hi], by_word[a:b]
            e = x @ w.T
            flat, own = e.ravel(), np.arange(-a, (hi - lo) * (b - a) - a, b - a) + target[lo:hi]
            p[lo:hi] = flat[own]
            np.exp(e, out=e)
            s = np.matmul(e, one[: b - a], out=sums[lo:hi])
            if learn:
                flat[own] -= s
                share = (1 / (s * FULL))[:, None]
                np.multiply(e @ w, share, out=own_back[lo:hi])
                np.matmul(e.T, x * share, out=gradient[a:b])
        out[order] += p.astype(float) - np.log(sums)
        if learn:
            self._update(3, slice(None), gradient)  # no gradient, no step
            back[order] += own_back
        return out, back

    def _back(self, read: np.ndarray, x: np.ndarray, h: np.ndarray, y: np.ndarray, keep: np.ndarray, back: np.ndarray) -> None:
        """Through steps that _steps went, from the last. back: the gradient by state, of that step alone."""
        u, z, r, n, y, before = self.weights[1], x[:, :STATE], x[:, STATE : 2 * STATE], x[:, 2 * STATE :], y[:, 2 * STATE :], h[:-1]
        of_n, of_z, of_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), y * r * (1 - r)
        of_x, of_h = np.empty((2, *x.shape), x.dtype)
        later = np.zeros_like(h[0])
        for t in reversed(range(len(x))):
            dh, dx, by_u = back[t], of_x[t], of_h[t]
            dh += later
            dh *= keep[t]
            np.multiply(dh, of_z[t], out=dx[:STATE])
            dn = np.multiply(dh, of_n[t], out=dx[2 * STATE :])
            np.multiply(dn, of_r[t], out=dx[STATE : 2 * STATE])
            by_u[: 2 * STATE] = dx[: 2 * STATE]
            np.multiply(dn, r[t], out=by_u[2 * STATE :])
            np.dot(u, by_u, out=later)
            dh *= z[t]
            later += dh
        read = read.ravel()
        order = np.argsort(read, kind="stable")
        read, of_x = read[order], np.ascontiguousarray(of_x.transpose(0, 2, 1)).reshape(-1, 3 * STATE)[order]
        starts = np.flatnonzero(np.diff(read.astype(np.int32), prepend=-1))
        self._update(0, read[starts], np.add.reduceat(of_x, starts, axis=0))
        self._update(1, slice(None), np.matmul(before, of_h.transpose(0, 2, 1)).sum(0))

    def run(self, texts: list[np.ndarray], learn: bool = False) -> np.ndarray:
        """Natural log P of each text's tokens, without the tail's shares; to learn, updates the weights window by
        window."""
        total = np.zeros(len(texts))
        if not texts:
            return total
        layout, sizes = self.layout, np.array([len(x) for x in texts])
        most = LANES if learn else int(np.clip(sizes.sum() // sizes.max(), 1, LANES))
        window = WINDOW if learn else max(WINDOW, FULL // min(most, len(texts)))
        lanes = dealt(sizes, most)
        line = [i for o in lanes for i in o]
        flat = np.minimum(np.concatenate([texts[i] for i in line]), layout.tail)
        owner = np.repeat(line, sizes[line])
        opens = np.zeros(len(flat), bool)
        opens[np.cumsum(sizes[line]) - sizes[line]] = True
        length = np.array([sizes[o].sum() for o in lanes])
        place, inputs = np.cumsum(length) - length, layout.input[flat]
        live = np.searchsorted(-length, -np.arange(length[0]), "left")  # by step: lanes that are longer
        kind = self.weights[1].dtype
        last = np.zeros((STATE, len(lanes)), kind)
        for start in range(0, len(live), window):
            steps = live[start : start + window]
            t, k, first = len(steps), int(steps[0]), int(start == 0)  # before the first token nothing was read
            at = np.minimum(place[:k] + np.arange(start, start + t)[:, None], len(flat) - 1)
            some = (np.arange(k) < steps[:, None]).ravel()  # lanes that ended in this window are read on, for nothing
            read, keep = inputs[at - 1], (~opens[at]).astype(kind)[:, None]
            x = np.ascontiguousarray(self.weights[0][read].transpose(0, 2, 1))
            x[:, : 2 * STATE] *= -1
            h, y = np.zeros((t + 1, STATE, k), kind), np.empty_like(x)
            h[0] = last[:, :k]
            self._steps(x, h, y, keep, first)
            last, states = h[t], np.ones((t, k, STATE + 1), kind)
            states[:, :, :STATE] = h[1:].transpose(0, 2, 1)
            at, states = at.ravel()[some], states.reshape(-1, STATE + 1)[some]
            p, back = self._output(states, flat[at], learn)
            total += np.bincount(owner[at], p, len(texts))
            if learn and t > first:
                of_h = np.zeros((t * k, STATE), kind)
                of_h[some] = back[:, :STATE]
                of_h = np.ascontiguousarray(of_h.reshape(t, k, STATE).transpose(0, 2, 1))
                self._back(read[first:], x[first:], h[first:], y[first:], keep[first:], of_h[first:])
        if learn:
            for w in self.weights[2:]:  # so that no exponential overflows
                np.clip(w[:, :STATE], -MOST_WEIGHT, MOST_WEIGHT, out=w[:, :STATE])
        return total


def count(texts: DataFrame) -> DataFrame:
    """word (binary) and c over all texts. Each task sums up what it reads, a bounded number of words at a time."""

    def summed(found: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(found).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

    def rows(it):
        found, size = [], 0
        for batch in it:
            for part in parts(batch, text=0, size=SPLIT):
                words, c = pc.value_counts(tokens(part.column(0))[0]).flatten()
                found.append(pa.table([words, c], ["word", "c"]))
                size += len(words)
                if size > 2 * MOST_WORDS:
                    found = [summed(found)]
                    if (size := len(found[0])) > MOST_WORDS:
                        yield from found[0].to_batches()
                        found, size = [], 0
        if size:
            yield from summed(found).to_batches()

    return map_arrow(texts.select("text"), rows, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int = COUNTED) -> list[tuple[bytes, int]]:
    """Words with their counts, the most frequent first. Words of one count are taken together, as long as they all
    fit; so the driver learns how many words have each of the largest counts, and then gets no more than it wants."""
    left, least = most, None
    for r in counts.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).limit(most).collect():
        if r.k > left:
            break
        left, least = left - r.k, r.c
    if least is None:
        return []
    return sorted(((bytes(r.word), r.c) for r in counts.where(F.col("c") >= least).collect()), key=lambda x: (-x[1], x[0]))


def _summed(it):
    """Weighted sums of the rows of weights, by their number."""
    sums: dict[int, list] = {}
    for batch in it:
        for k, n, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            own = sums.setdefault(k, [0, 0.0])
            own[0] += n
            own[1] = own[1] + np.frombuffer(data, float)
    task = TaskContext.get().partitionId()
    for k, (n, total) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["k", "task", "n", "sum"])


def fit(train: DataFrame, counts: DataFrame) -> tuple[Model, int]:
    """The model, and the number of training tokens. train: doc_id, text. The driver gets COUNTED words and one set
    of weights a round."""
    spark, ends = train.sparkSession, train.count()
    n, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    total = (n or 0) + ends
    layout = Layout(most_frequent(counts), ends, total, distinct + (ends > 0))
    model = Model(layout)
    schema = "k int, task int, n bigint, sum binary"
    early = F.pmod(F.xxhash64("doc_id", "text"), F.lit(FIRST)) == 0
    for texts in (train.where(early), train.where(~early)):
        now = spark.sparkContext.broadcast((layout, model.weights))

        def learned(it):
            layout, weights = now.value
            own, waiting, size, n = Model(layout, [w.copy() for w in weights]), [], 0, 0
            for batch in it:
                for part in parts(batch, text=0, size=SPLIT):
                    words, ends = tokens(part.column(0))
                    for ids in layout.ended(layout.numbers(words), ends):
                        waiting += [ids[i : i + SEGMENT] for i in range(0, len(ids), SEGMENT)]
                        size += len(ids)
                        n += len(ids)
                        if size >= TOGETHER:
                            own.run(waiting, learn=True)
                            waiting, size = [], 0
            own.run(waiting, learn=True)
            if n:
                task, flat = TaskContext.get().partitionId(), n * np.concatenate([w.ravel() for w in own.weights]).astype(float)
                for k, i in enumerate(range(0, len(flat), ROW)):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([n], pa.int64()), pa.array([flat[i : i + ROW].tobytes()], pa.binary())], ["k", "task", "n", "sum"])

        rows = map_arrow(texts.select("text"), learned, schema)
        for keys in (["k", F.col("task") % 64], ["k"]):  # no task sums up what all tasks learned
            rows = map_arrow(rows.repartition(*keys).sortWithinPartitions("k", "task"), _summed, schema)
        if rows := sorted(rows.collect(), key=lambda r: r.k):
            flat = np.concatenate([np.frombuffer(r["sum"], float) / r.n for r in rows])
            ends_at = np.cumsum([w.size for w in model.weights])
            model = Model(layout, [x.reshape(w.shape).astype(np.float32) for x, w in zip(np.split(flat, ends_at[:-1]), model.weights)])
        now.unpersist()
    return model, total


def uncounted(words: pa.Array, at: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The different words at these places and how often each occurs, as a list for each text."""
    found = words.take(pa.array(at)).dictionary_encode()
    kinds = max(1, len(found.dictionary))
    keys, times = np.unique(np.searchsorted(ends, at, "right") * kinds + found.indices.to_numpy(), return_counts=True)
    bounds = pa.array(np.searchsorted(keys, np.arange(len(ends) + 1) * kinds), pa.int32())
    return tuple(pa.ListArray.from_arrays(bounds, x) for x in (found.dictionary.take(pa.array(keys % kinds)), pa.array(times, pa.int64())))


def scored(docs: DataFrame, model: Model, total: int, counts: DataFrame) -> DataFrame:
    """docs: doc_id, text, held_out. A row for each, see score."""
    held = docs.sparkSession.sparkContext.broadcast((model.layout, model.weights))

    def rows(it):
        layout, weights = held.value
        own, waiting, read, tails = Model(layout, weights), [], [], []

        def batch_of():
            n, flat = np.array([len(x) for x in read]), np.concatenate(read)
            known, base, within = (np.add.reduceat(x[flat], np.cumsum(n) - n) for x in (layout.known.astype(np.int64), layout.base, layout.within))
            p = own.run(read) / LOG10 + within
            first = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            out = pa.RecordBatch.from_arrays(
                [*first.columns, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(p), *(pa.concat_arrays(x) for x in zip(*tails))],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "p", "tail", "times"],
            )
            for x in (waiting, read, tails):
                x.clear()
            return out

        size = 0
        for batch in it:
            for part in parts(batch, text=3, size=SPLIT):
                words, ends = tokens(part.column(3))
                numbers = layout.numbers(words)
                ids = layout.ended(numbers, ends)
                read += ids
                size += len(numbers) + len(ids)
                tails.append(uncounted(words, np.flatnonzero(numbers == layout.tail), ends))
                waiting.append(part.select([0, 1, 2]))
                if size >= SCORED:
                    yield batch_of()
                    size = 0
        if waiting:
            yield batch_of()

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), "held_out", "text")
    found = written(map_arrow(keyed, rows, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, p double, tail array<binary>, times array<bigint>"))
    tail = found.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("word"), F.col("x.times").alias("n")).join(counts, "word", "left")
    tail = tail.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("t"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("k"))
    more = F.coalesce("t", F.lit(0.0))
    return found.join(tail, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("p") + more).alias("score"),
    )


def split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and held_out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return pick(docs, id_col, text_col).withColumn("held_out", held_out)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, a row for each input row."""
    ship(docs.sparkSession)
    docs = split(docs, id_col, text_col)
    train = docs.where(~F.col("held_out")).select("doc_id", "text")
    counts = written(count(train))
    return scored(docs, *fit(train, counts), counts)


def op2_language_model(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
