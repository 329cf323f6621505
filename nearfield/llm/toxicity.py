"""Toxicity by cumulative-link ordinal regression.

Severity has three grades: 0, not toxic; 1, toxic; 2, toxic with a large share of marker words (the labels say
only whether a text is toxic, so the grade of toxic texts follows from words that mark them). One weight vector
serves both thresholds, P(grade > k) = sigmoid(w.x - t_k) with t_0 < t_1, over sparse features: a text's words,
lower-cased runs of letters and of characters beyond ASCII, and the first STARTS characters of longer words, so
that compounds of one stem count together. A feature that k of a text's t words have is worth
2 sqrt(k) / t^(1/4): it counts for more in a short text, and more often is more. Soft thresholding chooses the
features. The output is the expected severity, sum of k P(k), and a text is toxic if P(grade > 0) reaches THRESHOLD.

The model is fitted on the driver from a bounded sample: the SAMPLE labelled documents whose ids hash lowest.
Executors send 6 bytes a different feature of these. Every document is then scored whole.

Cases: null counts as empty and is scored by the thresholds alone; labels without a document, with a null
grade or a null id are left out of the sample, and those repeated for one document count once; a document whose
id is null or repeated is scored like any other; texts of the sample that have equal features count once for each
label; without labels of both kinds nothing is toxic; repeated rows are scored alike; other columns are carried
along untouched.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow, ship
from .text import pick, whole

SAMPLE, THRESHOLD = 8000, 0.4
#: A feature counts if it is in so many different texts of the sample. Markers are MARKS times likelier in toxic texts.
LEAST_TEXTS, MARKS = 5, 8
STARTS = (4, 5, 6)
_WORD_BYTES = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
GRADES = 3
#: Words whose features a worker keeps.
MOST_KEPT = 100_000


def words(text: bytes) -> Counter:
    """The text's different words and how often each occurs."""
    return Counter(text.lower().translate(_WORD_BYTES).split())


def _hash(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word)


def features_of(word: bytes) -> list[int]:
    """Hashes of the word and of its starts. A start is marked by a space, which no word holds."""
    chars = word.decode("utf-8", "replace")
    return [_hash(word), *(_hash(b" " + chars[:n].encode()) for n in STARTS if len(chars) > n)]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of the text's features, how many words have each (65,535 at most), and the number of words."""
    found, counted = words(text), Counter()
    for word, k in found.items():
        for f in features_of(word):
            counted[f] += k
    hashes = np.fromiter(counted, np.uint32, len(counted))
    counts = np.minimum(np.fromiter(counted.values(), np.int64, len(counted)), 0xFFFF).astype(np.uint16)
    order = np.argsort(hashes)
    return hashes[order], counts[order], sum(found.values())


def value(k, n):
    """Of a feature that k of n words have."""
    return 2 * np.sqrt(k) / np.maximum(n, 1) ** 0.25


@dataclass(frozen=True)
class Model:
    """weights by a feature's hash; thresholds in ascending order."""

    weights: dict[int, float]
    thresholds: tuple[float, float]
    _kept: dict = field(default_factory=dict, repr=False, compare=False)

    def score(self, text: bytes) -> float:
        found, counted = words(text), Counter()
        for word, k in found.items():
            if (own := self._kept.get(word)) is None:
                if len(self._kept) >= MOST_KEPT:
                    self._kept.clear()
                own = self._kept[word] = tuple(f for f in features_of(word) if f in self.weights)
            for f in own:
                counted[f] += k
        n = sum(found.values())
        return float(sum(sorted(self.weights[f] * value(min(k, 0xFFFF), n) for f, k in counted.items())))

    def severity(self, text: bytes) -> tuple[float, float, int]:
        """P(grade > 0), the expected severity, and the likeliest grade."""
        s = self.score(text)
        above = [1 / (1 + np.exp(np.clip(t - s, -60, 60))) for t in self.thresholds]
        grades = [1 - above[0], above[0] - above[1], above[1]]
        return float(above[0]), float(sum(above)), int(np.argmax(grades))


class Sparse:
    """A row for each text: index and worth of its features, one after another, in blocks that are worked through."""

    BLOCK = 1 << 18

    def __init__(self, sizes: np.ndarray, index: np.ndarray, worth: np.ndarray, m: int) -> None:
        self.n, self.m, self.index, self.worth = len(sizes), m, index, worth
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.blocks = [slice(i, i + self.BLOCK) for i in range(0, len(index), self.BLOCK)]

    def by_row(self, x: np.ndarray) -> np.ndarray:
        """Each text's sum of x by its features, times their worth."""
        out = np.zeros(self.n)
        for b in self.blocks:
            out += np.bincount(self.row[b], x[self.index[b]] * self.worth[b], self.n)
        return out

    def by_feature(self, y: np.ndarray, plain: bool = False) -> np.ndarray:
        """Each feature's sum of y by the texts that have it, times its worth there unless plain."""
        out = np.zeros(self.m)
        for b in self.blocks:
            out += np.bincount(self.index[b], y[self.row[b]] * (1 if plain else self.worth[b]), self.m)
        return out


def _descend(data: Sparse, grades: np.ndarray, rounds: int, rate: float, l1: float) -> tuple[np.ndarray, tuple[float, float]]:
    """The weights and two thresholds: Adam over all rows a round, with soft thresholding by l1."""
    n, m = data.n, data.m
    share = np.clip([(grades > k).mean() for k in range(2)], 1e-4, 1 - 1e-4)
    low, high = np.log((1 - share) / share)
    x = np.concatenate([np.zeros(m), [low, np.log(max(high - low, 1e-2))]])  # weights, t0, log(t1 - t0)
    mean, square = np.zeros(m + 2), np.zeros(m + 2)
    for i in range(1, rounds + 1):
        s, t = data.by_row(x[:m]), (x[m], x[m] + np.exp(x[m + 1]))
        a0, a1 = (1 / (1 + np.exp(np.clip(y - s, -60, 60))) for y in t)
        middle = np.maximum(a0 - a1, 1e-12)
        # of -log P(grade) by s - t0 and by s - t1
        g0 = np.select([grades == 0, grades == 1], [a0, -a0 * (1 - a0) / middle], 0.0)
        g1 = np.select([grades == 1, grades == 2], [a1 * (1 - a1) / middle, -(1 - a1)], 0.0)
        g = np.concatenate([data.by_feature(g0 + g1), [-(g0 + g1).sum(), -g1.sum() * (t[1] - t[0])]]) / n
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        step = rate / (np.sqrt(square / (1 - 0.99**i)) + 1e-6)
        x -= step * mean / (1 - 0.9**i)
        x[:m] = np.sign(x[:m]) * np.maximum(np.abs(x[:m]) - step[:m] * l1, 0)
        x[m + 1] = np.clip(x[m + 1], -5, 2)
    w, t = x[:m], (x[m], x[m] + np.exp(x[m + 1]))
    return w, t


def _grades(data: Sparse, toxic: np.ndarray) -> np.ndarray:
    """0 for a text that is not toxic; a toxic one has grade 2 if its markers are worth as much as in the median
    toxic text that has any. Markers are MARKS times likelier in toxic texts."""
    n, k = len(toxic), toxic.sum()
    inside, outside = data.by_feature(toxic.astype(float), plain=True), data.by_feature((~toxic).astype(float), plain=True)
    marker = (inside + 0.5) / (k + 1) >= MARKS * (outside + 0.5) / (n - k + 1)
    strength = data.by_row(marker.astype(float))
    some = strength[toxic & (strength > 0)]
    return np.where(toxic, np.where(strength >= (np.median(some) if len(some) else np.inf), 2, 1), 0)


def fit(texts: list[tuple[np.ndarray, np.ndarray, int]], toxic: np.ndarray, shrink: float = 0.0003, rounds: int = 200, rate: float = 0.05) -> Model:
    """texts: each one's features. Texts of equal features and label count once."""
    first = list({(f.tobytes(), k.tobytes(), bool(y)): i for i, ((f, k, _), y) in reversed(list(enumerate(zip(texts, toxic))))}.values())
    texts, toxic = [texts[i] for i in first], np.array([toxic[i] for i in first], bool)
    if len(texts) == 0 or toxic.all() or not toxic.any():
        return Model({}, (30.0, 31.0))
    vocabulary, often = np.unique(np.concatenate([f for f, _, _ in texts]), return_counts=True)
    vocabulary = vocabulary[often >= LEAST_TEXTS]
    m = len(vocabulary)
    if m == 0:
        return Model({}, (30.0, 31.0))
    sizes, index, worth = [], np.zeros(sum(len(f) for f, _, _ in texts), np.int32), np.zeros(sum(len(f) for f, _, _ in texts), np.float32)
    end = 0
    for f, k, n in texts:
        at = np.minimum(np.searchsorted(vocabulary, f), m - 1)
        hit = vocabulary[at] == f
        sizes.append(int(hit.sum()))
        index[end : end + sizes[-1]] = at[hit]
        worth[end : end + sizes[-1]] = value(k[hit], n)
        end += sizes[-1]
    data = Sparse(np.array(sizes), index[:end], worth[:end], m)
    w, t = _descend(data, _grades(data, toxic), rounds, rate, shrink)
    keep = np.abs(w) > 1e-6
    return Model(dict(zip(vocabulary[keep].tolist(), w[keep].tolist())), (float(t[0]), float(t[1])))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """labels: doc_id, toxic (0 or 1)."""

    def hashes(it):
        for batch in it:
            found = [features(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f, _, _ in found], pa.binary()), pa.array([k.tobytes() for _, k, _ in found], pa.binary()), pa.array([n for _, _, n in found], pa.int64()), batch.column(1)], ["features", "counts", "n", "toxic"])

    graded = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the bound that the broadcast has
    texts = pick(docs, id_col, text_col)
    rows = map_arrow(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), hashes, "features binary, counts binary, n bigint, toxic int").toArrow()
    columns = [rows.column(i).to_pylist() for i in range(4)]
    del rows
    order = sorted(range(len(columns[0])), key=lambda i: tuple(c[i] for c in columns))
    found = [(np.frombuffer(columns[0][i], np.uint32), np.frombuffer(columns[1][i], np.uint16), columns[2][i]) for i in order]
    return fit(found, np.array([columns[3][i] > 0 for i in order]))


def severity(model: Model, text: Column) -> Column:
    """A struct of p_toxic, expected_severity and grade."""

    @F.pandas_udf("p_toxic double, expected_severity double, grade int")
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.severity(t.encode("utf-8", "surrogatepass")) for t in texts], columns=["p_toxic", "expected_severity", "grade"])

    return score(whole(text))


def with_severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs and a struct column __severity."""
    ship(docs.sparkSession)
    return docs.withColumn("__severity", severity(train(docs, labels, id_col, text_col), F.col(f"`{text_col}`")))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    df = with_severity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return df.select("doc_id", "__severity.*").withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
