"""Document fingerprints by order min-hash, in built-in functions only.

A text's k-mers are runs of K words. Each is numbered by its occurrence (the first "a b c" is another element
than the second), and the numbered k-mers are hashed. The hashes lie on a ring that is cut into BINS bins; each bin
selects the two elements that follow its start (so in a short text neighbouring bins share elements, and every bin has
two), puts them back into the order of the text, and hashes that tuple. So a bin agrees between two texts only if both
select the same k-mers and hold them in the same order, which falls with edit distance and not just with the set of
k-mers. One hash a k-mer serves all bins, and one sort selects for all of them, so a text costs n log n and not n times
the number of hash functions.

A fingerprint has four hex digits a bin, or dots in a text without words. The likeness of two fingerprints is the
share of bins, among those that either fills, in which they agree.

Cases: null counts as empty; a text without words fills no bin, and two such are alike (1.0); a text of fewer
than K words is one k-mer, and so one element, which every bin selects alone; equal texts have equal fingerprints;
repeated rows give a row each; null ids come before all others, and equal ids are in the order of their texts' hashes;
the only row's next one is itself; other columns are not read. Texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import LEAST, ROWS_PER_RANGE, number_of, spread
from .text import let, pick, words_of

K = 3
BIN_BITS = 6
BINS = 1 << BIN_BITS
EMPTY = "...."
#: A long holds 40 bits of hash over 24 bits of position. Positions of longer texts are coarser.
POSITION = (1 << 24) - 1


def _shr(x: Column, n) -> Column:
    return F.call_function("shiftright", x, F.lit(n) if isinstance(n, int) else n)


def with_fingerprint(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """df with the fingerprint of a text column. Columns whose names start with __ are in use meanwhile."""
    hash_of = lambda x: _shr(x, 24)
    bin_of = lambda x: _shr(x, 64 - BIN_BITS)
    words, n = F.col("__w"), F.size("__w")
    df = df.withColumn("__w", words_of(F.col(text_col)))
    coarser = F.greatest(F.ceil(F.log2(n.cast("double") + 1)).cast("int") - 24, F.lit(0))
    mark = lambda h, at: h.bitwiseAND(F.lit(~POSITION)).bitwiseOR(at.cast("bigint"))
    grams = let(coarser, lambda c: F.transform(F.sequence(F.lit(0), n - K), lambda i: mark(F.xxhash64(*(F.get(words, i + j) for j in range(K))), _shr(i, c))))
    few = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(mark(F.xxhash64(F.concat_ws(" ", words)), F.lit(0))))
    df = df.withColumn("__g", F.when(n >= K, F.sort_array(grams)).otherwise(few))
    # steps that together reach any distance within the array, longest first
    df = df.withColumn("__steps", F.transform(F.sequence(F.ceil(F.log2(F.size("__g") + 1.0)).cast("int"), F.lit(0)), lambda b: F.call_function("shiftleft", F.lit(1), b)))

    g = F.col("__g")
    same = lambda x, i: hash_of(F.get(g, i)) == hash_of(x)

    def occurrence(x: Column, j: Column) -> Column:
        """How many equal k-mers stand before this one: equal hashes are neighbours in the sorted array, so
        the first of them is found by halving steps."""
        first = F.aggregate("__steps", j, lambda low, step: F.when((step <= low) & same(x, low - step), low - step).otherwise(low))
        return F.when((j > 0) & same(x, j - 1), j - first).otherwise(F.lit(0))

    numbered = F.transform(g, lambda x, j: mark(F.xxhash64(hash_of(x), occurrence(x, j)), x.bitwiseAND(F.lit(POSITION))))
    df = df.withColumn("__e", F.sort_array(numbered))
    e, m = F.col("__e"), F.size("__e")
    # of the sorted elements those that come first in their bin, by place
    df = df.withColumn("__s", F.filter(F.transform(e, lambda x, j: F.when((j == 0) | (bin_of(F.get(e, j - 1)) != bin_of(x)), j)), lambda j: j.isNotNull()))
    s = F.col("__s")
    position = lambda x: x.bitwiseAND(F.lit(POSITION))
    pair = lambda a, b: F.when(position(a) <= position(b), F.xxhash64(hash_of(a), hash_of(b))).otherwise(F.xxhash64(hash_of(b), hash_of(a)))
    digits = lambda h: F.substring(F.hex(h.bitwiseAND(F.lit(0xFFFF)) + 0x10000), 2, 4)
    code = lambda j: F.when(m == 1, digits(F.xxhash64(hash_of(F.get(e, j))))).otherwise(digits(pair(F.get(e, j), F.get(e, F.when(j + 1 < m, j + 1).otherwise(F.lit(0))))))
    # such an element serves its own bin and those before it that have none; the first also those after the last
    own = lambda j: bin_of(F.get(e, j)).cast("int")
    codes = F.transform(s, lambda j, t: F.repeat(code(j), own(j) - F.when(t == 0, F.lit(-BINS // 2 - 1)).otherwise(own(F.get(s, t - 1)))))
    rest = F.repeat(code(F.get(s, F.lit(0))), F.lit(BINS // 2 - 1) - own(F.element_at(s, -1)))
    df = df.withColumn(name, F.when(m == 0, EMPTY * BINS).otherwise(F.lower(F.concat(F.array_join(codes, ""), rest))))
    return df.drop("__w", "__g", "__steps", "__e", "__s")


def likeness(a: Column, b: Column) -> Column:
    """The share of bins in which two fingerprints agree, among those that either fills; 1 if neither fills any."""
    slot = lambda x, i: F.substring(x, i * 4 + 1, F.lit(4))
    bins = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.struct(slot(a, i).alias("a"), slot(b, i).alias("b")))
    filled = F.filter(bins, lambda x: (x["a"] != EMPTY) | (x["b"] != EMPTY))
    return let(filled, lambda f: F.when(F.size(f) == 0, F.lit(1.0)).otherwise(F.size(F.filter(f, lambda x: x["a"] == x["b"])) / F.size(f)))


def with_next(docs: DataFrame, prepare=lambda df: df) -> DataFrame:
    """doc_id, text, what prepare adds, and next_...: the same columns of the next row by doc_id (null first; equal ids
    by the hash of their texts), after the last the first.

    No task holds the whole order: ids are cut into ranges, and an id that a great many rows share into several. Each
    range is sorted by itself, and takes a copy of the first row of the following range. The driver keeps two numbers
    a range."""
    key, tie = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)), F.xxhash64("text")
    docs = docs.select("doc_id", "text", key.alias("key"), tie.alias("tie"))
    docs = docs.withColumn("bucket", number_of(F.col("key"), F.col("tie"), spread(docs, ROWS_PER_RANGE, "key")))
    firsts = sorted(tuple(r) for r in docs.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("f")).select("bucket", "f.*").collect())
    after = [(b, *firsts[(i + 1) % len(firsts)][1:]) for i, (b, _, _) in enumerate(firsts)]
    after = docs.sparkSession.createDataFrame(after, "bucket int, key bigint, tie bigint")
    # of rows with one id and hash, which are alike, one is enough
    copies = docs.drop("bucket").join(F.broadcast(after), ["key", "tie"]).groupBy("bucket", "key", "tie").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    columns = ["doc_id", "text", "key", "tie"]
    both = docs.select("bucket", F.lit(0).alias("copy"), *columns).unionByName(copies.select("bucket", F.lit(1).alias("copy"), *columns))
    both = prepare(both)
    line = Window.partitionBy("bucket").orderBy("copy", "key", "tie", "text")
    more = [c for c in both.columns if c not in ("bucket", "copy", "key", "tie")]
    return both.select("copy", *more, *(F.lead(c).over(line).alias(f"next_{c}") for c in more)).where("copy = 0").drop("copy")


def op4_order_minhash(spark, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    df = with_next(docs, lambda df: with_fingerprint(df, "text", "fingerprint"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    df = df.select("doc_id", n.cast("long").alias("n_chars"), "edited", "fingerprint", "next_fingerprint")
    df = with_fingerprint(df, "edited", "edited_fingerprint")
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
