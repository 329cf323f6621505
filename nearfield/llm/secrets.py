"""Secret scans: multipart credential linking, in built-in functions only.

Strong kinds (assign, access, hex) are reported wherever they match. Weak kinds (user, key, endpoint) match a
lot of harmless text, so a weak part is reported only if complementary parts stand near it: an identifier or
an endpoint needs a secret within the scope, and a bare key needs an identifier or an endpoint. The scope is
``scope`` code points either side of a part's start.

Parts become rows; a text's parts are sorted by start once, and the interval join runs as a range frame over
them, so that no pairs are made however many parts a text has. Only parts are shuffled, never texts.

Cases: null counts as empty; a text without parts gives counts of 0 and an empty list; repeated rows give a
row each (rows are told apart by a row number, not by their id); columns besides id and text are not read.
Texts are scanned whole. Positions are code points, the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import let, pick


def _either(words: str) -> str:
    """A pattern for the words in either case of A-Z. A flag would also match letters beyond ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


@dataclass(frozen=True)
class Kind:
    """role: id, secret or endpoint. keep: SQL over a match m that it must meet. needs: strings of which any
    text with a match that is kept has at least one; looking for them is cheaper than the pattern."""

    name: str
    pattern: str
    role: str
    strong: bool
    keep: str = "true"
    needs: tuple[str, ...] = ()


_SET = r"[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?"  # an assignment, with quotes or without
_ASSIGN = "(" + _either("password|passwd|secret|token|api_?key") + ")" + _SET + "([A-Za-z0-9+/_.=-]+)"

#: In the order in which spans with one start are listed. Leftmost maximal runs of 24 or 20 characters are
#: the maximal runs that are long enough, so a bound in the pattern drops the same matches as a check after it.
KINDS = (
    Kind("assign", _ASSIGN, "secret", True, "LENGTH(REGEXP_EXTRACT(m, {pattern}, 2)) >= 6", (":", "=")),
    Kind("access", "AKIA[A-Z0-9]{16,}", "id", True, needs=("AKIA",)),
    Kind("hex", "[0-9a-f]{24,}", "secret", True),
    Kind("user", "(" + _either("user_?name|user|login|client_?id|account_?id") + ")" + _SET + "[A-Za-z0-9@._-]{3,}", "id", False, needs=(":", "=")),
    Kind("key", "[A-Za-z0-9+/_-]{20,}", "secret", False, "REGEXP_LIKE(m, '[0-9]') AND REGEXP_LIKE(m, '[A-Z]') AND REGEXP_LIKE(m, '[a-z]')", tuple("0123456789")),
    Kind("endpoint", "(https?|ftp|s3|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", "endpoint", False, needs=("://",)),
)
SCOPE = 400


def _keeps(kind: Kind, like: str = "REGEXP_LIKE", raw: str = "r") -> str:
    return kind.keep.replace("{pattern}", f"{raw}'{kind.pattern}'").replace("REGEXP_LIKE", like)


def _parts(kind: Kind, no: int, found: Column) -> Column:
    """The matches with the length of the text between each and the one before. The pattern runs a second
    time, as a split, only over a text that has a match."""
    parts = let(
        F.split(F.col("text"), kind.pattern, -1),
        lambda gaps: F.transform(found, lambda m, i: F.struct(F.lit(no).alias("kind"), i.cast("long").alias("i"), F.length(F.get(gaps, i)).cast("long").alias("gap"), m.alias("m"))),
    )
    return F.when(F.size(found) > 0, parts)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text) and spans: array of (start, kind, end), kind as its number in
    KINDS, by start, then kind. A row for each input row."""
    df = pick(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).withColumn("text_hash", F.xxhash64("text"))
    for k in KINDS:
        found = F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))
        df = df.withColumn(k.name, F.when(reduce(or_, (F.contains("text", F.lit(x)) for x in k.needs)), found) if k.needs else found)
    part = "struct<kind:int,i:bigint,gap:bigint,m:string>"
    own = F.array(F.lit(None).cast(part))  # stands for the row itself, so that none gets lost
    df = df.withColumn("parts", F.concat(own, *(F.coalesce(_parts(k, no, F.col(k.name)), F.array().cast(f"array<{part}>")) for no, k in enumerate(KINDS))))
    df = df.select("row", "doc_id", "text_hash", F.explode("parts").alias("p")).select("row", "doc_id", "text_hash", "p.*")

    ordered = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(ordered)).withColumn("start", F.col("end") - F.length("m"))
    keep = F.coalesce(*(F.when(F.col("kind") == no, F.expr(_keeps(k))) for no, k in enumerate(KINDS)))
    of = lambda test: F.col("kind").isin(*(no for no, k in enumerate(KINDS) if test(k)))
    strong = of(lambda k: k.strong)
    df = df.where(F.col("kind").isNull() | keep)

    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("inside", F.coalesce(F.max(F.when(strong, F.col("end"))).over(before) > F.col("start"), F.lit(False)))
    df = df.where(F.col("kind").isNull() | strong | ~F.col("inside"))

    near = Window.partitionBy("row").orderBy("start").rangeBetween(-scope, scope)
    count = lambda role: F.count(F.when(of(lambda k: k.role == role), 1)).over(near)
    df = df.withColumn("ids", count("id")).withColumn("secrets", count("secret")).withColumn("endpoints", count("endpoint"))
    linked = F.when(of(lambda k: k.role == "secret"), F.col("ids") + F.col("endpoints") > 0).otherwise(F.col("secrets") > 0)
    span = F.when(strong | (F.col("kind").isNotNull() & linked), F.struct("start", "kind", "end"))
    return df.groupBy("row", "doc_id", "text_hash").agg(F.sort_array(F.collect_list(span)).alias("spans")).drop("row")


def _listed(spans: Column) -> Column:
    name = lambda no: F.element_at(F.array(*(F.lit(k.name) for k in KINDS)), no + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, mark: str = "<secret>") -> DataFrame:
    """docs with every reported span replaced by the mark; overlapping spans become one. All rows and columns
    stay. Texts are joined with their spans by id and hash, so repeated rows are treated alike."""
    found = scan(docs, id_col, text_col, scope).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    text = F.col(f"`{text_col}`")
    both = docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__hash")), "left")
    spans = F.col("__spans")
    # the furthest end of the spans up to each one: each step looks twice as far back
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int")), lambda b: F.call_function("shiftleft", F.lit(1), b))
    furthest = F.aggregate(steps, F.transform(spans, lambda s: s["end"]), lambda ends, step: F.transform(ends, lambda x, i: F.greatest(x, F.get(ends, i - step))))
    piece = lambda s, e: F.when(s["start"] >= e, F.concat(F.substring(text, e + 1, s["start"] - e), F.lit(mark))).otherwise(F.lit(""))
    pieces = let(furthest, lambda ends: F.transform(spans, lambda s, i: piece(s, F.coalesce(F.get(ends, i - 1), F.lit(0)))))
    rest = let(F.array_max(F.transform(spans, lambda s: s["end"])), lambda e: F.substring(text, e + 1, F.length(text)))
    clean = F.when(F.col("__id").isNull() & F.col("__hash").isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return both.select(*(clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda no: F.size(F.filter(spans, lambda s: s["kind"] == no)).cast("long")
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        *(count(no).alias(f"n_{k.name}") for no, k in enumerate(KINDS[:3])),
        F.sha2(_listed(F.filter(spans, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
    )


def sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT r, {no} AS kind, '{k.name}' AS name, '{k.role}' AS role, {k.strong} AS strong, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap FROM "
        f"(SELECT r, regexp_extract_all(text, {quoted(k.pattern)}) AS ms, regexp_split_to_array(text, {quoted(k.pattern)}) AS gaps FROM d)"
        for no, k in enumerate(KINDS)
    )
    keep = " OR ".join(f"(kind = {no} AND {_keeps(k, 'regexp_matches', '')})" for no, k in enumerate(KINDS))
    near = f"OVER (PARTITION BY r ORDER BY start RANGE BETWEEN {SCOPE} PRECEDING AND {SCOPE} FOLLOWING)"
    listed = "coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind){}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
s AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM f),
k AS (SELECT *, stop - length(m) AS start FROM s WHERE {keep}),
b AS (SELECT *, max(CASE WHEN strong THEN stop END) OVER (PARTITION BY r ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM k),
n AS (SELECT *, count(CASE WHEN role = 'id' THEN 1 END) {near} AS ids, count(CASE WHEN role = 'secret' THEN 1 END) {near} AS secrets,
        count(CASE WHEN role = 'endpoint' THEN 1 END) {near} AS ends FROM b WHERE strong OR coalesce(upto, 0) <= start),
o AS (SELECT * FROM n WHERE strong OR CASE WHEN role = 'secret' THEN ids + ends > 0 ELSE secrets > 0 END),
a AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        {listed.format(' FILTER (strong)')} AS base, {listed.format('')} AS spans FROM o GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""
