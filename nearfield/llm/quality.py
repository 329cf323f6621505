"""Quality rules: a threshold table that is compiled into one Spark projection, without user functions.

Each rule compares two counts of a text, as ``100 * numerator <= percent * denominator`` (or ``>=``), in
whole numbers, so any engine gives the same verdict. The table is data: pass another one to change the
rules. A rule over an empty text compares 0 with 0.

Cases: null text counts as empty; an empty text has all counts 0 and fails the base rule (under 50 words).
Repeated rows give repeated results; a null id is carried along. Other columns of the input are not read. A text of any length is taken
whole; the cost is n log n in its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACES, let, pick, position_mask, words_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as with on are be by this was an at or "
    "der die das und ist nicht ein eine zu den mit auf von sich des im "
    "le la les de et des en un une du que qui est dans pour par sur pas avec "
    "el los las y que una por con para del se su es no al lo"
).split()

#: Marks that count as symbols, and the starts and ends of lines that look like lists or cuts.
SYMBOLS = r"[#*$%&|<>]"
BULLETS = ("-", "*", "•", "‣", "·")


@dataclass(frozen=True)
class Rule:
    """Keeps a text if 100 * numerator is at most (or at least) percent * denominator."""

    name: str
    numerator: str
    most: bool
    percent: int
    denominator: str

    def holds(self) -> str:
        """The rule as SQL, for Spark and for other engines alike."""
        return f"100 * {self.numerator} {'<=' if self.most else '>='} {self.percent} * {self.denominator}"


RULES = (
    Rule("symbols", "n_symbols", True, 10, "n_words"),
    Rule("stop_words", "n_stop_words", False, 4, "n_words"),
    Rule("long_words", "word_chars", True, 1500, "n_words"),
    Rule("short_words", "word_chars", False, 200, "n_words"),
    Rule("dup_lines", "n_dup_lines", True, 80, "n_lines"),
    Rule("bullet_lines", "n_bullet_lines", True, 90, "n_lines"),
    Rule("cut_lines", "n_cut_lines", True, 30, "n_lines"),
)

#: The base rule, which no table can lift.
BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def _windows(words: Column) -> Column:
    """A long for each 3-word window, sorted: its hash, with its place in the lowest bits. The place takes only the bits
    that this text needs, so over 40 bits of hash remain for a text of a million words."""
    n = F.size(words)
    gram = lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))
    windows = let(position_mask(n), lambda mask: F.transform(F.sequence(F.lit(1), n - 2), lambda i: gram(i).bitwiseAND(mask).bitwiseOR(i.cast("bigint"))))
    return F.when(n >= 3, F.sort_array(windows)).otherwise(F.array().cast("array<bigint>"))


def _repeated(words: Column, windows: Column, mask: Column) -> Column:
    """Sorted places of the windows that occur twice or more: neighbours of equal hash. Where two such differ in their
    words, as different windows may share a hash, the text's windows are compared by their words instead."""

    def by_hash(mask: Column) -> Column:
        same = lambda x, other: x.bitwiseAND(mask) == other.bitwiseAND(mask)  # noqa: E731  null beyond the ends
        repeats = F.filter(windows, lambda x, i: same(x, F.get(windows, i - 1)) | same(x, F.get(windows, i + 1)))
        return F.transform(repeats, lambda x: x.bitwiseAND(F.bitwise_not(mask)))

    def mixed(mask: Column) -> Column:
        own = lambda x: F.slice(words, x.bitwiseAND(F.bitwise_not(mask)).cast("int"), F.lit(3))
        differ = lambda x, other: F.when(x.bitwiseAND(mask) == other.bitwiseAND(mask), own(x) != own(other)).otherwise(F.lit(False))
        return F.exists(F.transform(windows, lambda x, i: F.when(i == 0, F.lit(False)).otherwise(differ(x, F.get(windows, i - 1)))), lambda x: x)

    def by_words() -> Column:
        places = F.sequence(F.lit(1).cast("bigint"), F.size(words).cast("bigint") - 2)
        grams = F.sort_array(F.transform(places, lambda i: F.struct(F.array_join(F.slice(words, i.cast("int"), F.lit(3)), " ").alias("gram"), i.alias("at"))))
        same = lambda x, other: x["gram"] == other["gram"]
        found = let(grams, lambda g: F.filter(g, lambda x, i: same(x, F.get(g, i - 1)) | same(x, F.get(g, i + 1))))
        return F.transform(found, lambda x: x["at"])

    return F.sort_array(F.when(let(mask, mixed), by_words()).otherwise(let(mask, by_hash)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id and the counts that rules may name; with carry, the input row as a struct, __row. One row per
    input row, no shuffle."""
    df = pick(docs, id_col, text_col, carry).withColumn("words", words_of(F.col("text")))
    words, n = F.col("words"), F.size("words")
    df = df.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, SPACES, "") != "")).withColumn("windows", _windows(words)).withColumn("mask", position_mask(n))
    windows, lines = F.col("windows"), F.col("lines")

    df = df.withColumn("at", _repeated(words, windows, F.col("mask")))
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(3)), F.lit(3))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return df.select(
        *(["doc_id", "__row"] if carry else ["doc_id"]),
        # a filter on the counts would be pushed below these projections and work them out again, word by word;
        # it stays above a column that is not a function of the row alone
        (n.cast("long") + 0 * F.monotonically_increasing_id()).alias("n_words"),
        F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter(lines, lambda x: F.substring(F.regexp_replace(x, "^" + SPACES, ""), 1, 1).isin(*BULLETS))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).cast("long").alias("n_cut_lines"),
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The counts, base_failed, kept, and failed_rules: the names of the table's rules that a text fails."""
    df = measure(docs, id_col, text_col, carry)
    failed = F.concat_ws(",", *(F.when(~F.expr(r.holds()), r.name) for r in rules)) if rules else F.lit("")
    return df.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that are kept, unchanged."""
    return judge(docs, rules, id_col, text_col, carry=True).where("kept").select("__row.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    df = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def sql() -> str:
    """The same in DuckDB's SQL, from the same table of rules."""
    strings = lambda xs: ", ".join(f"'{x}'" for x in xs)
    failed = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({r.holds()}) THEN '{r.name}' END" for r in RULES) + ")"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[ \\t\\n\\x0b\\x0c\\r]+', '', 'g') <> '') AS lines FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
        FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
p AS (SELECT DISTINCT r, i + unnest([0, 1, 2]) AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT r, count(*) AS n_repeat_words FROM p GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        len(lines) AS n_lines, len(list_filter(words, lambda x: x IN ({strings(STOP_WORDS)}))) AS n_stop_words,
        len(list_filter(lines, lambda x: regexp_replace(x, '^[ \\t\\n\\x0b\\x0c\\r]+', '')[1] IN ({strings(BULLETS)}))) AS n_bullet_lines,
        len(list_filter(lines, lambda x: x LIKE '%...' OR x LIKE '%…')) AS n_cut_lines
      FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, {BASE_FAILED} AS base_failed, {failed} AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules,
  NOT base_failed AND failed_rules = '' AS kept FROM f"""
