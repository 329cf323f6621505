"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed and joined to the positions of the same k-grams in the license
templates. A hit votes for the diagonal text position - template position; a passage that follows a template
gathers its votes on one diagonal, or on neighbouring ones where words were put in or left out. Neighbouring
diagonals are merged, and a merged span counts once enough of its template's positions are covered, each counted
once. Equal hashes are checked by comparing the words, so chance hits do not vote, and a span has at most WIDER times its
template's words.

The templates are a fixed list, so the side that is broadcast does not grow with the data. Only hits and one
row per text are shuffled.

Cases: null counts as empty; a text without words gives zero counts, null places, empty labels and score 0;
repeated rows give a row each; a null id is carried along; columns besides id and text are not read; texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import pick

K = 3
#: Diagonals at most so far apart are merged; this share of a template's k-grams makes a label.
SLACK, SHARE = 2, 0.8
#: A verified span has at most so many times its template's words.
WIDER = 1.5

#: Phrases that count wherever their words stand one after another, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: License notices as they are usually written, lower-cased and without marks.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0 the license", "apache-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("the gnu lesser general public license", "lgpl"),
    ("the gnu affero general public license", "agpl"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)
#: Words: digits, a-z and everything beyond ASCII.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: lower() also turns the Kelvin sign into k, which is put back first; nothing else beyond ASCII becomes ASCII.
KELVIN, KEEP = "K", "ĸ"


def _grams(texts: tuple[tuple[str, str], ...], base: bool) -> list[tuple]:
    rows = []
    for text, label in texts:
        words = text.split()
        rows += [(label, base, text, i, len(words) - K + 1, words[i : i + K]) for i in range(len(words) - K + 1)]
    return rows


def templates(spark: SparkSession) -> DataFrame:
    """A row for each k-gram of each template: fixed in number, whatever the data."""
    assert max(len(text.split()) for text, _ in BASE + NOTICES) <= 62 + K  # positions are bits of a long
    df = spark.createDataFrame(_grams(BASE, True) + _grams(NOTICES, False), "label string, base boolean, template string, at int, grams int, gram array<string>")
    return df.withColumn("h", F.xxhash64(*(F.get("gram", F.lit(i)) for i in range(K))))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (row, doc_id, n_words, and null) for each text, and one for each verified span: base, label,
    start and end in words, score (the covered share of the template)."""
    lower = F.lower(F.regexp_replace("text", KELVIN, KEEP))
    df = pick(docs, id_col, text_col).withColumn("words", F.array_remove(F.split(lower, BREAKS, -1), ""))
    words, n = F.col("words"), F.size("words")
    hashes = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(K))))
    # the first element stands for the text itself
    hashes = F.when(n >= K, F.concat(F.array(F.lit(None).cast("bigint")), hashes)).otherwise(F.array(F.lit(None).cast("bigint")))
    df = df.withColumn("row", F.monotonically_increasing_id())
    df = df.select("row", "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.posexplode(hashes).alias("pos", "h"))
    df = df.join(F.broadcast(templates(docs.sparkSession)), "h", "left")
    hit = F.col("at").isNotNull() & (F.slice("words", F.col("pos"), F.lit(K)) == F.col("gram"))
    df = df.where((F.col("pos") == 0) | hit)
    df = df.select("row", "doc_id", "n_words", "base", "label", "template", "grams", (F.col("pos") - 1 - F.col("at")).cast("long").alias("diagonal"), "at")

    keys = ["row", "doc_id", "n_words", "base", "label", "template", "grams"]
    votes = df.repartition("row").groupBy(*keys, "diagonal").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), "at")).alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"))
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > SLACK, F.lit(True)) | F.coalesce(F.col("base"), F.lit(False))
    votes = votes.withColumn("part", F.sum(apart.cast("int")).over(line))  # base phrases stay whole diagonals
    merged = votes.groupBy(*keys, "part").agg(
        F.min(F.col("diagonal") + F.col("low")).alias("start"), F.max(F.col("diagonal") + F.col("high") + K).alias("end"), F.bit_or("votes").alias("votes")
    )
    score = F.bit_count("votes") / F.col("grams")  # different positions of the template
    verified = (F.col("score") >= SHARE) & (F.col("end") - F.col("start") <= F.lit(WIDER) * (F.col("grams") + K - 1))
    return merged.withColumn("score", score).where(F.col("base").isNull() | F.when(F.col("base"), F.col("score") == 1).otherwise(verified)).drop("votes", "part", "template", "grams")


def op9_license_scans(spark, sf_dir: str) -> DataFrame:
    df = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.col("base")
    labels = lambda which: F.array_join(F.sort_array(F.collect_set(which)), ",")
    return df.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        labels(F.when(base, F.col("label"))).alias("base_labels"),
        labels(F.col("label")).alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
    ).drop("row")


def sql() -> str:
    rows = ", ".join(f"('{label}', {base}, '{t}', {at}, {n}, '{' '.join(gram)}')" for label, base, t, at, n, gram in _grams(BASE, True) + _grams(NOTICES, False))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(replace(coalesce(text, ''), '{KELVIN}', '{KEEP}')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
t(label, base, template, "at", grams, gram) AS (VALUES {rows}),
g AS (SELECT r, i - 1 AS pos, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
v AS (SELECT r, base, label, template, grams, pos - "at" AS diagonal, bit_or(1::BIGINT << "at"::INTEGER) AS votes, min("at") AS low, max("at") AS high FROM g JOIN t USING (gram) GROUP BY ALL),
p AS (SELECT *, sum(CASE WHEN base OR coalesce(diagonal - prev > {SLACK}, true) THEN 1 ELSE 0 END) OVER (PARTITION BY r, template ORDER BY diagonal) AS part
      FROM (SELECT *, lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) AS prev FROM v)),
m AS (SELECT r, base, label, grams, min(diagonal + low) AS start, max(diagonal + high) + {K} AS stop, bit_count(bit_or(votes)) / grams AS score FROM p GROUP BY r, base, label, template, grams, part),
s AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
        array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) AS score
      FROM m WHERE CASE WHEN base THEN score = 1 ELSE score >= {SHARE} AND stop - start <= {WIDER} * (grams + {K} - 1) END GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN s USING (r)"""
