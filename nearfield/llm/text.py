"""Column helpers that the text operators share. Every helper is made of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The text's words in order. array_remove takes off the empty ends that a split leaves."""
    return F.array_remove(F.split(text, SPACES, -1), "")


def pick(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """Id and whole text under names of our own, so that no other column can clash with them. With carry, the
    input row goes along as a struct, __row."""
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")] if carry else []
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), whole(F.col(f"`{text_col}`")).alias("text"), *row)


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once and not again for each element of an inner function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def position_mask(n: Column) -> Column:
    """A long whose zero bits hold any position up to n. ``hash & mask | position`` sorts by hash, then by
    position; n takes as few bits as it needs, so the rest of the hash remains."""
    bits = F.greatest(F.ceil(F.log2(n.cast("double") + 1)).cast("int"), F.lit(1))
    return -F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)
