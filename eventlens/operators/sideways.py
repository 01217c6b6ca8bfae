"""Sideways information: keep, early, only the rows whose key another table has.

A join that follows an aggregation of a large table (the cohort of every user)
needs few of its groups when the other side is selective (the paying players).
``only_keys`` filters the large table before its aggregation with a bit set of
the other side's key hashes.  The set has a fixed size, is built by a partial
aggregation (``bit_or`` per 64-bit word, so at most one row per word is
shuffled) and reaches the tasks as a scalar subquery: one lazy plan, and no
size to check, because the set does not grow with the data.  With k keys about
k / (64 * words) of the other rows pass as well; the join that follows stays
exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: 2**17 words of 64 bits: 1 MB, 8 million bits.
WORDS = 1 << 17


def _place(key: str | Column, words: int) -> tuple[Column, Column]:
    h = F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(words * 64))
    return F.floor(h / F.lit(64)).cast("int"), F.pmod(h, F.lit(64)).cast("int")


def key_bits(keys: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """One row, one column: the bit set of ``keys[key]`` as an array of words."""
    word, bit = _place(key, words)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    some = keys.filter(F.col(key).isNotNull()).select(word.alias("word"), bit.alias("bit")) \
        .groupBy("word").agg(F.bit_or(one).alias("bits"))
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    dense = some.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    listed = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return dense.agg(F.transform(listed, lambda x: x["bits"]).alias("words"))


def only_keys(rows: DataFrame, row_key: str, keys: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """The rows whose ``row_key`` may be among ``keys[key]``: all that are, and
    a few that are not.  Rows with a NULL key go."""
    word, bit = _place(row_key, words)
    bits = key_bits(keys, key, words).scalar()
    return rows.filter(F.col(row_key).isNotNull() & (F.call_function("getbit", F.get(bits, word), bit) == 1))
