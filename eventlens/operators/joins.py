"""Joins of many rows to one row per key, when NULL or a few keys are frequent.

A row whose key has a NULL part matches nothing, but a hash shuffle sends all
such rows to one task.  The join key is therefore a text: ``v`` + key for a
complete key and ``n`` + hash of the row for an incomplete one, so those rows
spread over all tasks and, having another first letter, can never equal a real
key.

Frequent real keys are found by a frequent-items sketch over the left side
(``frequent_keys``), a single partial aggregation.  The right side has one row
per key, so the rows of at most ``MAX_FREQUENT`` keys are broadcast: a left row
of such a key gets its match there and goes through the shuffled join under a
key of its own, like a row without a key.  The right side is shuffled once and
not repeated.  All of it is one lazy plan; the sketch reads the left side's last
exchange again and not its input.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

KEY = "_join_key"
_FOUND, _ROW = "_join_found", "_join_row"
#: Keys that the sketch may report (and that are broadcast), and the items it
#: tracks: a key with more than about 4 / TRACKED of the rows is never missed.
MAX_FREQUENT, TRACKED = 1000, 16384
#: A key is frequent with at least this many rows, and with more than this share.
MIN_ROWS, MIN_SHARE = 1000, 1 / 2000


def _complete(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _row_key(df: DataFrame) -> Column:
    """A key that no other row needs and that matches nothing."""
    return F.concat(F.lit("n"), F.xxhash64(*[F.col(c) for c in df.columns]).cast("string"))


def key_text(df: DataFrame, keys: Sequence[str]) -> Column:
    """Never-NULL join key of a row: the first key as text, or the row's hash
    when some key is NULL."""
    return F.when(_complete(keys), F.concat(F.lit("v"), F.col(keys[0]).cast("string"))).otherwise(_row_key(df))


def with_key(right: DataFrame, key: str) -> DataFrame:
    """``right`` with its join key instead of ``key``.  A table that is aggregated
    by this column is already dealt out as the join needs it."""
    return right.filter(F.col(key).isNotNull()).withColumn(KEY, F.concat(F.lit("v"), F.col(key).cast("string"))).drop(key)


def frequent_keys(keyed: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """Column ``KEY``: at most ``MAX_FREQUENT`` keys of ``keyed`` that may have
    more than ``min_share`` of its rows.  Rows without a key never qualify."""
    items = F.call_function("approx_top_k", F.col(KEY), F.lit(MAX_FREQUENT), F.lit(TRACKED))
    found = keyed.agg(items.alias("items"), F.count(F.lit(1)).alias("rows")).select("rows", F.inline("items"))
    limit = F.greatest(F.lit(float(min_rows)), F.col("rows") * F.lit(min_share))
    return found.filter((F.col("count") >= limit) & F.col("item").startswith("v")).select(F.col("item").alias(KEY))


def join_keyed(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
               frequent: bool = False, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """``left JOIN right USING (keys)``, ``how`` left or inner; ``right`` has at
    most one row per key (callers pass aggregated tables; see ``with_key``).  With
    ``frequent`` (one key only) a few keys may hold most rows of ``left``."""
    keys = list(keys)
    added = [c for c in right.columns if c not in (*keys, KEY)]
    if frequent and len(keys) != 1:
        raise ValueError("frequent keys are handled for a single key column")
    r = right if KEY in right.columns else with_key(right.filter(_complete(keys)), keys[0])
    l = left.withColumn(KEY, key_text(left, keys))
    on = [KEY, *keys[1:]]
    if not frequent:
        if how == "inner":
            l = l.filter(_complete(keys))
        return l.join(r, on, how).select(*left.columns, *added)
    few = r.join(F.broadcast(frequent_keys(l, min_rows, min_share)), KEY, "left_semi")
    few = few.select(KEY, F.struct(*added).alias(_FOUND))
    l = l.join(F.broadcast(few), KEY, "left")
    l = l.withColumn(KEY, F.when(F.col(_FOUND).isNotNull(), _row_key(left)).otherwise(F.col(KEY)))
    out = l.join(r.select(KEY, F.struct(*added).alias(_ROW)), KEY, "left")
    match = F.coalesce(F.col(_FOUND), F.col(_ROW))
    if how == "inner":
        out = out.filter(match.isNotNull())
    return out.select(*left.columns, *[match[c].alias(c) for c in added])


def left_join_keyed(left: DataFrame, right: DataFrame, keys: Sequence[str], frequent: bool = False,
                    min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """``left LEFT JOIN right USING (keys)``; see ``join_keyed``."""
    return join_keyed(left, right, keys, "left", frequent, min_rows, min_share)
