"""Shared scan step: shard pruning, then one flattening projection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from eventlens.functions.params import flatten
from eventlens.sources.events import shard_range

PAGE_VIEW = "page_view"
BANNER = "dynamic_content"
GAMEPLAY = "gameplay_initiated"
PROMO_AREA = "Promotion Area"


def scan(events: DataFrame, date_from: str, date_to: str, keys: Iterable[str],
         keep: Iterable[str]) -> DataFrame:
    return flatten(shard_range(events, date_from, date_to), keys, keep)


def session_key(user: str | Column = "user_id", session: str | Column = "session_id") -> Column:
    """``CONCAT(user, '-', CAST(session AS STRING))``: NULL when a part is NULL."""
    u = F.col(user) if isinstance(user, str) else user
    s = F.col(session) if isinstance(session, str) else session
    return F.concat(u, F.lit("-"), s.cast("string"))


def pct(num: Column, den: Column, digits: int = 2) -> Column:
    """``ROUND(100.0 * num / NULLIF(den, 0), digits)`` in DOUBLE."""
    return F.round(F.lit(100.0) * num.cast("double") / F.nullif(den, F.lit(0)).cast("double"), digits)


def flag(cond: Column) -> Column:
    """``IF(cond, 1, 0)`` (NULL counts as 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))
