"""Session rollup: lobby sessions with per-session event metrics in one scan.

The analyses first group lobby page views to (user, session), then join all
events of the scanned range back to those sessions (inner), and left-join the
result to the sessions again to compute flags.  For every non-NULL key that is
the set of all events with that (user, session); for a key with a NULL part
no event matches, so every event metric takes its "no match" value.

Here that is an aggregation over the events grouped by (user, session):
lobby attributes are aggregated over the lobby rows only, event metrics over
all rows, groups without a lobby row are dropped, and metrics of NULL-key
groups are replaced by their no-match defaults.  No join back, one scan, and
no skew from hot keys: all aggregates are algebraic, so a hot session
collapses map-side.

String attributes (e.g. ``MIN(operating_system)``) would force a
sort-based aggregation of every raw event (string buffers are not
hash-aggregatable).  They are therefore made grouping keys of a first
hash aggregation (value on lobby rows, NULL elsewhere) and reduced in a second
aggregation over the few rows per session that remain.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

NOT_KEYED = object()  # marker: metric default is NULL for NULL-key sessions

_FIRST = {"min": F.min, "max": F.max, "sum": F.sum, "count_if": F.count_if, "bool_or": F.bool_or}
_MERGE = {"min": F.min, "max": F.max, "sum": F.sum, "count_if": F.sum, "bool_or": F.bool_or}


def lobby_session_rollup(
    events: DataFrame,
    lobby: Column,
    user_col: str = "user_id",
    attrs: Mapping[str, tuple[Column, str]] | None = None,
    metrics: Mapping[str, tuple[str, Column, object]] | None = None,
    ts_col: str = "event_timestamp",
) -> DataFrame:
    """One row per (user, session) with at least one ``lobby`` row.

    ``events``  flat events with ``user_col``, ``session_id``, ``ts_col``
    ``lobby``   boolean Column marking lobby rows (NULL counts as false)
    ``attrs``   name -> (Column, "min" | "max") aggregated over lobby rows
    ``metrics`` name -> (kind, Column, default): kind is one of min, max, sum,
                count_if, bool_or, applied over all events of the session;
                default is used for a session whose key has a NULL part
                (``NOT_KEYED`` / None mean NULL)

    Output: ``user_col``, ``session_id``, ``lobby_first_ts``, attrs, metrics.
    """
    attrs = dict(attrs or {})
    metrics = dict(metrics or {})
    keys = [user_col, "session_id"]
    types = events.select(*[c.alias(n) for n, (c, _) in attrs.items()]).schema if attrs else T.StructType()
    wide = {n for n in attrs if not isinstance(types[n].dataType, (T.NumericType, T.BooleanType,
                                                                   T.DateType, T.TimestampType))}
    ts = F.col(ts_col)

    first = [F.count_if(lobby).alias("_lobby_rows"), F.min(F.when(lobby, ts)).alias("lobby_first_ts")]
    first += [_FIRST[how](F.when(lobby, c)).alias(n) for n, (c, how) in attrs.items() if n not in wide]
    first += [_FIRST[kind](c).alias(n) for n, (kind, c, _) in metrics.items()]
    group = keys + [F.when(lobby, c).alias(n) for n, (c, _) in attrs.items() if n in wide]
    rolled = events.groupBy(*group).agg(*first)
    if wide:
        second = [F.sum("_lobby_rows").alias("_lobby_rows"), F.min("lobby_first_ts").alias("lobby_first_ts")]
        second += [_MERGE[how](n).alias(n) for n, (_, how) in attrs.items()]
        second += [_MERGE[kind](n).alias(n) for n, (kind, _, _) in metrics.items()]
        rolled = rolled.groupBy(*keys).agg(*second)
    rolled = rolled.filter(F.col("_lobby_rows") > 0)

    keyed = F.col(user_col).isNotNull() & F.col("session_id").isNotNull()
    out = [F.col(user_col), F.col("session_id"), F.col("lobby_first_ts"), *[F.col(a) for a in attrs]]
    for name, (kind, _, default) in metrics.items():
        typ = rolled.schema[name].dataType
        d = F.lit(None) if default is NOT_KEYED or default is None else F.lit(default)
        val = F.col(name).cast("long") if kind == "count_if" else F.col(name)
        out.append(F.when(keyed, val).otherwise(d.cast("long" if kind == "count_if" else typ)).alias(name))
    return rolled.select(*out)
