"""Typed lookups into the repeated ``event_params`` field.

The scalar form ``(SELECT value.int_value FROM UNNEST(event_params) WHERE key=k)``
becomes ``array_position`` over the key array plus a NULL-safe ``get`` on the
value-slot array: no join, no explode, and no lambda (higher-order functions
fall back to interpreted evaluation inside generated code; these expressions
are fully code-generated).  Nested schema pruning reads only
``event_params.key`` and the one value slot used.  A key that occurs twice
yields its first entry (the scalar subquery would fail); an absent key, an
empty or a NULL array yield NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from eventlens.schema import param_slot


def param(key: str, slot: str | None = None, params: str | Column = "event_params") -> Column:
    arr = F.col(params) if isinstance(params, str) else params
    slot = slot or param_slot(key)
    pos = F.array_position(arr["key"], F.lit(key)).cast("int")   # 1-based, 0 when absent
    return F.get(arr["value"][slot], pos - F.lit(1))


def param_int(key: str, params: str | Column = "event_params") -> Column:
    return param(key, "int_value", params)


def param_str(key: str, params: str | Column = "event_params") -> Column:
    return param(key, "string_value", params)


# Canonical flat names for the parameters the analyses read.
FLAT_NAMES = {"ga_session_id": "session_id", "ga_session_number": "ga_session_number",
              "index": "idx"}


def flatten(events: DataFrame, keys: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Project the nested events to flat typed columns, once per query.

    ``keep`` lists top-level columns to carry; ``device`` becomes
    ``device_category`` and ``operating_system``.  Reading the array once and
    dropping it right after keeps later stages (shuffles, joins) narrow.
    """
    if "event_params" not in events.columns:
        # Already flattened (e.g. a materialised flat copy of the export).
        return events.select(*[c for c in keep], *[FLAT_NAMES.get(k, k) for k in keys])
    cols = []
    for c in keep:
        if c == "device_category":
            cols.append(F.col("device.category").alias("device_category"))
        elif c == "operating_system":
            cols.append(F.col("device.operating_system").alias("operating_system"))
        else:
            cols.append(F.col(c))
    for k in keys:
        cols.append(param(k).alias(FLAT_NAMES.get(k, k)))
    return events.select(*cols)
