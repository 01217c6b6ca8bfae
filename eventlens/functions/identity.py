"""Identity and user-type classifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed labels.
NEW_USER = "NEW_USER"
RETURNING_USER = "RETURNING_USER"
FIRST_TIME = "FIRST-TIME"
RETURNING = "RETURNING"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def identity_key(*ids: str | Column) -> Column:
    """First non-empty identifier: ``COALESCE(NULLIF(a,''), NULLIF(b,''), …, last)``.

    The last id is taken as is (it is never compared with '')."""
    cols = [_col(c) for c in ids]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def user_type_by_session_number(n: str | Column = "ga_session_number") -> Column:
    """Session number 1 is NEW_USER; anything else, NULL included, RETURNING_USER."""
    return F.when(_col(n) == 1, F.lit(NEW_USER)).otherwise(F.lit(RETURNING_USER))
