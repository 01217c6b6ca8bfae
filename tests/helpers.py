"""Literal nested events for semantic tests."""

from __future__ import annotations

import datetime as dt

from eventlens.schema import EVENTS, INT_PARAMS

T0 = int(dt.datetime(2025, 11, 3, 12, 0, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
S = 1_000_000


def ev(user="u1", ts=T0, name="page_view", session=1, pl="https://a.example.com/tr/casino",
       category="mobile", os_="Android", platform="WEB", pseudo=None, params=None, date=None,
       raw_params=None):
    """One nested event row.  ``params`` adds/overrides keys; a value of None
    drops the key.  ``raw_params`` gives the array verbatim."""
    p = {"ga_session_id": session, "page_location": pl, "ga_session_number": 2}
    p.update(params or {})
    if raw_params is None:
        arr = [{"key": k, "value": {"string_value": None if k in INT_PARAMS else v,
                                    "int_value": v if k in INT_PARAMS else None}}
               for k, v in p.items() if v is not None]
    else:
        arr = raw_params
    day = dt.datetime.fromtimestamp(ts / 1e6, tz=dt.timezone.utc).strftime("%Y%m%d")
    return {"event_timestamp": ts, "event_name": name, "user_id": user,
            "user_pseudo_id": pseudo or f"p-{user}", "platform": platform,
            "device": {"category": category, "operating_system": os_},
            "event_params": arr, "event_date": date or day}


def events_df(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


ALL = ("19700101", "29991231")
