"""Run one analysis over an event export and write the result.

    python -m eventlens <analysis> --events PATH [--deposits PATH [--deposits-by-day]] --out PATH
        [--format csv|parquet] [--versioned] [--show [ROWS]] name=value ...

``--out`` is the result; ``--show`` prints at most ROWS rows (100) and says how
many there are.  One of the two is required.

``--flat`` reads the flat typed layout written by
``eventlens.sources.layout.write_flat_events`` instead of the nested export.
``name=value`` pairs are the analysis' own parameters (see ``--help-params``),
e.g. ``date_from=20250101 date_to=20260128``; lists are comma-separated and
periods are ``label:first:last,...``.  The events path is the nested
export partitioned by ``event_date``; deposits is the payments table.
"""

from __future__ import annotations

import argparse
import inspect
import sys

from eventlens import plans
from eventlens.session import build_session, cluster_conf
from eventlens.sources import read_deposits, read_deposits_by_day, read_events, write_csv, write_parquet
from eventlens.sources.layout import read_flat_events

SKIP = {"events", "deposits"}


def _analyses():
    return {n: getattr(plans, n) for n in plans.__all__}


def _coerce(name: str, value: str, default):
    if name == "periods":          # label:first:last,label:first:last
        return tuple(tuple(part.split(":")) for part in value.split(","))
    if name == "statuses":
        return tuple(value.split(","))
    if isinstance(default, bool):
        return value.lower() in ("1", "true", "yes")
    if isinstance(default, int):
        return int(value)
    if isinstance(default, float) or (default is None and value.replace(".", "", 1).isdigit() and "." in value):
        return float(value)
    if isinstance(default, tuple):
        kind = type(default[0]) if default else str
        return tuple(kind(v) for v in value.split(",") if v)
    return value


def main(argv=None) -> int:
    fns = _analyses()
    ap = argparse.ArgumentParser(prog="python -m eventlens")
    ap.add_argument("analysis", choices=sorted(fns))
    ap.add_argument("--events", required=True)
    ap.add_argument("--flat", action="store_true", help="--events is the flat layout (sources.layout)")
    ap.add_argument("--deposits")
    ap.add_argument("--deposits-by-day", action="store_true",
                    help="--deposits is kept by day (sources.deposits.write_deposits_by_day): other days are not read")
    ap.add_argument("--out")
    ap.add_argument("--format", choices=["csv", "parquet"], default="csv")
    ap.add_argument("--versioned", action="store_true", help="publish --out as a snapshot (sources.snapshots)")
    ap.add_argument("--master")
    ap.add_argument("--cores", type=int, help="total executor cores: apply eventlens.session.cluster_conf")
    ap.add_argument("--input-gb", type=int, default=0, help="size of the scanned days, for the number of shuffle partitions")
    ap.add_argument("--show", type=int, nargs="?", const=100, help="print this many rows and the total")
    ap.add_argument("--help-params", action="store_true")
    ap.add_argument("params", nargs="*", help="name=value")
    a = ap.parse_intermixed_args(argv)
    fn = fns[a.analysis]
    sig = inspect.signature(fn)
    if a.help_params:
        for p in sig.parameters.values():
            if p.name not in SKIP:
                print(p.name, "" if p.default is inspect.Parameter.empty else f"(default {p.default!r})")
        return 0
    if not a.out and a.show is None:
        ap.error("give --out PATH, or --show to print some rows")
    spark = build_session(a.master, app=f"eventlens-{a.analysis}",
                          extra=cluster_conf(a.cores, input_bytes=a.input_gb << 30) if a.cores else None)
    kwargs = {"events": read_flat_events(spark, a.events) if a.flat else read_events(spark, a.events)}
    if "deposits" in sig.parameters:
        if not a.deposits:
            ap.error("--deposits is required for " + a.analysis)
        kwargs["deposits"] = (read_deposits_by_day if a.deposits_by_day else read_deposits)(spark, a.deposits)
    for kv in a.params:
        k, _, v = kv.partition("=")
        if k not in sig.parameters:
            ap.error(f"unknown parameter {k!r}")
        d = sig.parameters[k].default
        kwargs[k] = _coerce(k, v, None if d is inspect.Parameter.empty else d)
    df = fn(**kwargs)
    if a.out:
        (write_csv if a.format == "csv" else write_parquet)(df, a.out, versioned=a.versioned)
    if a.show is not None:
        total = df.count()
        df.show(a.show, truncate=False)
        print(f"{min(a.show, total)} of {total} rows shown")
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
