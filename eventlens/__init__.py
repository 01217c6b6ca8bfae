"""eventlens: Spark-native behaviour analytics over nested web/app event exports.

Layout
------
sources/    readers for the nested event table and the payments table, the
            fixture adapter over the driver tables, and result sinks
functions/  Column-level helpers: typed parameter lookup, URL predicates,
            UTC date and week helpers, identity key
operators/  DataFrame-level building blocks: session rollup, user cohort,
            first login, range existence, null-safe joins
plans/      the 23 composite analyses (volume, KPI, funnel, engagement,
            pages, deposits) plus the three comment-only follow-ups
streaming/  the same operators over a stream of daily event shards
"""

from eventlens.session import build_session, checkpoint_dir, cluster_conf

__all__ = ["build_session", "checkpoint_dir", "cluster_conf"]
