"""Page category breakdown (Q21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from eventlens.functions.predicates import page_category
from eventlens.sources.events import shard_range


def page_category_breakdown(events: DataFrame, date_from: str, date_to: str,
                            home_prefix: str) -> DataFrame:
    """Q21: unique pages, hits, users and share of hits per page category.

    Every ``page_location`` parameter entry of every event of a known user
    counts (the lateral UNNEST of the source, so a repeated key counts twice).
    The array is filtered to those entries before exploding, and hits are
    aggregated per (user, page) before the ordered LIKE rules run."""
    if "event_params" not in events.columns:
        raise ValueError("the page breakdown counts every page_location entry and needs the nested export (event_params)")
    ev = shard_range(events, date_from, date_to).filter(F.col("user_id").isNotNull())
    pls = F.filter("event_params", lambda p: (p["key"] == "page_location") & p["value"]["string_value"].isNotNull())
    ev = ev.select("user_id", F.explode(pls).alias("p")) \
           .select("user_id", F.col("p.value.string_value").alias("page_location"))
    pages = ev.groupBy("user_id", "page_location").agg(F.count(F.lit(1)).alias("count"))
    cat = pages.withColumn("page_category", page_category(home_prefix, "page_location"))
    g = cat.groupBy("page_category").agg(
        F.count_distinct("page_location").alias("unique_pages"),
        F.sum("count").cast("long").alias("total_page_views"),
        F.count_distinct("user_id").alias("unique_users_in_category"))
    total = F.sum("total_page_views").over(Window.partitionBy())
    out = g.withColumn("percent_of_all_page_views",
                       F.round(F.lit(100) * F.col("total_page_views") / total, 1))
    return out.orderBy(F.desc("total_page_views"), "page_category")
