"""URL and device predicates and classifiers over flat event columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Patterns and labels the analyses must reproduce exactly.
HOST_PATTERN = r"https?://([^/]+)/"
QUERY_TAIL = r"/?(\?.*)?\z"   # optional slash, optional query string, end of text
MOBILE_CATEGORIES = ("mobile", "tablet")

# Page category rules, first match wins, all case-sensitive LIKE patterns.
# "{home}" is replaced by the home-page prefix pattern of the site.
PAGE_RULES = (
    ("Home", ("{home}/", "{home}/tr", "{home}/en")),
    ("Live Casino", ("%/canli-casino%",)),
    ("Casino", ("%/casino%",)),
    ("Sportsbook", ("%/bahis%", "%/sportsbook%")),
    ("Live Betting", ("%/canli-bahis%",)),
    ("Virtual Sports", ("%/virtual-football%", "%/oyun-penceresi%", "%/game-iframe%")),
    ("Account", ("%/account%", "%modal:deposit%", "%modal:pending-withdrawals%")),
    ("Support", ("%/destek%", "%/support%")),
    ("Promotions", ("%/kampanyalar%", "%bonus%")),
    ("Registration", ("%/kayit-ol%",)),
    ("Login/Session", ("%/login%", "%session_expired%")),
)
OTHER_CATEGORY = "Other"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lobby_root(page_location: str | Column = "page_location", path: str = "/tr/casino") -> Column:
    """Lobby page itself: ``<path>`` with optional trailing slash and query string."""
    return _col(page_location).rlike(re.escape(path) + QUERY_TAIL)


def lobby_root_any_locale(page_location: str | Column = "page_location", locale: str = "tr",
                          section: str = "casino") -> Column:
    """Lobby page with or without the locale segment (``/(tr/)?casino``)."""
    return _col(page_location).rlike(
        "/(" + re.escape(locale) + "/)?" + re.escape(section) + QUERY_TAIL)


def in_section(page_location: str | Column = "page_location", path: str = "/tr/casino") -> Column:
    """``LIKE '%<path>/%'``: pages below the lobby, not the bare lobby URL."""
    return _col(page_location).contains(path + "/")


def lobby_path_variant(page_location: str | Column = "page_location", locale: str = "tr",
                       section: str = "casino") -> Column:
    pl = _col(page_location)
    return (F.when(lobby_root(pl, f"/{locale}/{section}"), F.lit(f"{locale}/{section}"))
            .when(lobby_root(pl, f"/{section}"), F.lit(section))
            .otherwise(F.lit("other")))


def host_of(page_location: str | Column = "page_location") -> Column:
    """Host between scheme and first slash; NULL when the URL does not match."""
    return F.nullif(F.regexp_extract(_col(page_location), HOST_PATTERN, 1), F.lit(""))


def mobile_or_tablet(category: str | Column = "device_category") -> Column:
    return _col(category).isin(*MOBILE_CATEGORIES)


def page_category(home_prefix: str, page_location: str | Column = "page_location") -> Column:
    """Ordered LIKE rules folded into one CASE expression.

    ``home_prefix`` is the LIKE pattern of the site root without the trailing
    slash, e.g. ``https://site%.com``.
    """
    pl = _col(page_location)
    expr = None
    for label, patterns in PAGE_RULES:
        cond = None
        for p in patterns:
            c = pl.like(p.replace("{home}", home_prefix))
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(OTHER_CATEGORY))
