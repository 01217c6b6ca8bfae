"""Composite analyses.  Every function takes the nested (or already flat)
event DataFrame, inclusive shard dates ``yyyyMMdd`` and named parameters, and
returns a lazy DataFrame."""

from eventlens.plans.volume import (
    lobby_volume_by_host_platform, param_inventory_in_lobby_sessions, lobby_volume_by_device,
    lobby_event_inventory, banner_combination_topk, lobby_sessions_by_url_variant,
    multi_host_exposure, identifier_coverage)
from eventlens.plans.kpi import (
    lobby_session_baseline, fast_game_start_rates, weekly_lobby_kpi, daily_lobby_kpi)
from eventlens.plans.funnel import (
    user_segmentation, lobby_funnel_weekly, carousel_friction, clicker_deposit_conversion,
    daily_trend_moving_avg)
from eventlens.plans.engagement import banner_return_vs_gameplay_weekly, lobby_bounce_rate
from eventlens.plans.pages import page_category_breakdown
from eventlens.plans.deposits import deposits_by_cohort_per_user, deposit_amount_stats_by_cohort
from eventlens.plans.followups import (
    tracking_outages, deposit_period_comparison, deposit_vs_banner_correlation)

__all__ = [
    "lobby_volume_by_host_platform", "param_inventory_in_lobby_sessions", "lobby_volume_by_device",
    "lobby_event_inventory", "banner_combination_topk", "lobby_sessions_by_url_variant",
    "multi_host_exposure", "identifier_coverage", "lobby_session_baseline", "fast_game_start_rates",
    "weekly_lobby_kpi", "daily_lobby_kpi", "user_segmentation", "lobby_funnel_weekly",
    "carousel_friction", "clicker_deposit_conversion", "daily_trend_moving_avg",
    "banner_return_vs_gameplay_weekly", "lobby_bounce_rate", "page_category_breakdown",
    "deposits_by_cohort_per_user", "deposit_amount_stats_by_cohort",
    "tracking_outages", "deposit_period_comparison", "deposit_vs_banner_correlation",
]
