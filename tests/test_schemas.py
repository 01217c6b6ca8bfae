"""Result columns, in order, of every analysis.

Fixed values: the column lists of the source's result sets (exported headers
where they exist, select lists otherwise)."""

import pytest

import __spark_entry__ as E

COLUMNS = {
    "lobby_volume_by_host_platform": "host,platform,sessions,users",
    "param_inventory_in_lobby_sessions": "param_key,occurrences",
    "lobby_volume_by_device": "host,brand,platform,device_category,operating_system,sessions,users",
    "lobby_event_inventory": "event_name,event_count",
    "banner_combination_topk": "brand,content_type,user_interaction,click_target,navigation_selection,idx,events",
    "lobby_sessions_by_url_variant": "host,brand,lobby_path_variant,operating_system,sessions,users",
    "lobby_session_baseline": "user_type,operating_system,lobby_sessions,gameplay_session_rate,"
                              "avg_gameplay_events_per_session,promo_click_session_rate,"
                              "avg_promo_clicks_per_session,pct_sessions_with_scroll,pct_sessions_with_search,"
                              "pct_sessions_deposit_window,pct_sessions_deposit_success,"
                              "median_time_to_first_gameplay_sec,p75_time_to_first_gameplay_sec",
    "multi_host_exposure": "distinct_hosts,identities",
    "fast_game_start_rates": "user_type,operating_system,sessions,gameplay_anytime_rate,gameplay_within_10s_rate,"
                             "gameplay_within_15s_rate,gameplay_within_30s_rate,gameplay_within_60s_rate,"
                             "promo_click_anytime_rate,promo_click_before_gameplay_rate",
    "identifier_coverage": "user_type,operating_system,lobby_sessions,pct_sessions_with_enhancedUserId,"
                           "pct_sessions_with_customer_guid,pct_sessions_with_ssguid",
    "weekly_lobby_kpi": "week_start,operating_system,user_type,sessions,gameplay_anytime_rate,"
                        "gameplay_within_15s_rate,gameplay_within_30s_rate,promo_event_rate,"
                        "promo_before_gameplay_rate,deposit_window_rate,deposit_initiated_rate,"
                        "deposit_success_rate,scroll_rate,search_rate",
    "daily_lobby_kpi": "activity_date,operating_system,user_type,sessions,gameplay_anytime_rate,"
                       "gameplay_within_15s_rate,gameplay_within_30s_rate,promo_click_rate,deposit_window_rate,"
                       "deposit_initiated_rate,deposit_success_rate",
    "user_segmentation": "user_type,total_users,pct_of_all_users",
    "lobby_funnel_weekly": "week_num,user_type,total_casino_sessions,sessions_banner_clicked,"
                           "pct_sessions_clicked_banner,sessions_gameplay_initiated,pct_sessions_gameplay,"
                           "gameplay_rate_among_banner_clickers",
    "carousel_friction": "week_num,user_type,carousel_engagement,session_count,sessions_with_gameplay,"
                         "gameplay_conversion_pct,conversion_rank",
    "clicker_deposit_conversion": "user_type,group_type,total_users,users_deposited,deposit_conversion_rate_pct",
    "daily_trend_moving_avg": "activity_date,user_type,total_casino_sessions,banner_clicks,banner_click_rate_pct,"
                              "gameplay_initiations,gameplay_rate_pct,deposits,gameplay_rate_7day_ma",
    "banner_return_vs_gameplay_weekly": "week_start,user_type,group_type,sessions,unique_users,key_metric,"
                                        "engagement_rate_pct",
    "lobby_bounce_rate": "user_type,total_sessions,unique_users,low_engagement_sessions,bounce_rate_pct,"
                         "avg_events_per_session,median_events_per_session",
    "page_category_breakdown": "page_category,unique_pages,total_page_views,unique_users_in_category,"
                               "percent_of_all_page_views",
    "deposits_by_cohort_per_user": "deposit_date,user_type,users_deposited,avg_transactions_per_user,"
                                   "avg_amount_per_user,total_revenue",
    "deposit_amount_stats_by_cohort": "deposit_date,user_type,unique_depositors,total_deposit_transactions,"
                                      "avg_deposit_amount_EUR,total_deposited_EUR,min_amount_EUR,max_amount_EUR,"
                                      "stddev_amount_EUR",
}
COLUMNS["daily_lobby_kpi_pseudo_id"] = COLUMNS["daily_lobby_kpi"]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_result_columns(spark, name):
    df = E.queries()[name](spark, "/root/testdata/sf0.001")
    assert ",".join(df.columns) == COLUMNS[name]
