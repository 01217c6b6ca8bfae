"""Explicit schemas (never inferred) and the typed parameter registry."""

from pyspark.sql import types as T

PARAM_VALUE = T.StructType([
    T.StructField("string_value", T.StringType(), True),
    T.StructField("int_value", T.LongType(), True),
])

EVENT_PARAM = T.StructType([
    T.StructField("key", T.StringType(), True),
    T.StructField("value", PARAM_VALUE, True),
])

DEVICE = T.StructType([
    T.StructField("category", T.StringType(), True),
    T.StructField("operating_system", T.StringType(), True),
])

# Nested event export; event_date (yyyyMMdd) is the shard / partition column.
EVENTS = T.StructType([
    T.StructField("event_timestamp", T.LongType(), True),
    T.StructField("event_name", T.StringType(), True),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("user_pseudo_id", T.StringType(), True),
    T.StructField("platform", T.StringType(), True),
    T.StructField("device", DEVICE, True),
    T.StructField("event_params", T.ArrayType(EVENT_PARAM, True), True),
    T.StructField("event_date", T.StringType(), True),
])

DEPOSITS = T.StructType([
    T.StructField("player_id", T.StringType(), True),
    T.StructField("date_created", T.StringType(), True),
    T.StructField("transaction_amount_EUR", T.DoubleType(), True),
    T.StructField("payment_status", T.StringType(), True),
    T.StructField("business_unit_name", T.StringType(), True),
])

# Which value slot each known parameter key is read from.  Keys not listed
# are read as strings; a wrong slot yields NULL, never an error.
INT_PARAMS = ("ga_session_id", "ga_session_number", "index")
STRING_PARAMS = ("page_location", "brand", "content_type", "user_interaction",
                 "click_target", "navigation_selection", "enhancedUserId",
                 "customer_guid", "ssguid")


def param_slot(key: str) -> str:
    return "int_value" if key in INT_PARAMS else "string_value"

# Flat typed layout of the export (eventlens.sources.layout); event_date is
# the partition column and stays text.
FLAT_EVENTS = T.StructType([
    T.StructField("event_timestamp", T.LongType(), True),
    T.StructField("event_name", T.StringType(), True),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("user_pseudo_id", T.StringType(), True),
    T.StructField("platform", T.StringType(), True),
    T.StructField("device_category", T.StringType(), True),
    T.StructField("operating_system", T.StringType(), True),
    T.StructField("session_id", T.LongType(), True),
    T.StructField("ga_session_number", T.LongType(), True),
    T.StructField("idx", T.LongType(), True),
    *[T.StructField(k, T.StringType(), True) for k in STRING_PARAMS],
    T.StructField("event_date", T.StringType(), True),
])
