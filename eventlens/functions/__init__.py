from eventlens.functions.params import param, param_int, param_str, flatten
from eventlens.functions.predicates import (
    lobby_root, lobby_root_any_locale, in_section, lobby_path_variant, host_of,
    page_category, mobile_or_tablet)
from eventlens.functions.timeutil import (
    utc_date, week_monday, week_sunday, week_num_sunday, secs_between,
    micros_of_ntz, date_from_shard)
from eventlens.functions.identity import identity_key, user_type_by_session_number

__all__ = [
    "param", "param_int", "param_str", "flatten",
    "lobby_root", "lobby_root_any_locale", "in_section", "lobby_path_variant", "host_of",
    "page_category", "mobile_or_tablet",
    "utc_date", "week_monday", "week_sunday", "week_num_sunday", "secs_between",
    "micros_of_ntz", "date_from_shard",
    "identity_key", "user_type_by_session_number",
]
