from eventlens.operators.sessions import lobby_session_rollup, NOT_KEYED
from eventlens.operators.cohort import user_cohort, cutoff_micros
from eventlens.operators.login import first_login, first_time_label
from eventlens.operators.joins import join_keyed, left_join_keyed
from eventlens.operators.sideways import only_keys
from eventlens.operators.range_exists import exists_within, followed_within

__all__ = ["lobby_session_rollup", "NOT_KEYED", "user_cohort", "cutoff_micros", "first_login",
           "first_time_label", "join_keyed", "left_join_keyed", "exists_within", "followed_within", "only_keys"]
