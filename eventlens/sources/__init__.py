from eventlens.sources.events import read_events, shard_range
from eventlens.sources.deposits import read_deposits, read_deposits_by_day, write_deposits_by_day
from eventlens.sources.fixtures import fixture_events, fixture_deposits, FixtureParams
from eventlens.sources.sinks import write_csv, write_parquet
from eventlens.sources.snapshots import publish, read_snapshot

__all__ = ["read_events", "shard_range", "read_deposits", "read_deposits_by_day",
           "write_deposits_by_day", "fixture_events",
           "fixture_deposits", "FixtureParams", "write_csv", "write_parquet",
           "publish", "read_snapshot"]
