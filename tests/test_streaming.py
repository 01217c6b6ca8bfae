"""Streaming over daily shards gives the batch result."""

import os
import tempfile

from eventlens import plans
from eventlens.sources.fixtures import load_fixture
from eventlens.sources import read_snapshot
from eventlens.streaming import start_event_inventory
from eventlens.streaming.shards import read_event_stream

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    events, _ = load_fixture(spark, SF)
    src = events.inputFiles()[0].split("/event_date=")[0]
    ckpt = tempfile.mkdtemp(prefix="eventlens-stream-", dir=os.environ.get("EVENTLENS_SCRATCH", "/tmp"))
    q = start_event_inventory(spark, src, "20231231", "20240131", query_name="inv_test", checkpoint=ckpt)
    try:
        q.processAllAvailable()
        got = {r.event_name: r.event_count for r in spark.table("inv_test").collect()}
    finally:
        q.stop()
    want = {r.event_name: r.event_count for r in plans.lobby_event_inventory(events, "20231231", "20240131").collect()}
    assert got == want
    assert read_event_stream(spark, src).isStreaming


def test_stream_parquet_snapshot_sink(spark):
    events, _ = load_fixture(spark, SF)
    src = events.inputFiles()[0].split("/event_date=")[0]
    base = tempfile.mkdtemp(prefix="eventlens-stream-", dir=os.environ.get("EVENTLENS_SCRATCH", "/tmp"))
    q = start_event_inventory(spark, src, "20231231", "20240131", query_name="inv_snap",
                              checkpoint=base + "/ckpt", sink=base + "/out")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.event_name: r.event_count for r in read_snapshot(spark, base + "/out").collect()}
    want = {r.event_name: r.event_count for r in plans.lobby_event_inventory(events, "20231231", "20240131").collect()}
    assert got == want
