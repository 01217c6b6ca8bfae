"""Incremental runs over daily event shards as they land.

The source analyses are batch queries over closed daily shards; they hold no
watermark, event-time window or state of their own.  What a stream adds is
arrival: a new ``event_date=…`` directory appears each day.  This module
reads the shard directory as a Structured Streaming file source with the
fixed event schema, so the same Column helpers and aggregations run on each
new shard, and keeps running aggregates in Spark's state store (checkpointed
in the shared checkpoint folder, so a restarted or failed query resumes).
"""

from eventlens.streaming.shards import read_event_stream, start_event_inventory

__all__ = ["read_event_stream", "start_event_inventory"]
