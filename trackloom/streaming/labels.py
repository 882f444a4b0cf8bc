"""Structured Streaming: label replay and trailing activity.

State is small, per source or per shard of label keys; a RocksDB state store and a checkpoint in the shared folder are set by
``stream_options``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.session import scratch_path

REPLAY_OUTPUT = "task string, source_id long, frame long, revision_id long, head_id long, head_kind string, active_id long, active_kind string"
REPLAY_STATE = "entries string"
REPLAY_SHARDS = 4096  # keys are dealt to this many entries of the state


def stream_options(spark: SparkSession, name: str) -> dict[str, str]:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return {"checkpointLocation": scratch_path(spark, f"stream-{name}")}


def advance_labels(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Apply the new revisions of a shard's keys, each key's in chain order; ones whose parent has not arrived wait in the state.

    The state holds per key [waiting, head, head's kind, revision below it, its kind].
    """
    import json
    entries, touched = json.loads(state.get[0]) if state.exists else {}, {}
    for pdf in batches:
        for k, r, kind, parent in zip(pdf["label_key"], pdf["revision_id"], pdf["label_kind"], pdf["superseded_revision"]):
            entry = touched.get(k)
            if entry is None:
                entry = touched[k] = entries.setdefault(k, [{}, None, None, None, None])
            if int(r) != entry[1]:
                entry[0]["" if pd.isna(parent) else parent] = [int(r), kind]
    rows = []
    for k, entry in touched.items():
        waiting, head, kind, below, below_kind = entry
        of_key = json.loads(k)
        of_key = [of_key.get(c) for c in ("task", "source_id", "frame")]
        while (place := "" if head is None else str(head)) in waiting:
            r, new_kind = waiting.pop(place)
            before, before_kind = (below, below_kind)
            below, below_kind, head, kind = head, kind, r, new_kind
            if kind != "undo":
                active = (r, kind)
            else:
                # what an undo brings back is the revision before the undone one
                active = (before, before_kind) if before is not None and before_kind != "undo" else (None, None)
            rows.append((*of_key, r, head, kind, *active))
        entry[1:] = [head, kind, below, below_kind]
    state.update((json.dumps(entries),))
    yield pd.DataFrame(rows, columns=["task", "source_id", "frame", "revision_id", "head_id", "head_kind", "active_id", "active_kind"]).astype(
        {c: "Int64" for c in ("source_id", "frame", "revision_id", "head_id", "active_id")})


def stream_replay(events: DataFrame, shards: int = REPLAY_SHARDS) -> DataFrame:
    """Head and active label of a key after each accepted revision; the last row of a key is its state now.

    Python is called once per shard of keys and trigger, not once per key; a long log's keys spread over all shards.
    """
    key = F.to_json(F.struct("task", "source_id", "frame"))
    rows = events.select(key.alias("label_key"), "revision_id", "label_kind", F.col("superseded_revision").cast("string").alias("superseded_revision"))
    return rows.withColumn("shard", F.pmod(F.xxhash64("label_key"), F.lit(shards))).groupBy("shard").applyInPandasWithState(
        advance_labels, REPLAY_OUTPUT, REPLAY_STATE, "append", GroupStateTimeout.NoTimeout)


def stream_activity(events: DataFrame, window: str = "30 minutes", slide: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sliding mean activity per source on event time; repeated and late events are dropped."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return (once.groupBy("source_id", F.window("ts", window, slide)).agg(F.avg("activity").alias("activity"), F.count(F.lit(1)).alias("n"))
                .select("source_id", F.col("window.start").alias("window_start"), "activity", "n"))
