"""Streaming queries: the tables are replayed as streams of several files, to completion."""

from pyspark.sql import functions as F

from trackloom import fixtures
from trackloom.operators import rallies, tracks
from trackloom.plans import tracks as track_plans
from trackloom.plans.base import oracle, query, rounded
from trackloom.plans.labels import events
from trackloom.session import scratch_path
from trackloom.streaming import labels, segments


def as_stream(spark, df, parts, *order):
    """Write ``df`` as ``parts`` files, or one per core, by a hash of its rows: (stream that reads half of them per trigger, stored rows)."""
    path, parts = scratch_path(spark, "stream-in"), max(parts, spark.sparkContext.defaultParallelism)
    df.repartition(parts, *order).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, parts // 2)).parquet(path), spark.read.schema(df.schema).parquet(path)


def drained(spark, stream, name, mode="append"):
    """Run the stream over all its input into a table of the shared folder and read that."""
    out = scratch_path(spark, f"stream-{name}")
    stream.writeStream.format("parquet").options(**labels.stream_options(spark, name)).outputMode(mode).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_replay")
def _(spark, sf):
    """Final state per key of the streamed log; files mix the revisions of a key in any order."""
    stream, log = as_stream(spark, events(spark, sf), 4, "revision_id")
    rows = drained(spark, labels.stream_replay(stream), "replay")
    heads = rows.join(rows.select(F.col("head_id").alias("gone")).join(log.select(F.col("superseded_revision").alias("gone")), "gone", "left_semi").distinct(), F.col("head_id") == F.col("gone"), "left_anti")
    return heads.select("task", "source_id", "frame", "head_id", "head_kind", "active_id", "active_kind")


oracle("stream_replay", """SELECT h.task, h.source_id, h.frame, h.revision_id AS head_id, h.label_kind AS head_kind, a.revision_id AS active_id, a.label_kind AS active_kind FROM heads h LEFT JOIN active a USING (task, source_id, frame)""", ("heads", "active"))


@query("stream_segment")
def _(spark, sf):
    """Intervals that ended within the stream and those it leaves open; a frame's event time is its place at 30 frames a second, from 2000 on."""
    evidence = rallies.with_evidence(tracks.preprocess_tracks(track_plans.normalized(spark, sf))).withColumn(
        "ts", F.timestamp_millis((F.lit(946684800000) + F.col("frame") * 1000 / 30).cast("long")))
    path, parts = scratch_path(spark, "stream-in"), max(4, spark.sparkContext.defaultParallelism)
    evidence.repartition(parts, "frame").write.parquet(path)
    # a closing row far ahead moves the watermark past every source's end
    end = spark.read.parquet(path).agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("source_id"), F.lit(0).cast("long").alias("frame"), F.lit(0).alias("bits"), (F.col("ts") + F.expr("interval 30 days")).alias("ts"))
    end.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(evidence.schema).option("maxFilesPerTrigger", parts // 2).parquet(path)
    return drained(spark, segments.stream_segment(stream, late="1 day"), "segment")


oracle("stream_segment", """SELECT source_id, greatest(0, es) AS start_frame, ee AS end_frame, frame AS at_frame, 'ended' AS kind FROM p_sm WHERE es IS NOT NULL
    UNION ALL SELECT source_id, greatest(0, start_frame), end_frame, at_frame, 'open' FROM p_spans WHERE open_ended""", ("p_sm", "p_spans"), recursive=True)


@query("stream_activity")
def _(spark, sf):
    """Sliding activity of the event stream; all windows are out once the last watermark has passed."""
    rows = fixtures.table(spark, sf, "events").select("event_id", F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("activity"))
    last = rows.agg(F.max("ts").alias("ts"))
    # a closing event far ahead moves the watermark past every real window
    end = last.select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("source_id"), (F.col("ts") + F.expr("interval 30 days")).alias("ts"), F.lit(0.0).alias("activity"))
    path = scratch_path(spark, "activity-in")
    rows.unionByName(rows.filter("event_id % 5 = 0")).write.parquet(path)
    end.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    found = drained(spark, labels.stream_activity(stream, "6 hours", "3 hours", "2 days"), "activity")
    return rounded(found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


oracle("stream_activity", """SELECT user_id AS source_id, w AS window_start, round(avg(value), 6) + 0.0 AS activity, count(*) AS n FROM (SELECT user_id, value, unnest([b, b - INTERVAL 3 HOUR]) AS w
    FROM (SELECT *, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2000-01-01') AS b FROM events)) GROUP BY ALL""")
