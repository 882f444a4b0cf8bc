"""Deterministic operator inputs derived from the star-schema tables (see FIXTURES.md §2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.chunks import numbered
from trackloom.session import materialize

# primes, so that no scaled coordinate lies on a rounding tie
WIDTH, HEIGHT, FPS = 641, 359, 30.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple, DataFrame] = {}


def _supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items numbered from 0 per supplier; the month of the ship date is the sort bucket (one day rarely holds two of a supplier).

    Written once per application: nearly every input is a projection of these rows.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        # the rows take a few bytes each in their files and a hundred times that in some inputs: a task reads less than the usual 128 MB of them
        spark.conf.set("spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes", "16m"))
        rows = table(spark, sf_dir, "lineitem").select(
            F.col("l_suppkey").alias("source_id"), "l_shipdate", "l_orderkey", "l_linenumber",
            F.col("l_partkey").alias("pk"), F.col("l_quantity").cast("int").alias("q"),
            F.round(F.col("l_discount") * 100).cast("int").alias("d"))
        rows = numbered(rows, ["source_id"], F.trunc("l_shipdate", "month"), ["l_shipdate", "l_orderkey", "l_linenumber", "pk"], "rn1")
        _STORED[key] = materialize(rows.select("source_id", (F.col("rn1") - 1).alias("rn"), "pk", "q", "d"), "rows")
    return _STORED[key]


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.col("rn")
    seen = ((frame + F.col("source_id") * 13) % 200 < 120) & (F.col("q") > 3)
    rows = _supplier_rows(spark, sf_dir).withColumn("visibility", F.when(seen, 1).otherwise(0))
    hidden = F.col("visibility") == 0
    return rows.select(
        "source_id", frame.alias("frame"), "visibility",
        F.when(hidden, 0).when(F.col("q") == 50, 620)
         .otherwise(100 + (frame * 11) % 400 + F.col("pk") % 5).cast("long").alias("raw_x"),
        F.when(hidden, 0).otherwise(80 + (frame * 7) % 240 + F.col("pk") % 3).cast("long").alias("raw_y"),
        ((46 + 5 * F.col("d")).cast("double") / F.lit(100.0)).alias("peak_value"))


def person_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.col("rn")
    rows = _supplier_rows(spark, sf_dir).withColumn("frame", F.floor(rn / 4).cast("long"))
    slot = rn % 4
    return rows.select(
        "source_id", "frame",
        (slot * 10 + F.when(F.col("frame") % 90 < 50, 1).otherwise(2)).alias("track_id"),
        (F.when(slot == 2, F.lit(300)).otherwise(F.col("pk") % 100 - 50).cast("double") / 100).alias("foot_x"),
        ((F.when(slot == 1, 335).otherwise(-335) + F.col("q") % 20).cast("double") / 100).alias("foot_y"),
        ((50 + F.col("q") % 50).cast("double") / 100).alias("confidence"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0..3 detections per frame; small quantities leave gaps."""
    rows = _supplier_rows(spark, sf_dir)
    frame, cand = F.floor(F.col("rn") / 3).cast("long"), F.col("rn") % 3
    return rows.filter("q > 15").select(
        "source_id", frame.alias("frame"), cand.alias("cand"),
        F.when(cand == 0, 50 + (frame * 6) % 500 + F.col("pk") % 4).otherwise(F.col("pk") % 640).alias("cx"),
        F.when(cand == 0, 60 + (frame * 4) % 200).otherwise((F.col("pk") * 7) % 360).alias("cy"),
        ((51 + (F.col("q") * 7 + F.col("pk")) % 49).cast("double") / 100).alias("peak"),
        (1 + F.col("pk") % 9).alias("area"))


def label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision chains per (user, event_id mod 8); the event's day is the sort bucket."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("revision_id"), F.col("user_id").alias("source_id"),
        (F.col("event_id") % 8).alias("frame"), "event_type", "ts",
        F.to_date("ts").alias("day"))
    key = ["source_id", "frame"]
    last = rows.groupBy(*key, "day").agg(F.max_by("revision_id", F.struct("ts", "revision_id")).alias("day_last"))
    last = last.select(*key, "day", F.lag("day_last").over(Window.partitionBy(*key).orderBy("day")).alias("carried"))
    inside = Window.partitionBy(*key, "day").orderBy("ts", "revision_id")
    rows = rows.join(last, [*key, "day"]).withColumn(
        "superseded_revision", F.coalesce(F.lag("revision_id").over(inside), F.col("carried")))
    kind = (F.when((F.col("event_type") == "error") & F.col("superseded_revision").isNotNull(), "undo")
             .when(F.col("event_type") == "signup", "no_shuttle").when(F.col("event_type") == "click", "selected")
             .when(F.col("event_type") == "view", "missing_proposal").otherwise("unsure"))
    return rows.select("revision_id", "source_id", "frame", "ts", "superseded_revision", kind.alias("label_kind"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and labelled intervals, disjoint within a (side, source)."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("k"), "o_orderdate",
        F.floor("o_totalprice").cast("long").alias("p"))
    rows = numbered(rows, ["source_id"], F.col("o_orderdate"), ["k"], "n")
    k, p, n = F.col("k"), F.col("p"), F.col("n")
    start = n * 100 + k % 30
    pred = rows.filter(k % 11 != 0).select(
        F.lit("pred").alias("side"), "source_id", k.alias("rally_id"),
        start.alias("start_frame"), (start + 20 + p % 40).alias("end_frame"))
    label = rows.filter(k % 7 != 0).select(
        F.lit("label").alias("side"), "source_id", k.alias("rally_id"),
        (start + k % 17 - 8).alias("start_frame"), (n * 100 + k % 30 + 20 + (p * 3) % 40).alias("end_frame"))
    return pred.unionByName(label)


def sources(frames: DataFrame, fps: float = FPS) -> DataFrame:
    """Source registrations implied by a per-frame table: frame_count, fps and image size."""
    return frames.groupBy("source_id").agg((F.max("frame") + 1).alias("frame_count")).select(
        "source_id", "frame_count", F.lit(fps).alias("fps"),
        F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One perspective matrix per supplier, shifted a little from source to source."""
    shift = F.lit(-3.2) - (F.col("s_suppkey") % 5).cast("double") / 100.0
    matrix = [F.lit(0.01), F.lit(0.001), shift, F.lit(0.0005), F.lit(0.02), F.lit(-3.6),
              F.lit(0.00001), F.lit(0.0003), F.lit(1.0)]
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("source_id"), *[m.alias(f"h{i}") for i, m in enumerate(matrix)],
        F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def player_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-frame activity and feet of the two player slots, in pixels."""
    q, pk = F.col("q"), F.col("pk")
    return _supplier_rows(spark, sf_dir).select(
        "source_id", F.col("rn").alias("frame"),
        (q % 5 != 0).cast("double").alias("player1_valid"), (F.col("d") != 3).cast("double").alias("player2_valid"),
        (pk % 640).cast("double").alias("player1_foot_x"), ((q * 7) % 180).cast("double").alias("player1_foot_y"),
        ((pk * 3) % 640).cast("double").alias("player2_foot_x"), (180 + (q * 5) % 180).cast("double").alias("player2_foot_y"),
        ((q % 20).cast("double") / 47.0).alias("player1_activity"), ((pk % 20).cast("double") / 47.0).alias("player2_activity"),
        (((q % 20) + (pk % 20)).cast("double") / 47.0).alias("player_activity"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 keypoints per embedding; source = label, frame = rank of vec_id; every sixth pose is empty."""
    rows = numbered(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("source_id"), "embedding"),
                    ["source_id"], F.floor(F.col("vec_id") / 4096), ["vec_id"], "n")
    value = lambda i: F.element_at("embedding", i).cast("double")
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.struct(
        j.cast("string").alias("key"), F.struct(
            value(2 * j + 1).alias("x"), value(2 * j + 2).alias("y"),
            (((F.col("vec_id") * 7 + j * 3) % 10).cast("double") / 10.0).alias("visibility")).alias("value")))
    empty = F.expr("cast(map() as map<string, struct<x: double, y: double, visibility: double>>)")
    return rows.select("source_id", (F.col("n") - 1).alias("frame"),
                       F.when(F.col("vec_id") % 6 == 0, empty).otherwise(F.map_from_entries(points)).alias("keypoints"))
