"""Model training query."""

from pyspark.sql import functions as F

from trackloom.operators import features, tracks, training
from trackloom.plans import tracks as track_plans
from trackloom.plans.base import query
from trackloom.plans.features import labelled, pose_spine
from trackloom.session import materialize


@query("train_frame_classifier")
def _(spark, sf):
    """F1 per threshold of a classifier from all pose and kinematic columns to the interval labels."""
    frames, poses = pose_spine(spark, sf)
    labels = labelled(spark, sf).select("source_id", "frame", "label", F.lit(0).alias("seq"))
    rows = materialize(features.combined_features(features.pose_features(frames, poses), tracks.kinematics7(*track_plans.sampled(spark, sf)), labels), "training")
    columns = [f.name for f in rows.schema if f.dataType.typeName() == "double"]
    return training.train_frame_classifier(rows.na.fill(0.0, columns), columns)[1]
