"""Frame classifier on MLlib: a multilayer perceptron over per-frame features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.evaluate import threshold_sweep
from trackloom.operators.labels import seeded

HIDDEN = (128, 64, 32)


def train_frame_classifier(rows: DataFrame, features: Sequence[str], label: str = "label", fraction: float = 0.2, seed: int = 42,
                           iterations: int = 100) -> tuple[object, DataFrame]:
    """(fitted model, F1 per threshold on the held-out rows).

    Three hidden layers of 128, 64 and 32 units with a softmax output; MLlib offers no dropout. The
    held-out share is drawn by a seeded hash of (source_id, frame). Fitting is distributed: executors
    return gradient sums whose size is that of the model.
    """
    draw = F.conv(F.substring(seeded(seed, "source_id", "frame"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("held_out", draw < fraction)
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows).withColumn("target", F.col(label).cast("double"))
    network = MultilayerPerceptronClassifier(featuresCol="features", labelCol="target", layers=[len(features), *HIDDEN, 2], maxIter=iterations, seed=seed, blockSize=256)
    model = network.fit(vectors.filter("NOT held_out"))
    scored = model.transform(vectors.filter("held_out")).select(F.col("target").cast("int").alias("truth"), vector_to_array("probability")[1].alias("score"))
    return model, threshold_sweep(scored)
