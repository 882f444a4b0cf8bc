"""Session-level helpers: checkpoint folder, chunk size, size-checked lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_CONF = "spark.trackloom.chunkFrames"
DEFAULT_CHUNK_FRAMES = 1 << 14
STORED: dict[str, list[str]] = {}  # stage folders by application, for drop_stages


def chunk_frames(spark: SparkSession) -> int:
    """Frames per chunk: the unit of work that one task holds of a source.

    Also has the session shuffle on all keys of a window or grouping. Otherwise rows that a join has dealt by source alone would
    count as dealt well enough for windows by (source, chunk), and a source would be one task after all. Generated methods longer
    than the JVM compiles (8,000 bytes) are not generated as one: they would be interpreted row by row.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForDistribution", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return int(spark.conf.get(CHUNK_CONF, str(DEFAULT_CHUNK_FRAMES)))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``.

    A machine-local folder is only acceptable when driver and executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="trackloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Cuts the lineage so that several consumers do not recompute it, survives executor loss, and keeps
    column pruning for the readers.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> int:
    """Delete the tables this session has stored and tell how many there were; results not yet written need them."""
    paths = STORED.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


def size_estimate(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(df: DataFrame, like: DataFrame, *keys: str, part: int = 16 << 20) -> DataFrame:
    """Deal the rows by ``keys`` to as many tasks as the estimated size of ``like`` asks for, so that a task's share does not grow with the input.

    Spark knows no size of rows that come from outside; these take the session's number of shuffle partitions.
    """
    spark, size = df.sparkSession, size_estimate(like)
    wanted = -(-size // part) if size < 1 << 50 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(spark.sparkContext.defaultParallelism, wanted), *keys)


def lookup(df: DataFrame, dim: DataFrame, on, how: str = "left", limit: int = 32 << 20) -> DataFrame:
    """Join a many-to-one dimension: broadcast below ``limit`` bytes, else a shuffle join whose hot partitions
    adaptive execution splits. Chunk windows above either shuffle by (source, chunk), see ``chunk_frames``."""
    return df.join(F.broadcast(dim) if size_estimate(dim) <= limit else dim, on, how)
