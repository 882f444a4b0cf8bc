import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    import __spark_entry__  # noqa: F401  (registers the package for shipping)
    yield session
    session.stop()


@pytest.fixture
def small_chunks(spark):
    """Chunks of 37 frames, so that every source spans several."""
    spark.conf.set("spark.trackloom.chunkFrames", "37")
    yield
    spark.conf.unset("spark.trackloom.chunkFrames")
