import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[*]")
         .appName("textmine-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.optimizer.windowGroupLimitThreshold", "100000")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.ui.retainedExecutions", "10")  # their plans' texts take megabytes each
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    # tests only: a scratch checkpoint folder (clusters name a shared one)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textmine-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def released(request):
    """What a query has kept goes after the comparison with its twin, as one session runs them all."""
    yield
    if {"spark", "duck"} <= set(request.fixturenames):
        request.getfixturevalue("spark").catalog.clearCache()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from textmine.plans.compare import duck_views

    return duck_views(duckdb.connect(), SF_SMALL)
