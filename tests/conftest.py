import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for folder in (ROOT, os.path.join(ROOT, "tests")):
    if folder not in sys.path:
        sys.path.insert(0, folder)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("pulsepress-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def _nothing_cached(request):
    """What a test has cached is not there in the next one."""
    session = request.getfixturevalue("spark") if "spark" in request.fixturenames else None
    yield
    if session:
        session.catalog.clearCache()


@pytest.fixture(scope="session")
def fx(spark):
    from pulsepress.sources.fixtures import Fixtures

    return Fixtures(spark, SMALL)


@pytest.fixture(scope="session")
def duck():
    from compare import connect

    return connect(SMALL)


@pytest.fixture
def rows(spark):
    """Make a DataFrame from a schema text and tuples."""

    def make(schema, *tuples):
        return spark.createDataFrame(list(tuples), schema)

    return make
