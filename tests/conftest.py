import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def series_of(spark):
    def make(rows):
        """rows: (id, label, values)"""
        kind = "string" if isinstance(rows[0][1], str) else "int"
        return spark.createDataFrame([(i, y, [float(x) for x in v]) for i, y, v in rows],
                                     f"series_id long, label {kind}, values array<double>")
    return make


@pytest.fixture
def shapelets_of(spark):
    def make(lists):
        return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(lists)],
                                     "shapelet_id long, values array<double>")
    return make
