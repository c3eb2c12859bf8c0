"""One local session for all tests."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.streaming.schemaInference", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from corpusloom.plans.shipping import ship

    ship(s)
    yield s
    s.stop()


@pytest.fixture
def rows(spark):
    """rows(schema, *tuples) -> DataFrame"""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)
