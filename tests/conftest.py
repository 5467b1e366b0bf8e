import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as dicts, in a stable order."""

    def collect(df):
        return sorted((r.asDict(recursive=True) for r in df.collect()), key=repr)

    return collect


@pytest.fixture
def by():
    """Rows of a frame as a dict from one column to the row."""

    def collect(df, key):
        return {r[key]: r.asDict(recursive=True) for r in df.collect()}

    return collect
