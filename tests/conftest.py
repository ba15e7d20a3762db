import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from chartloom.session import build_session
    session = build_session("local[8]", 8, "8g", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Apply a column function to one text."""
    from pyspark.sql import functions as F

    def apply(fn, value):
        return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("o")).first()["o"]
    return apply
