import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pressmill.session import local_session

    session = local_session(
        "pressmill-tests",
        "4",
        **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression over one text."""
    from pyspark.sql import functions as F

    def run(expression, value, kind="string"):
        df = spark.createDataFrame([(value,)], f"v {kind}")
        return df.select(expression(F.col("v")).alias("out")).first()["out"]

    return run


@pytest.fixture
def each(spark):
    """Values of an expression over many texts, in one job."""
    from pyspark.sql import functions as F

    def run(expression, values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, v string").coalesce(1)
        rows = df.select("i", expression(F.col("v")).alias("out")).collect()
        return [r["out"] for r in sorted(rows)]

    return run
