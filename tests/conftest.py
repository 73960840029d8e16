import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from threadlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=8, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Apply a Column function to a list of values."""

    def apply(values, function, kind="string"):
        rows = [(i, x) for i, x in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, x {kind}")
        out = df.select("i", function(df["x"]).alias("y")).orderBy("i").collect()
        return [r["y"] for r in out]

    return apply
