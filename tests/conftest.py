import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from candlewick.session import build

    session = build(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture
def closes(spark):
    """(symbol, d, close, ...) bars from plain lists of closing prices."""
    import datetime as dt

    def make(**series):
        rows = []
        for symbol, values in series.items():
            for i, v in enumerate(values):
                day = dt.date(2024, 1, 1) + dt.timedelta(days=i)
                v = None if v is None else float(v)
                rows.append((symbol, day, v, v, v, v, 10.0, 100.0))
        schema = (
            "symbol string, d date, open double, high double, low double, close double, "
            "volume double, market_cap double"
        )
        return spark.createDataFrame(rows, schema)

    return make
