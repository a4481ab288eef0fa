import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tapeloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bars_of(spark):
    """Daily bars of one or more symbols from lists of closes (None = missing)."""
    import datetime as dt

    def make(**closes):
        rows = []
        for symbol, values in closes.items():
            for i, c in enumerate(values):
                c = None if c is None else float(c)
                day = dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
                rows.append((symbol, "SSE", "1d", day, c, c, c, c, 100.0, 1000.0, 0.0))
        schema = (
            "symbol string, exchange string, interval string, datetime timestamp_ntz, open double, high double, low double, "
            "close double, volume double, turnover double, open_interest double"
        )
        return spark.createDataFrame(rows, schema)

    return make
