import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dayloom import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[*]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def frame(spark, pdf, schema):
    """pandas to Spark with NULL for NaN."""
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in row) for row in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


def gappy_panel(series=3, days=120, seed=1):
    """(series, day, x, y) random walks with missing values, as pandas."""
    rng = np.random.default_rng(seed)
    parts = []
    for s in range(series):
        x = 100 + np.cumsum(rng.normal(size=days))
        y = 50 + np.cumsum(rng.normal(size=days))
        x[rng.random(days) < 0.2] = np.nan
        y[rng.random(days) < 0.1] = np.nan
        parts.append(
            pd.DataFrame({"series": f"s{s}", "day": pd.date_range("2020-01-01", periods=days).date, "x": x, "y": y})
        )
    return pd.concat(parts, ignore_index=True)


def assert_close(got, want, tol=1e-9):
    got, want = np.asarray(got, dtype=float), np.asarray(want, dtype=float)
    assert got.shape == want.shape
    assert np.array_equal(np.isnan(got), np.isnan(want)), "missing values differ"
    assert np.allclose(got, want, rtol=tol, atol=tol, equal_nan=True)
