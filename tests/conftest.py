import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from threadgauge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{"spark.sql.shuffle.partitions": "4"})
    yield session


@pytest.fixture(scope="session")
def rows():
    def collect(df, *cols):
        cols = cols or df.columns
        return sorted(tuple(r[c] for c in cols) for r in df.collect())

    return collect
