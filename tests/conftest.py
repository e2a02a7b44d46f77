import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from panelstats.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = build_session(8, "panelstats-tests", **{
        "spark.checkpoint.dir": folder,
        "spark.sql.warehouse.dir": f"{folder}/warehouse",
        "spark.sql.shuffle.partitions": "4",
    })
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Result of a DataFrame as sorted tuples."""
    def collect(df, *cols):
        chosen = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in chosen.collect()), key=repr)
    return collect
