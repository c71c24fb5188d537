"""One small local session for all tests."""

from __future__ import annotations

import pytest

from rankloom.runtime import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", 4, **{"spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *order):
    """Collected rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr) if not order else [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture
def collect():
    return rows
