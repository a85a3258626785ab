"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from quern.session import build_session

    session = build_session("tests", f"local[{os.environ.get('QUERN_TEST_CPUS', '4')}]", 4, **{"spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": "/tmp/quern-tests-warehouse"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
