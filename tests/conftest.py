"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from skimmer.session import get_session

    top = tmp_path_factory.mktemp("spark")
    session = get_session(
        4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(top / "warehouse"), "spark.checkpoint.dir": f"file://{top}/shared", "spark.local.dir": str(top / "local"), "spark.driver.memory": "4g"}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
