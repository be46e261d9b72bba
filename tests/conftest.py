from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from millrace.operators.ordered import ROWS_SETTING  # noqa: E402
from millrace.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", "8")


@pytest.fixture
def many_ranges(spark):
    """Ranges of 7 rows, so that tiny tables are cut many times."""
    spark.conf.set(ROWS_SETTING, "7")
    yield
    spark.conf.unset(ROWS_SETTING)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")
