import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quire.session import local_session

    s = local_session(4, 2, "tests")
    s.sparkContext.setLogLevel("OFF")
    yield s


@pytest.fixture
def frame(spark):
    """frame(rows, ddl): a small DataFrame."""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)
