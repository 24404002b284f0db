import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from colloquy.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("colloquy-tests", cores=8, **{"spark.sql.shuffle.partitions": "8"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def base():
    return "/root/testdata/sf0.001"
