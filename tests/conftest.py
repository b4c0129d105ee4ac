import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from kinfold.session import local_session

    session = local_session(4, spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture
def scratch(spark):
    from kinfold.storage import Scratch

    made = Scratch(spark, "test")
    yield made
    made.clear()
