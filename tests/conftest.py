import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quillon.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    yield session("local[4]", 4, **{"spark.driver.memory": "6g"})


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
