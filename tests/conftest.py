import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from leafmark.session import get_session  # noqa: E402


# started here so that test modules can build columns while they are imported
SESSION = get_session(
    "tests", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"}
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
