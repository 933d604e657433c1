import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from strandweave.session import build_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


@pytest.fixture
def lines(spark):
    """Numbered text lines."""
    def make(*values):
        return spark.createDataFrame(list(enumerate(values)), "line_no long, value string")

    return make
