import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from seasonloom.session import get_session

    session = get_session("local[2]", 4, **{"spark.driver.memory": "4g", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
