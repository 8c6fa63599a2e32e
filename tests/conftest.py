import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import get_session

    folder = tmp_path_factory.mktemp("spark")
    session = get_session("local[4]", 4, **{"spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.driver.memory": "4g"})
    yield session
    session.stop()
