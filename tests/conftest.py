import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tessella.session import local_session, ship_package

    session = local_session(cores=4, name="tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
