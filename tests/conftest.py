import os

import pytest

from quartzbar.session import local_session

DATA = os.environ.get("QUARTZBAR_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TZ", "UTC")
    session = local_session(4, 4, **{"spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA
