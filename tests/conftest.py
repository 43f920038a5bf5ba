import os

import pytest

from tilewright.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tilewright-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
           "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
