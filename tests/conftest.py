import pytest

from listing_engine.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
                                              "spark.ui.enabled": "false", "spark.log.level": "ERROR"})
    yield s
    s.stop()
