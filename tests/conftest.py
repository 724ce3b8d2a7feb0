import pytest

from evidentia.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, **{"spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
