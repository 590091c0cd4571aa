import pytest

from lexquarry.session import local_session, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")), "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
