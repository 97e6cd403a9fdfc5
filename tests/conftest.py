import pytest

from feedloom.session import local_session, reachable


@pytest.fixture(scope="session")
def spark():
    session = reachable(local_session(4, partitions=4, memory="6g"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
