import pytest

from titleworks.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", "4", "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
