import pytest

from shelfwise.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    return session
