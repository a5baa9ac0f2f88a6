import pytest

from quillstone.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "tests")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF
