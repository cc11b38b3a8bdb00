import pytest

from kinweave.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "8")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
