import pytest

from lodeworks.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app="tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__session__timeZone="UTC")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
