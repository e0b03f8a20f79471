import pytest

from gridlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", "gridlake-tests", spark__driver__memory="6g")


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.01"
