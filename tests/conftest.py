import pytest

from lociframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, memory="4g", spark__sql__maxMetadataStringLength="5000")
