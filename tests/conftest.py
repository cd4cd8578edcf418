import pytest

from tests.session import make


@pytest.fixture(scope="session")
def spark():
    return make()
