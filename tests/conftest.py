import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from traceloom.session import get_session

    return get_session(8, spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def sf_dir():
    return SF
