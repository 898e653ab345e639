import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from larder.session import local_session

    return local_session(8)


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("LARDER_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def con(sf_dir):
    from larder.check import duck

    return duck(sf_dir)
