import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from formline.session import local_session  # noqa: E402
from tests.oracle import connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "tests")


@pytest.fixture(scope="session")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="session")
def folder():
    return FOLDER
