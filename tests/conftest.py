"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from netseq.session import local_session  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "netseq-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small(request):
    """Folder of the smallest tables."""
    folder = f"{TESTDATA}/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder
