import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, partitions=4, memory="6g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="corpusflow-test-")
