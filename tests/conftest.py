import uuid

import pytest

from prepforge.session import build_session, shared_root


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", shuffle_partitions=4)


@pytest.fixture
def root(spark):
    """A fresh folder below the shared one."""
    return f"{shared_root(spark)}/test-{uuid.uuid4().hex}"
