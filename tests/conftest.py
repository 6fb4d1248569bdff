import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowmill.session import drop_staged, local_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", spark__sql__shuffle__partitions="4")
    # several tasks per sort even for small tables, so slices and carries are exercised
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield session
    drop_staged(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(TESTDATA):
        pytest.skip("shared test tables are not available")
    return TESTDATA
