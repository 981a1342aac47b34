import os

import pytest

from lumenfold.session import get_session

SF_SMALL = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("PYTHONPATH", ROOT)
    session = get_session("tests", 4, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
