import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cellshift.session import get_spark, ship

    folder = str(tmp_path_factory.mktemp("shared"))
    session = get_spark("tests", master="local[8]", shuffle_partitions=4, shared=folder)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
