import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from loomwatch.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    s = get_session("tests", master="local[8]", shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()
