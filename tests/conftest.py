import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", "")
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ["PYTHONPATH"]


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import local_session

    s = local_session(4, partitions=4)
    yield s
    s.stop()
