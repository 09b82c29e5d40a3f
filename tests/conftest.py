import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from loomspark.session import local_session

    s = local_session("8", 8)
    yield s
    s.stop()
