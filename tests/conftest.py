import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from dealerlens.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="dealerlens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck01():
    from compare import duck_connect
    from paths import SF01
    return duck_connect(SF01)
