import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, app="tessera-tests")
    yield s


@pytest.fixture(scope="session")
def queries():
    from tessera.plans.registry import load_all
    return load_all()
