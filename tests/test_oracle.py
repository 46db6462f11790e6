"""Every query that has a DuckDB oracle, on the smallest tables (``python -m tests.harness``
does the same at sf0.01)."""

import pytest

from tests.conftest import MID, SMALL
from tests.harness import compare, duck


def _keys():
    from tessera.plans.registry import load_all
    _, o = load_all()
    return sorted(o)


#: Tasks whose fixed split sizes leave no validation rows in the smallest tables.
LARGER = ("regression_", "linear_")


@pytest.fixture(scope="module")
def con():
    return {d: duck(d) for d in (SMALL, MID)}


@pytest.mark.parametrize("key", _keys())
def test_against_oracle(spark, queries, con, key):
    q, o = queries
    sf_dir = MID if key.startswith(LARGER) else SMALL
    problems, n, _, _ = compare(spark, con[sf_dir], key, q[key], o[key], sf_dir)
    assert not problems, problems
