"""The driver contract in __spark_entry__.py."""

import importlib.util
import os

from tests.conftest import ROOT


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_contract(spark):
    m = _entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100
    df = m.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0
