"""Local twin of the correctness gate: run a registered Spark query and its DuckDB
oracle on the same parquet tables and compare row count, column names/types and
an order-insensitive canonical form of the values.

    python -m tests.harness [--sf /root/testdata/sf0.01] [key ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb
import numpy as np
import pandas as pd

from tessera.tables import TABLES

_SPARK_TYPES = {"int": "int32", "bigint": "int64", "double": "float64", "string": "str",
                "boolean": "bool", "float": "float32", "smallint": "int16", "tinyint": "int8"}
_DUCK_TYPES = {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "float64", "VARCHAR": "str",
               "BOOLEAN": "bool", "FLOAT": "float32", "SMALLINT": "int16", "TINYINT": "int8"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (float, np.floating)):
        if math.isnan(v):
            return None
        return round(float(v), 6)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def canon(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(v) for v in rec) for rec in pdf[cols].itertuples(index=False, name=None)]
    rows.sort(key=repr)
    return cols, rows


def flat(pdf):
    """Sorted copy with plain columns (numbers rounded, the rest as text), or None if a
    column holds lists: a quick way to compare large results."""
    out = {}
    for c in sorted(pdf.columns):
        v = pdf[c]
        if pd.api.types.is_bool_dtype(v) or pd.api.types.is_integer_dtype(v):
            out[c] = v.astype(object).map(lambda x: None if x is pd.NA else int(x)) if v.hasnans else v.astype("int64")
        elif pd.api.types.is_float_dtype(v):
            out[c] = v.astype("float64").round(6) + 0.0
        else:
            if v.map(lambda x: isinstance(x, (list, tuple, np.ndarray, dict))).any():
                return None
            out[c] = v.map(lambda x: None if x is None or x is pd.NA or x is pd.NaT or x != x else str(x))
    return pd.DataFrame(out).sort_values(sorted(pdf.columns), na_position="first", ignore_index=True)


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_types = {f.name: _SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in sdf.schema.fields}
    spd = sdf.toPandas()
    t1 = time.time()
    rel = con.sql(sql)
    d_types = {n: _DUCK_TYPES.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    dpd = rel.df()
    t2 = time.time()
    if len(spd) == len(dpd) and sorted(spd.columns) == sorted(dpd.columns) and s_types == d_types:
        a, b = flat(spd), flat(dpd)
        if a is not None and b is not None and a.astype(b.dtypes.to_dict(), errors="ignore").equals(b):
            return [], len(spd), t1 - t0, t2 - t1
    sc, sr = canon(spd)
    dc, dr = canon(dpd)
    problems = []
    if sc != dc:
        problems.append(f"columns spark={sc} duck={dc}")
    if s_types != d_types:
        problems.append(f"types spark={s_types} duck={d_types}")
    if len(sr) != len(dr):
        problems.append(f"rows spark={len(sr)} duck={len(dr)}")
    elif sr != dr:
        diff = [(a, b) for a, b in zip(sr, dr, strict=True) if a != b][:3]
        problems.append(f"values differ, e.g. {diff}")
    return problems, len(sr), t1 - t0, t2 - t1


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args(argv)
    from tessera.plans.registry import load_all
    from tessera.session import build_session
    q, o = load_all()
    spark = build_session()
    con = duck(a.sf)
    keys = a.keys or list(q)
    bad = 0
    for k in keys:
        if k not in o:
            t0 = time.time()
            n = q[k](spark, a.sf).count()
            print(f"ROWS {k}: {n} rows, spark {time.time() - t0:.1f}s (no oracle)")
            continue
        try:
            problems, n, ts, td = compare(spark, con, k, q[k], o[k], a.sf)
        except Exception as e:  # noqa: BLE001
            problems, n, ts, td = [f"error {type(e).__name__}: {str(e)[:800]}"], -1, 0, 0
        status = "OK  " if not problems else "FAIL"
        bad += bool(problems)
        print(f"{status} {k}: {n} rows, spark {ts:.1f}s duck {td:.1f}s {'; '.join(problems)}")
        sys.stdout.flush()
    print(f"{len(keys) - bad}/{len(keys)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main())
