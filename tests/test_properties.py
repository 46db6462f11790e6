"""Invariants of the sampling, ranking, graph and report operators."""

import duckdb
from pyspark.sql import functions as F

from tests.conftest import MID, SMALL
from tessera.functions.hashing import uniform, uniform_sql
from tessera.operators.ranking import global_rank, prefix_sum
from tessera.operators.sampling import corrupt_label


def test_uniform_matches_sql(spark):
    ids = list(range(0, 2000, 7))
    got = {r["id"]: r["u"] for r in spark.createDataFrame([(i,) for i in ids], "id bigint")
           .select("id", uniform(42, "id").alias("u")).collect()}
    con = duckdb.connect()
    exp = dict(con.execute(f"SELECT id, {uniform_sql(42, 'id')} FROM range(0, 2000, 7) t(id)").fetchall())
    assert got == exp


def test_corrupt_label_exact_count_and_other_class(spark):
    df = spark.range(1314).select(F.col("id").alias("row_id"), (F.col("id") % 20).cast("int").alias("y"))
    out = corrupt_label(df, 0.2, seed=42)
    assert out.filter("is_noisy").count() == 262
    assert out.filter("is_noisy AND y = y_clean").count() == 0
    assert out.filter("NOT is_noisy AND y <> y_clean").count() == 0


def test_global_rank_partition_independent(spark):
    base = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") % 13).alias("v"))
    a = global_rank(base.repartition(1), ["v", "row_id"], "r", num_partitions=1)
    b = global_rank(base.repartition(8), ["v", "row_id"], "r", num_partitions=8)
    ref = base.selectExpr("row_id", "row_number() over (order by v, row_id) - 1 as r")
    assert a.select("row_id", "r").exceptAll(ref).count() == 0
    assert b.select("row_id", "r").exceptAll(ref).count() == 0


def test_prefix_sum_matches_window(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("x"))
    got = prefix_sum(df, "g", "o", "x").select("g", "o", "x_before")
    ref = df.selectExpr("g", "o", "coalesce(sum(x) over (partition by g order by o rows between unbounded preceding and 1 preceding), 0) as x_before")
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_split_three_disjoint(spark, queries):
    q, _ = queries
    s = q["split_three"](spark, MID)
    assert s.count() == s.select("o_orderkey").distinct().count()
    assert {r[0] for r in s.select("split").distinct().collect()} == {"source", "valid", "rest"}


def test_normalized_graph_symmetric(spark, queries):
    from tessera.plans import cat_graph as CG
    enc, _ = CG._encoded(spark, SMALL)
    a = CG.adjacency(enc)
    t = a.select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("wt"))
    j = a.join(t, ["doc_id", "src", "dst"], "full_outer")
    assert j.filter(F.col("w").isNull() | F.col("wt").isNull() | (F.abs(F.col("w") - F.col("wt")) > 1e-12)).count() == 0


def test_discovery_monotone_and_complete(spark, queries):
    q, _ = queries
    rows = sorted(q["discover_corrupted"](spark, MID).collect(), key=lambda r: r["b"])
    tpr = [r["tpr"] for r in rows]
    assert tpr == sorted(tpr) and tpr[-1] == 1.0 and len(rows) == 20


def test_values_in_open_interval(spark, queries):
    q, _ = queries
    v = q["value_rows"](spark, SMALL, iterations=3)
    r = v.agg(F.min("data_value").alias("lo"), F.max("data_value").alias("hi"), F.count("*").alias("n")).first()
    assert r["n"] > 0 and 0.0 < r["lo"] and r["hi"] < 1.0


def test_noise_found_better_than_random(spark, queries):
    q, _ = queries
    rows = {r["b"]: r for r in q["noise_discovery"](spark, MID).collect()}
    assert rows[4]["tpr"] > rows[4]["random"] + 0.2


def test_run_manifest_round_trip(spark):
    import json
    from tessera.sources.writers import run_dir, write_manifest
    path = run_dir(spark, "manifest-test")
    entries = {"train": "a/train", "valid": "a/valid", "test": "a/test"}
    write_manifest(spark, path, entries)
    rows = spark.read.text(path).collect()
    assert len(rows) == 1 and json.loads(rows[0]["value"]) == entries
