"""Headline timings at one scale factor; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is fully evaluated with the ``noop`` sink (no driver collect). The
document graph, the discovery table, the 40-fit removal curve, one valuer
iteration and row scoring.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans import valuation as VA  # noqa: E402
from tessera.plans.registry import load_all  # noqa: E402
from tessera.session import build_session  # noqa: E402

HEADLINE = ["clean_text", "clean_document", "word_freq", "bow", "idf", "graph_normalized",
            "discover_corrupted", "noise_discovery", "remove_high_low"]


def _run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="tessera-bench")
    queries, _ = load_all()
    times = {}
    # warm-up: JVM start and first-job overheads are not part of any query
    _run(queries["clean_str"](spark, "/root/testdata/sf0.001"))
    for k in HEADLINE:
        t0 = time.time()
        _run(queries[k](spark, sf_dir))
        times[k] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    # one REINFORCE iteration (predictor fit in the loop) and scoring of every row
    data = VA.lang_features(spark, sf_dir)
    tr = VA.ValuerTrainer(data, predictor="logistic", moving_baseline=0.9)
    t0 = time.time()
    tr.prepare()
    times["valuer_prepare"] = round(time.time() - t0, 3)
    t0 = time.time()
    tr.step(0)
    times["valuer_iteration"] = round(time.time() - t0, 3)
    t0 = time.time()
    _run(tr.values())
    times["value_rows"] = round(time.time() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
