"""An iteration over a bounded batch is one task and one more job for the reward."""

import numpy as np
import pytest

from tessera.operators import valuer as VL
from tessera.plans import valuation as VA
from tests.test_valuer_loop import classes


@pytest.mark.parametrize("kind,layers", [("logistic", None), ("mlp", [3, 4, 2])])
@pytest.mark.parametrize("low", [False, True])
def test_one_task_is_all_passes(spark, kind, layers, low):
    """The same sums, selection and predictor as a pass for each epoch, also where every row is redrawn."""
    tr = VA.ValuerTrainer(classes(spark, 120), predictor=kind, layers=layers, predictor_iter=3)
    tr.prepare()
    if low:
        tr.theta = VL.flatten({**tr.params, "b4": np.array([-1e4])})  # every value is zero
    got, theta = tr._one_pass(3)
    want, trained = tr._passes(3)
    head = 3 + 2 * len(tr.theta)
    assert got[2] and np.allclose(got[:head], want[:head]) and np.allclose(theta, trained)


def test_an_iteration_takes_two_jobs(spark):
    tr = VA.ValuerTrainer(classes(spark), predictor="logistic", perf="log_loss")
    tr.prepare()
    sc = spark.sparkContext
    sc.setJobGroup("valuer-one-task", "one step")
    tr.step(0)
    jobs = sc.statusTracker().getJobIdsForGroup("valuer-one-task")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 2


def test_a_large_batch_is_cut_into_tasks(spark, monkeypatch):
    monkeypatch.setattr(VA, "ONE_TASK", 100)
    tr = VA.ValuerTrainer(classes(spark), predictor="logistic")
    monkeypatch.setattr(tr, "_one_pass", None)
    assert np.isfinite(tr.step(0)) and not tr._one_task
