"""The row valuer: a small NumPy network evaluated inside Spark tasks.

Network (per row): [x, onehot(y)] -> dense(h) ReLU -> dense(c) ReLU -> layer norm
-> concat |onehot(y) - p_valid(x)| -> dense(c) ReLU -> dense(1) sigmoid = value.

Training is REINFORCE: for a batch, every row gets value v and a selection
s ~ Bernoulli(v) drawn from a row-keyed hash (so a re-run task draws the same s);
a predictor is fitted on the selected rows and its validation gain is the reward.
A training pass adds up, per task, two partial gradients (of sum log-likelihood and of
sum v) and what the predictor in the loop needs of the selected rows; the driver combines
them with the reward and applies Adam. Parameters are a few thousand to a few hundred
thousand floats and travel in the task closure. For regression (k = 1) the label input is
the target itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from .network import metric_parts, unit

EPS = 1e-8
LN_EPS = 1e-12
EXPLORE = 0.9      # mean value is pushed into [1 - EXPLORE, EXPLORE]
PENALTY = 1e3
REDRAWN = 10_000   # added to the iteration whose rows are drawn again

_SHAPES = ("W1", "b1", "W2", "b2", "gamma", "beta", "W3", "b3", "W4", "b4")


def init_params(d: int, k: int, hidden: int, comb: int, seed: int) -> dict:
    rng = np.random.default_rng(seed)
    s1, sc = 1.0 / np.sqrt(hidden), 1.0 / np.sqrt(comb)
    return {
        "W1": rng.uniform(-s1, s1, (d + k, hidden)), "b1": np.zeros(hidden),
        "W2": rng.uniform(-sc, sc, (hidden, comb)), "b2": np.zeros(comb),
        "gamma": np.ones(comb), "beta": np.zeros(comb),
        "W3": rng.uniform(-sc, sc, (comb + k, comb)), "b3": np.zeros(comb),
        "W4": rng.uniform(-1.0, 1.0, (comb, 1)), "b4": np.zeros(1),
    }


def flatten(p: dict) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in _SHAPES])


def unflatten(v: np.ndarray, like: dict) -> dict:
    out, i = {}, 0
    for n in _SHAPES:
        size = like[n].size
        out[n] = v[i:i + size].reshape(like[n].shape)
        i += size
    return out


def forward(p: dict, x: np.ndarray, yoh: np.ndarray, diff: np.ndarray):
    inp = np.concatenate([x, yoh], axis=1)
    z1 = inp @ p["W1"] + p["b1"]
    a1 = np.maximum(z1, 0)
    z2 = a1 @ p["W2"] + p["b2"]
    a2 = np.maximum(z2, 0)
    mu = a2.mean(axis=1, keepdims=True)
    sd = np.sqrt(a2.var(axis=1, keepdims=True) + LN_EPS)
    n2 = (a2 - mu) / sd
    ln = n2 * p["gamma"] + p["beta"]
    cat = np.concatenate([ln, diff], axis=1)
    z3 = cat @ p["W3"] + p["b3"]
    a3 = np.maximum(z3, 0)
    z4 = a3 @ p["W4"] + p["b4"]
    v = 1.0 / (1.0 + np.exp(-z4[:, 0]))
    return v, (inp, z1, a1, z2, n2, sd, cat, z3, a3)


def backward(p: dict, cache, gz4: np.ndarray) -> dict:
    inp, z1, a1, z2, n2, sd, cat, z3, a3 = cache
    g = {}
    gz4 = gz4[:, None]
    g["W4"] = a3.T @ gz4
    g["b4"] = gz4.sum(axis=0)
    gz3 = (gz4 @ p["W4"].T) * (z3 > 0)
    g["W3"] = cat.T @ gz3
    g["b3"] = gz3.sum(axis=0)
    gln = (gz3 @ p["W3"].T)[:, :n2.shape[1]]
    g["gamma"] = (gln * n2).sum(axis=0)
    g["beta"] = gln.sum(axis=0)
    gn = gln * p["gamma"]
    ga2 = (gn - gn.mean(axis=1, keepdims=True) - n2 * (gn * n2).mean(axis=1, keepdims=True)) / sd
    gz2 = ga2 * (z2 > 0)
    g["W2"] = a1.T @ gz2
    g["b2"] = gz2.sum(axis=0)
    gz1 = (gz2 @ p["W2"].T) * (z1 > 0)
    g["W1"] = inp.T @ gz1
    g["b1"] = gz1.sum(axis=0)
    return g


def row_uniform(row_id: np.ndarray, it: int, seed: int) -> np.ndarray:
    """Row-keyed uniform in [0, 1) (splitmix64 of id, iteration and seed)."""
    with np.errstate(over="ignore"):
        z = (row_id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
             + np.uint64((it * 1_000_003 + seed) & 0xFFFFFFFFFFFFFFFF))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _stack(col) -> np.ndarray:
    return np.stack(col.to_numpy()) if len(col) else np.zeros((0, 0))


def dense(i, v, d: int) -> np.ndarray:
    """Sparse rows (index arrays, value arrays) as one matrix; made per Arrow batch."""
    out = np.zeros((len(i), d))
    row = np.repeat(np.arange(len(i)), [len(x) for x in i])
    if len(row):
        out[row, np.concatenate(i.to_numpy()).astype(int)] = np.concatenate(v.to_numpy())
    return out


def pass_function(params_flat: np.ndarray, like: dict, k: int, d: int, it: int, seed: int, with_grad: bool = True):
    """mapInPandas body over (row_id, y, diff, i, v, j, n): per row (row_id, v, s), then one
    row per task (row_id=-1) with its partial gradients and, for the selected rows, the
    class counts followed by the class-term counts of the ``d`` predictor inputs."""
    p = unflatten(params_flat, like)

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            y = pdf["y"].to_numpy()
            v, cache = forward(p, dense(pdf["i"], pdf["v"], len(p["W1"]) - k), label_input(y, k), _stack(pdf["diff"]))
            ids = pdf["row_id"].to_numpy()
            s = (row_uniform(ids, it, seed) < v).astype(np.float64)
            none = [None] * len(ids)
            yield pd.DataFrame({"row_id": ids, "v": v, "s": s, "g_ll": none, "g_v": none, "stats": none})
            if with_grad:
                chosen = label_input(y, k) * s[:, None]
                part = (flatten(backward(p, cache, s - v)), flatten(backward(p, cache, v * (1 - v))),
                        np.concatenate([chosen.sum(0), (chosen.T @ dense(pdf["j"], pdf["n"], d)).ravel()]))
                total = part if total is None else tuple(a + b for a, b in zip(total, part, strict=True))
        if total is not None:
            yield pd.DataFrame({"row_id": [-1], "v": [np.nan], "s": [np.nan], "g_ll": [total[0].tolist()],
                                "g_v": [total[1].tolist()], "stats": [total[2].tolist()]})
    return run


PASS_SCHEMA = "row_id long, v double, s double, g_ll array<double>, g_v array<double>, stats array<double>"


def label_input(y: np.ndarray, k: int) -> np.ndarray:
    """One-hot classes, or the target itself when there is one output."""
    return y.astype(float)[:, None] if k == 1 else np.eye(k)[y.astype(int)]


def rows_of(i: pa.ListArray, v: pa.ListArray, d: int) -> np.ndarray:
    """Sparse Arrow rows (index lists, value lists) as one matrix."""
    out = np.zeros((len(i), d))
    size = np.diff(i.offsets.to_numpy())
    out[np.repeat(np.arange(len(i)), size), i.flatten().to_numpy()] = v.flatten().to_numpy()
    return out


def _inputs(b: pa.RecordBatch, d: int):
    """Predictor inputs and targets of a batch with the columns y, j, n."""
    return rows_of(b.column("j"), b.column("n"), d), b.column("y").to_numpy(zero_copy_only=False)


SUMS = "sums binary"


def _total(parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["sums"])


def selection_function(params_flat: np.ndarray | None, like: dict, k: int, d: int, it: int, seed: int, predictor, theta: np.ndarray,
                       with_grad: bool, half: bool = False):
    """mapInArrow body over (row_id, y, diff, i, v, j, n): one row per task with rows, summed values,
    selected rows, with ``with_grad`` both gradients of the valuer, and the predictor's sums over
    the selection. ``params_flat`` None selects every row; ``half`` selects each row with
    probability one half (when the values selected none)."""
    p = None if params_flat is None else unflatten(params_flat, like)

    def run(batches):
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            n, y = _inputs(b, d)
            parts = []
            if p is None:
                v = s = np.ones(len(y))
            else:
                size = b.column("diff").value_lengths().to_numpy()
                diff = b.column("diff").flatten().to_numpy().reshape(len(size), -1)
                ids = b.column("row_id").to_numpy()
                x = rows_of(b.column("i"), b.column("v"), len(p["W1"]) - k)
                v, cache = forward(p, x, label_input(y, k), diff)
                s = (row_uniform(ids, it, seed) < (0.5 if half else v)).astype(np.float64)
                if with_grad:
                    parts = [flatten(backward(p, cache, s - v)), flatten(backward(p, cache, v * (1 - v)))]
            on = s > 0
            t = y[on] if k == 1 else y[on].astype(int)
            part = predictor.partial(theta, unit(n[on]), n[on], t, s[on]) if on.any() else np.zeros(predictor.size())
            parts = [np.array([len(y), v.sum(), s.sum()]), *parts, part]
            total = parts if total is None else [a + c for a, c in zip(total, parts, strict=True)]
        if total is not None:
            yield _total(total)
    return run


def loop_function(params_flat: np.ndarray, like: dict, k: int, d: int, it: int, seed: int, predictor, theta: np.ndarray):
    """mapInArrow body over all rows of a batch in one task: rows, summed values, selected rows, both
    gradients of the valuer and the predictor's parameters after all its epochs from ``theta`` on.
    The same selections and steps as those of :func:`selection_function`, a pass for each epoch;
    where the values select no row, each is drawn again with probability one half."""
    p = unflatten(params_flat, like)

    def run(batches):
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        b = pa.concat_batches(some) if len(some) > 1 else some[0]
        n, y = _inputs(b, d)
        diff = b.column("diff").flatten().to_numpy().reshape(b.num_rows, -1)
        ids = b.column("row_id").to_numpy()
        v, cache = forward(p, rows_of(b.column("i"), b.column("v"), len(p["W1"]) - k), label_input(y, k), diff)
        s = (row_uniform(ids, it, seed) < v).astype(np.float64)
        if not s.any():
            s = (row_uniform(ids, it + REDRAWN, seed) < 0.5).astype(np.float64)
        head = [np.array([len(y), v.sum(), s.sum()]), flatten(backward(p, cache, s - v)), flatten(backward(p, cache, v * (1 - v)))]
        on, new, adam = s > 0, theta, Adam(predictor.rate)
        if on.any():
            n, t = n[on], y[on] if k == 1 else y[on].astype(int)
            x = unit(n)
            for _ in range(predictor.epochs):
                new = predictor.step(new, predictor.partial(new, x, n, t, s[on]), adam)
        yield _total([*head, new])
    return run


BLOCK = 4096


def in_blocks(fn):
    """The same body with its sums cut into rows ``(block, part)``."""
    def run(batches):
        for b in fn(batches):
            for r in b.column(0).to_pylist():
                x = np.frombuffer(r, np.float64)
                parts = [x[i:i + BLOCK] for i in range(0, len(x), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], names=["block", "part"])
    return run


def metric_function(predictor, theta: np.ndarray, k: int, d: int, perf: str):
    """mapInArrow body over (y, j, n): one row per task with its rows and summed metric."""
    def run(batches):
        total = np.zeros(2)
        for b in batches:
            if b.num_rows:
                n, y = _inputs(b, d)
                total += (len(y), metric_parts(perf, y if k == 1 else y.astype(int), predictor.predict(theta, unit(n), n)))
        yield _total([total])
    return run


PACKED = "size binary, y binary, j binary, v binary"
PACK_ROWS = 4096


def pack_function():
    """mapInArrow body over (y, j, n): some thousand rows as one, so that a pass over them decodes no
    lists. Inputs and values that are small whole numbers (counts) take two bytes each."""
    def small(x):
        return x.astype("<u2") if len(x) and x.min() >= 0 and x.max() < 1 << 16 and (x == np.floor(x)).all() else x.astype("<f8")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_ROWS):
                b = batch.slice(at, PACK_ROWS)
                size = b.column("j").value_lengths().to_numpy().astype(np.int64)
                j, v = small(b.column("j").flatten().to_numpy()), small(b.column("n").flatten().to_numpy())
                y = b.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (size, y, j, v)], names=["size", "y", "j", "v"])
    return run


def packed_metric_function(predictor, theta: np.ndarray, perf: str):
    """:func:`metric_function` over packed rows."""
    def run(batches):
        total = np.zeros(2)
        for b in batches:
            for size, y, j, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                size, y = np.frombuffer(size, np.int64), np.frombuffer(y, np.int64)
                j, v = (np.frombuffer(x, "<u2" if len(x) == 2 * size.sum() else "<f8") for x in (j, v))
                p = predictor.predict_sparse(theta, size, j.astype(np.int64), v.astype(float))
                total += (len(y), metric_parts(perf, y, p))
        yield _total([total])
    return run


def score_function(predictor, theta: np.ndarray, d: int):
    """mapInArrow body over (row_id, y, j, n): class probabilities of every row."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                n, _ = _inputs(b, d)
                p = predictor.predict(theta, unit(n), n)
                yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("y"), pa.array(list(p), pa.list_(pa.float64()))], names=["row_id", "y", "p"])
    return run


class Adam:
    def __init__(self, lr: float = 0.01, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8):
        self.lr, self.b1, self.b2, self.eps = lr, b1, b2, eps
        self.m = self.v = None
        self.t = 0

    def step(self, theta: np.ndarray, grad: np.ndarray) -> np.ndarray:
        if self.m is None:
            self.m, self.v = np.zeros_like(theta), np.zeros_like(theta)
        self.t += 1
        self.m = self.b1 * self.m + (1 - self.b1) * grad
        self.v = self.b2 * self.v + (1 - self.b2) * grad * grad
        mh = self.m / (1 - self.b1 ** self.t)
        vh = self.v / (1 - self.b2 ** self.t)
        return theta - self.lr * mh / (np.sqrt(vh) + self.eps)


def loss_gradient(g_ll: np.ndarray, g_v: np.ndarray, reward: float, mean_v: float, n: int) -> np.ndarray:
    """Gradient of -reward * sum log p(s|v) + PENALTY * (relu(mean v - t) + relu(1 - t - mean v))."""
    pen = PENALTY * ((1.0 if mean_v > EXPLORE else 0.0) - (1.0 if mean_v < 1 - EXPLORE else 0.0)) / max(n, 1)
    return -reward * g_ll + pen * g_v
