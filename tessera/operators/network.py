"""Predictors of the valuation loop as sums over rows.

Every predictor says what one task adds up over its rows (:meth:`partial`) and what the
driver makes of the total, so a fit costs one pass (counts, Gram matrices) or one pass per
epoch (summed gradients of a small network). Parameters and sums are flat float64 arrays whose
size follows from the number of inputs, hidden units and classes, never from the rows.

Inputs of a task: ``x`` rows scaled to unit length, ``n`` the raw rows, ``y`` targets and
``w`` row weights (the selection).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .additive import NaiveBayes


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to unit Euclidean length; an empty row stays zero."""
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Network:
    """Dense layers with ReLU between them and a softmax at the end, trained on the weighted
    mean log loss by Adam over whole-batch gradients, from ``start`` on (the fit to all rows:
    the warm start of every iteration). Without hidden layers it is logistic regression."""

    layers: list
    seed: int = 0
    rate: float = 0.1
    epochs: int = 5
    decay: float = 1e-4
    start: np.ndarray | None = field(default=None, repr=False)
    closed = False

    def initial(self) -> np.ndarray:
        """Zeros for a linear model, else uniform weights within 1 / sqrt(inputs)."""
        rng, parts = np.random.default_rng(self.seed), []
        for a, b in self._shapes():
            parts += [np.zeros(a * b) if len(self.layers) == 2 else rng.uniform(-1, 1, a * b) / np.sqrt(a), np.zeros(b)]
        return np.concatenate(parts)

    def _shapes(self):
        return list(zip(self.layers, self.layers[1:], strict=False))

    def _parts(self, theta: np.ndarray):
        at = 0
        for a, b in self._shapes():
            yield theta[at:at + a * b].reshape(a, b), theta[at + a * b:at + a * b + b]
            at += a * b + b

    def _forward(self, theta, x):
        parts, kept = list(self._parts(theta)), [x]
        for k, (w, b) in enumerate(parts):
            z = kept[-1] @ w + b
            kept.append(np.maximum(z, 0) if k < len(parts) - 1 else softmax(z))
        return parts, kept

    def predict(self, theta: np.ndarray, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self._forward(theta, x)[1][-1]

    def predict_sparse(self, theta: np.ndarray, size: np.ndarray, j: np.ndarray, v: np.ndarray) -> np.ndarray:
        """:meth:`predict` of sparse rows scaled to unit length; their ``size`` inputs ``j`` have the
        values ``v``. Few inputs are not spread over a dense matrix."""
        (w, b), *more = self._parts(theta)
        has = np.flatnonzero(size)
        start = (np.cumsum(size) - size)[has]
        length = np.ones(len(size))
        if len(has):
            length[has] = np.sqrt(np.add.reduceat(v * v, start))
        length[length == 0] = 1.0
        if len(v) * w.shape[1] >= 3 * len(size) * len(w):
            x = np.zeros((len(size), len(w)))
            x[np.repeat(np.arange(len(size)), size), j] = v
            z = x @ w
        else:
            z = np.zeros((len(size), w.shape[1]))
            for c in range(w.shape[1] if len(has) else 0):  # a column at a time: no row of numbers per input
                z[has, c] = np.add.reduceat(w[:, c].take(j) * v, start)
        z = z / length[:, None] + b
        for w, b in more:
            z = np.maximum(z, 0) @ w + b
        return softmax(z)

    def partial(self, theta: np.ndarray, x, n, y, w) -> np.ndarray:
        """Weight, loss and gradient summed over these rows."""
        parts, kept = self._forward(theta, x)
        p = kept[-1]
        own = p[np.arange(len(y)), y]
        g = p.copy()
        g[np.arange(len(y)), y] -= 1
        g *= w[:, None]
        out = []
        for k in range(len(parts) - 1, -1, -1):
            out[:0] = [(kept[k].T @ g).ravel(), g.sum(0)]
            if k:
                g = (g @ parts[k][0].T) * (kept[k] > 0)
        return np.concatenate([[w.sum(), -(w * np.log(np.maximum(own, 1e-15))).sum()], *out])

    def size(self) -> int:
        return 2 + sum(a * b + b for a, b in self._shapes())

    def step(self, theta: np.ndarray, total: np.ndarray, adam) -> np.ndarray:
        return adam.step(theta, total[2:] / max(total[0], 1.0) + self.decay * theta)


@dataclass
class CountedBayes:
    """Multinomial naive Bayes: the totals are class and class-term counts."""

    k: int
    d: int
    closed = True

    def predict(self, theta, x, n):
        return softmax(n @ theta[self.k:].reshape(self.k, self.d).T + theta[:self.k])

    def partial(self, theta, x, n, y, w):
        chosen = np.eye(self.k)[y] * w[:, None]
        return np.concatenate([chosen.sum(0), (chosen.T @ n).ravel()])

    def size(self) -> int:
        return self.k * (1 + self.d)

    def fit(self, total: np.ndarray) -> np.ndarray:
        m = NaiveBayes.of(total[None, :self.k], total[self.k:].reshape(1, self.k, self.d))
        return np.concatenate([m.prior[0], m.term[0].ravel()])


@dataclass
class Ridge:
    """Least squares with an unpenalised intercept: the totals are the Gram matrix of the inputs
    and a one, their products with the target, and the rows."""

    d: int
    penalty: float = 1.0
    closed = True

    def predict(self, theta, x, n):
        return n @ theta[:-1] + theta[-1]

    def partial(self, theta, x, n, y, w):
        a = np.column_stack([n, np.ones(len(n))])
        return np.concatenate([((a * w[:, None]).T @ a).ravel(), (a * w[:, None]).T @ y, [w.sum()]])

    def size(self) -> int:
        return (self.d + 1) ** 2 + self.d + 2

    def fit(self, total: np.ndarray) -> np.ndarray:
        return solve(*self.gram(total), self.penalty)

    def gram(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = self.d + 1
        return total[:m * m].reshape(m, m), total[m * m:m * m + m]


def solve(gram: np.ndarray, moment: np.ndarray, penalty: float) -> np.ndarray:
    """The coefficients and, last, the intercept; with no penalty the shortest solution."""
    ridge = np.diag(np.append(np.full(len(gram) - 1, float(penalty)), 0.0))
    return np.linalg.lstsq(gram + ridge, moment, rcond=None)[0]


#: What one row adds to each metric: class metrics from (y, p), regression metrics from (y, pred).
ADDITIVE = ("accuracy", "log_loss", "rmspe", "mae", "mse")


def metric_parts(perf: str, y: np.ndarray, p: np.ndarray) -> float:
    if perf == "accuracy":
        return float((p.argmax(1) == y).sum())
    if perf == "log_loss":
        return float(np.log(np.clip(p[np.arange(len(y)), y], 1e-15, 1 - 1e-15)).sum())
    d = y - p
    if perf == "rmspe":
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(d == 0, 0.0, np.where(y == 0, np.inf, d / y))
        return float((r * r).sum())
    return float(np.abs(d).sum() if perf == "mae" else (d * d).sum())


def metric_of(perf: str, total: float, rows: float) -> float:
    mean = total / rows if rows else float("nan")
    return float(np.sqrt(mean)) if perf == "rmspe" else mean
