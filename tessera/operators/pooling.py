"""Attention pooling of node states with fitted weights.

Node states are the word vectors after k hops over a document's normalised graph; the weights
act after the hops. There is one row of states per document (its nodes are bounded by the
cleaning plan's cut); callers may store them or have each pass compute them again. For a document with states G (nodes x d):

    g = G W + b,  u = relu(g a + c),  alpha = softmax(u),  z = sum alpha g,  p = softmax(z V + e)

A training pass runs this and its reverse inside the tasks and returns one row of summed
gradients per task; the driver applies Adam. Documents without nodes pool to b.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import graph as G
from .network import softmax
from .tokens import held_one_by_one, rounds
from .valuer import Adam


@dataclass
class Pooling:
    d: int
    k: int

    def shapes(self):
        return [("W", (self.d, self.d)), ("b", (self.d,)), ("a", (self.d,)), ("c", (1,)), ("V", (self.d, self.k)), ("e", (self.k,))]

    def initial(self, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        s = 1 / np.sqrt(self.d)
        return np.concatenate([rng.uniform(-s, s, np.prod(shape)) for _, shape in self.shapes()])

    def parts(self, theta: np.ndarray) -> dict:
        out, at = {}, 0
        for name, shape in self.shapes():
            size = int(np.prod(shape))
            out[name] = theta[at:at + size].reshape(shape)
            at += size
        return out

    def forward(self, theta: np.ndarray, states: np.ndarray, sizes: np.ndarray):
        """``(z per document, what the reverse pass needs)``; ``states`` are the nodes of all
        documents end to end, ``sizes`` the nodes of each."""
        p = self.parts(theta)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        g = states @ p["W"] + p["b"]
        u = np.maximum(g @ p["a"] + p["c"][0], 0)
        top = np.full(len(sizes), -np.inf)
        np.maximum.at(top, doc, u)
        e = np.exp(u - top[doc])
        alpha = e / np.bincount(doc, e, len(sizes))[doc]
        z = np.zeros((len(sizes), self.d))
        if len(doc):
            start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            z[doc[start]] = np.add.reduceat(alpha[:, None] * g, start)
        z[sizes == 0] = p["b"]
        return z, (p, doc, g, u, alpha)

    def gradient(self, theta: np.ndarray, states: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Documents, log loss, right ones and the gradient of the loss, summed."""
        z, (p, doc, g, u, alpha) = self.forward(theta, states, sizes)
        prob = softmax(z @ p["V"] + p["e"])
        rows = np.arange(len(y))
        loss = -np.log(np.maximum(prob[rows, y], 1e-300)).sum()
        right = (prob.argmax(1) == y).sum()
        out = prob.copy()
        out[rows, y] -= 1
        dz = out @ p["V"].T
        da = (g * dz[doc]).sum(1)                         # of alpha
        du = alpha * (da - np.bincount(doc, alpha * da, len(sizes))[doc]) * (u > 0)
        dg = alpha[:, None] * dz[doc] + du[:, None] * p["a"]
        db = dg.sum(0) + dz[sizes == 0].sum(0)
        return np.concatenate([[len(y), loss, right], (states.T @ dg).ravel(), db, g.T @ du, [du.sum()], (z.T @ out).ravel(), out.sum(0)])

    def attention(self, theta: np.ndarray) -> tuple:
        """(W, b, a, c) as :func:`tessera.operators.graph.attention_pool` takes them."""
        p = self.parts(theta)
        return p["W"], p["b"], p["a"], float(p["c"][0])


def packed_states(h: DataFrame) -> DataFrame:
    """``(doc_id, states binary)`` from node states ``(doc_id, node, vec)``: float32 rows in the
    order of the nodes."""
    each = h.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node", F.col("vec").cast("array<float>").alias("vec")))).alias("n"))

    def run(batches):
        for b in batches:
            out = [x.values.field("vec").flatten().to_numpy().astype("<f4").tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "states"])
    kind = h.schema["doc_id"].dataType.simpleString()
    return each.mapInArrow(run, f"doc_id {kind}, states binary")


PART_BYTES = 1 << 24


def _parts(batch: pa.RecordBatch):
    """The batch in slices of some 16 MB of states, or one document."""
    ends, i = np.cumsum([len(x or b"") for x in batch.column("states").to_pylist()]), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PART_BYTES, "right")))
        yield batch.slice(i, j - i)
        i = j


def _unpack(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x or b"", "<f4").reshape(-1, d) for x in column.to_pylist()]
    sizes = np.array([len(x) for x in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros((0, d))).astype(float), sizes


def pass_gradient(docs: DataFrame, net: Pooling, theta: np.ndarray) -> np.ndarray:
    """Summed loss and gradient over ``docs(states, y)``. The number of sums does not depend on
    the rows; a task returns one row, and all tasks run at once."""
    def run(batches):
        total = None
        for batch in batches:
            for b in _parts(batch):
                part = net.gradient(theta, *_unpack(b.column("states"), net.d), b.column("y").to_numpy().astype(int))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])
    return _added(docs.select("states", "y").mapInArrow(run, "sums array<double>"))


FIT_VECTORS = 1 << 21  # up to so many vectors, every task holds k + 1 numbers for each, twice
FIT_TOKENS = 1 << 16


def fit_sequences(inputs: G.Inputs, window: int, hops: int, net: Pooling, epochs: int = 30, rate: float = 0.05, seed: int = 0):
    """:func:`fit` of the states of ``inputs`` (``seq`` has a column ``y``) without computing them. All
    but the softmax is linear, so only scalars take hops, there and back; and as there are few
    classes, a word's part in the scores and in the gradient is k + 1 products of its vector with the
    weights, taken once per task and word, not per node. A state never leaves its task. More
    than ``FIT_VECTORS`` vectors: every pass computes the states in groups of vectors."""
    rows = inputs.seq.filter(F.col("y").isNotNull()).select("doc_id", "ids", "y")
    if inputs.vectors.count() > FIT_VECTORS:
        return fit(G.state_rows(replace(inputs, seq=rows), window, hops), net, epochs, rate, seed)
    groups, rest = G.vector_groups(inputs.vectors), np.asarray(inputs.rest, float)
    rows = stored(numbered(rows, groups), "pooling-nodes")  # read by every pass

    def of_theta(theta):
        def run(batches):
            total = products = None
            for batch in batches:
                for b in G.small_batches(batch, FIT_TOKENS):
                    if total is None:
                        products = projections(net, theta, groups, rest)
                        total, weights = 0, np.zeros_like(products)
                    size = b.column("word").value_lengths().to_numpy()
                    own = b.column("own").flatten().to_numpy() + np.repeat(np.cumsum(size) - size, b.column("own").value_lengths().to_numpy())
                    walk = G.Walk(b, window, own, np.repeat(np.arange(b.num_rows), size))
                    total = total + _sequence_gradient(net, theta, walk, b.column("word").flatten().to_numpy(), products, weights, hops,
                                                       b.column("y").to_numpy().astype(int))
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([_whole_gradient(net, theta, total, sums_of_vectors(weights, groups, rest))],
                                                           pa.list_(pa.float64()))], names=["sums"])
        return run
    return _descent(lambda theta: _added(rows.mapInArrow(of_theta(theta), "sums array<double>")), net, epochs, rate, seed)


def numbered(rows: DataFrame, groups) -> DataFrame:
    """``(doc_id, own, y, word)`` of ``rows (doc_id, ids, y)``: a document's nodes are numbered, ``own`` has
    the number of every token's node, ``word`` the place of every node's vector among those of
    ``groups``, end to end; where it has none, -1."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def nodes(batches):
        for b in (x for batch in batches for x in G.small_batches(batch, FIT_TOKENS)):
            ids = b.column("ids")
            row = np.repeat(np.arange(b.num_rows), ids.value_lengths().to_numpy())
            word = ids.flatten().to_numpy().astype(np.int64)
            width = int(word.max(initial=0)) + 1
            of, own = np.unique(row * width + word, return_inverse=True)
            doc = of // width
            first = np.searchsorted(doc, np.arange(b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), G.lists((own - first[row]).astype(np.int32), row, b.num_rows), b.column("y"),
                                              G.lists((of % width).astype(np.int32), doc, b.num_rows)], names=["doc_id", "own", "y", "word"])

    def run(batches):
        for b in rounds(nodes(batches), groups):
            node, before = b.column("word").flatten(), 0
            place = np.full(len(node), -1, np.int32)
            for keys, _ in held_one_by_one(groups):
                at = pc.index_in(node, value_set=keys).fill_null(-1).to_numpy()
                place[at >= 0] = at[at >= 0] + before
                before += len(keys)
            doc = np.repeat(np.arange(b.num_rows), b.column("word").value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], G.lists(place, doc, b.num_rows)], names=["doc_id", "own", "y", "word"])
    return rows.mapInArrow(run, f"doc_id {kind}, own array<int>, y int, word array<int>")


def projections(net: Pooling, theta: np.ndarray, groups, rest: np.ndarray) -> np.ndarray:
    """A row for each vector, and last ``rest``: its products with W a and with the columns of W V."""
    p = net.parts(theta)
    to = np.column_stack([p["W"] @ p["a"], p["W"] @ p["V"]])
    return np.concatenate([*[flat.reshape(-1, net.d) @ to for _, flat in held_one_by_one(groups)], (rest @ to)[None]])


def sums_of_vectors(weights: np.ndarray, groups, rest: np.ndarray) -> np.ndarray:
    """The vectors (rows as in :func:`projections`), summed by each column of ``weights``."""
    total, at = np.outer(rest, weights[-1]), 0
    for keys, flat in held_one_by_one(groups):
        total += flat.reshape(-1, len(rest)).T @ weights[at:at + len(keys)]
        at += len(keys)
    return total


def _added(sums: DataFrame) -> np.ndarray | None:
    """The sum of the tasks' rows, added up by Spark."""
    got = sums.groupBy(F.lit(0).alias("all")).agg(Summarizer.sum(array_to_vector("sums")).alias("s")).first()  # no row, no total
    return got["s"].toArray() if got else None


def _sequence_gradient(net: Pooling, theta: np.ndarray, walk: G.Walk, word: np.ndarray, products: np.ndarray, weights: np.ndarray,
                       hops: int, y: np.ndarray) -> np.ndarray:
    """What :func:`_whole_gradient` needs of :meth:`Pooling.gradient` for the states A^hops h, h the vectors
    of the nodes: g x = A^hops (h (W x)) + b x for a vector x, and sums of g over nodes are sums of
    h, weighted by A^hops of the weights; the weights of a word are added to ``weights``."""
    p, m = net.parts(theta), len(y)

    def walked(x):
        for _ in range(hops):
            x = walk.hop(x)
        return x
    u = np.maximum(walked(products[word, 0]) + p["b"] @ p["a"] + p["c"][0], 0)
    alpha = walk.shares(u, m)
    beta = walked(alpha)
    classes = [products[word, 1 + c] for c in range(net.k)]
    prob = softmax(np.column_stack([np.bincount(walk.doc, beta * x, m) for x in classes]) + p["b"] @ p["V"] + p["e"])
    rows = np.arange(m)
    loss, right = -np.log(np.maximum(prob[rows, y], 1e-300)).sum(), (prob.argmax(1) == y).sum()
    out = prob.copy()
    out[rows, y] -= 1
    da = walked(sum(out[walk.doc, c] * x for c, x in enumerate(classes))) + (out @ (p["V"].T @ p["b"]))[walk.doc]
    du = alpha * (da - np.bincount(walk.doc, alpha * da, m)[walk.doc]) * (u > 0)
    np.add.at(weights[:, 0], word, walked(du))
    for c in range(net.k):
        np.add.at(weights[:, 1 + c], word, beta * out[walk.doc, c])
    return np.concatenate([[m, loss, right, du.sum()], out.sum(0)])


def _whole_gradient(net: Pooling, theta: np.ndarray, total: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Documents, log loss, right ones and the gradient from a task's totals and ``h``, the sums of
    vectors by the weights of the scores and of the classes."""
    p, (du, out), back, own = net.parts(theta), (total[3], total[4:]), h[:, 0], h[:, 1:]
    return np.concatenate([total[:3], (own @ p["V"].T + np.outer(back, p["a"])).ravel(), p["V"] @ out + du * p["a"],
                           back @ p["W"] + du * p["b"], [du], (p["W"].T @ own + np.outer(p["b"], out)).ravel(), out])


def fit(docs: DataFrame, net: Pooling, epochs: int = 30, rate: float = 0.05, seed: int = 0) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Weights fitted to the labelled rows, and (mean loss, accuracy) before each epoch."""
    rows = docs.filter(F.col("y").isNotNull())
    return _descent(lambda theta: pass_gradient(rows, net, theta), net, epochs, rate, seed)


def _descent(gradient, net: Pooling, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, list[tuple[float, float]]]:
    theta, adam, trace = net.initial(seed), Adam(rate), []
    for _ in range(epochs):
        total = gradient(theta)
        if total is None:
            break
        n = max(total[0], 1.0)
        trace.append((total[1] / n, total[2] / n))
        theta = adam.step(theta, total[3:] / n)
    return theta, trace


def vectors(docs: DataFrame, net: Pooling, theta: np.ndarray) -> DataFrame:
    """``(doc_id, vec, p)``: pooled vectors and class probabilities of ``docs(doc_id, states)``."""
    def run(batches):
        for b in (x for batch in batches for x in _parts(batch)):
            z, (parts, *_) = net.forward(theta, *_unpack(b.column("states"), net.d))
            p = softmax(z @ parts["V"] + parts["e"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(list(x), pa.list_(pa.float64())) for x in (z, p)]], names=["doc_id", "vec", "p"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "states").mapInArrow(run, f"doc_id {kind}, vec array<double>, p array<double>")
