"""Catalogue: document graphs over the cleaned corpus (whole documents after the
cleaning plan's own truncation), window 4, node ids from the clean vocabulary."""

from __future__ import annotations

import hashlib
from dataclasses import replace

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import pooling as PL
from ..operators.ranking import argmax_index
from ..session import stored
from ..tables import spread, table
from .documents import clean_document, clean_document_sql, clean_vocab, encoded_documents
from .registry import register
from .tasks import CORPUS_TOKENS_SQL, K_LANG, LANG_TASK_SQL, WORD_VECTORS_SQL, lang_task, word_vectors

WINDOW = 4
HOPS = 2
DIM = 64


def hash_weight(*name) -> float:
    """A fixed number in [-1/8, 1/8) from the md5 of its name."""
    h = int(hashlib.md5("/".join(map(str, name)).encode()).hexdigest()[:8], 16)
    return (h / 2.0 ** 31 - 1.0) / np.sqrt(DIM)


CD = clean_document_sql()
ENC_SQL = (f"{CD}, cv AS (SELECT word, CAST(row_number() OVER (ORDER BY word) AS INTEGER) AS word_id "
           f"FROM (SELECT DISTINCT word FROM cd_tokens)), "
           f"enc AS (SELECT t.doc_id, t.tpos, cv.word_id AS node FROM cd_tokens t JOIN cv ON t.word = cv.word)")
PAIRS_SQL = (f"wp AS (SELECT a.doc_id, a.node AS src, b.node AS dst FROM enc a JOIN enc b ON a.doc_id = b.doc_id "
             f"AND b.tpos BETWEEN a.tpos - {WINDOW} AND a.tpos + {WINDOW} AND b.tpos <> a.tpos)")
EDGES_SQL = "ed AS (SELECT doc_id, src, dst, CAST(count(*) AS DOUBLE) AS w FROM wp WHERE src <> dst GROUP BY 1, 2, 3)"
NORM_SQL = """nd AS (SELECT DISTINCT doc_id, node FROM enc),
aa AS (SELECT doc_id, src, dst, w FROM ed UNION ALL SELECT doc_id, node, node, 1.0 FROM nd),
dg AS (SELECT doc_id, src, sum(w) AS d FROM aa GROUP BY 1, 2),
an AS (SELECT aa.doc_id, aa.src, aa.dst, aa.w / sqrt(a.d * b.d) AS w FROM aa
       JOIN dg a ON a.doc_id = aa.doc_id AND a.src = aa.src JOIN dg b ON b.doc_id = aa.doc_id AND b.src = aa.dst)"""


def _encoded(spark, sf_dir):
    """``(sequences, vocabulary)``: node ids of every document that has a token, in order."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    cc = clean_document(docs)
    vocab = stored(clean_vocab(cc).select("word", "word_id"), "vocabulary")
    seq = encoded_documents(cc, vocab).select("doc_id", "ids").filter(F.size("ids") > 0)
    # reused by nodes, edges, degrees and features: written once, nothing stays cached
    return stored(seq, "sequences"), vocab


@register("graph_nodes", sql=f"WITH {ENC_SQL} SELECT DISTINCT doc_id, node FROM enc")
def graph_nodes(spark, sf_dir):
    return G.nodes(_encoded(spark, sf_dir)[0])


@register("graph_term_counts", sql=f"WITH {ENC_SQL} SELECT doc_id, node, count(*) AS tf FROM enc GROUP BY 1, 2")
def graph_term_counts(spark, sf_dir):
    return G.term_counts(_encoded(spark, sf_dir)[0])


@register("cooccur_join", sql=f"WITH {ENC_SQL}, {PAIRS_SQL} SELECT doc_id, src, dst, count(*) AS n FROM wp GROUP BY 1, 2, 3")
def cooccur_join(spark, sf_dir):
    """Every pair of nodes within the window, with the number of position pairs (a node
    with itself included)."""
    return G.pair_counts(_encoded(spark, sf_dir)[0], WINDOW)


def _edges_out(e):
    return e.select("doc_id", "src", "dst", F.round("w", 6).alias("w"))


_EDGES_OUT = "SELECT doc_id, src, dst, round(w, 6) AS w FROM {t}"


@register("graph_edges", sql=f"WITH {ENC_SQL}, {PAIRS_SQL}, {EDGES_SQL} " + _EDGES_OUT.format(t="ed"))
def graph_edges(spark, sf_dir):
    return _edges_out(G.edges(_encoded(spark, sf_dir)[0], WINDOW))


@register("graph_symmetric", sql=f"""WITH {ENC_SQL}, {PAIRS_SQL}, {EDGES_SQL},
sy AS (SELECT doc_id, src, dst, max(w) AS w FROM (SELECT doc_id, src, dst, w FROM ed UNION ALL
       SELECT doc_id, dst, src, w FROM ed) GROUP BY 1, 2, 3) """ + _EDGES_OUT.format(t="sy"))
def graph_symmetric(spark, sf_dir):
    return _edges_out(G.symmetric(_encoded(spark, sf_dir)[0], WINDOW))


@register("graph_normalized", sql=f"WITH {ENC_SQL}, {PAIRS_SQL}, {EDGES_SQL}, {NORM_SQL} " + _EDGES_OUT.format(t="an"))
def graph_normalized(spark, sf_dir):
    return _edges_out(adjacency(_encoded(spark, sf_dir)[0]))


def adjacency(seq):
    """Normalised adjacency of the sliding-window graph. The sliding window is
    symmetric, so max(A, A^T) = A and the symmetrisation step is the identity here
    (graph_symmetric runs it explicitly)."""
    return G.normalized_adjacency(seq, WINDOW)


def graph_inputs(spark, sf_dir):
    """Sequences and word vectors of the document graphs. Words without a vector take the vector
    of 'the'; the vectors of a word that has several are added up."""
    from .cat_vocab import fallback_vector
    seq, vocab = _encoded(spark, sf_dir)
    wv = stored(word_vectors(spark, sf_dir).select("word", "vec"), "word-vectors")
    rest = spark.range(1).select(fallback_vector(wv).cast("array<double>").alias("vec")).first()["vec"]
    vec = F.coalesce(F.col("vec").cast("array<double>"), F.array(*map(F.lit, rest)))
    vectors = (vocab.join(wv, "word").groupBy(F.col("word_id").alias("node")).agg(Summarizer.sum(array_to_vector(vec)).alias("v"))
               .select("node", vector_to_array("v").alias("vec")))
    return G.Inputs(seq, stored(vectors, "node-vectors"), np.array(rest))


_PROBE = [hash_weight("probe", i) for i in range(DIM)]
_XV_SQL = f"""xv AS (SELECT cv.word_id AS node, CAST(coalesce(wv.vec, (SELECT vec FROM wv WHERE word = 'the'),
  list_transform(range(0, {DIM}), lambda i: CAST(0.0 AS FLOAT))) AS DOUBLE[]) AS vec FROM cv LEFT JOIN wv ON cv.word = wv.word)"""


def _list_dot(vec: str, weights) -> str:
    return f"list_dot_product({vec}, [{', '.join(repr(float(x)) for x in weights)}])"


def _hops_sql(name: str, x: str, hops: int, transposed: bool = False) -> str:
    """CTEs ``{name}0`` .. ``{name}{hops}`` (doc_id, node, s) from ``x`` over the edges ``an``."""
    near, far = ("dst", "src") if transposed else ("src", "dst")
    out = f"{name}0 AS ({x})"
    for k in range(hops):
        out += (f", {name}{k + 1} AS (SELECT an.doc_id, an.{near} AS node, sum(an.w * x.s) AS s FROM an JOIN {name}{k} x "
                f"ON x.doc_id = an.doc_id AND x.node = an.{far} GROUP BY 1, 2)")
    return out


_GRAPH_SQL = f"{ENC_SQL}, {PAIRS_SQL}, {EDGES_SQL}, {NORM_SQL}, {CORPUS_TOKENS_SQL}, {WORD_VECTORS_SQL}, {_XV_SQL}"


@register("graph_propagate", sql=f"""WITH {_GRAPH_SQL},
{_hops_sql('u', 'SELECT nd.doc_id, nd.node, list_sum(xv.vec) AS s FROM nd JOIN xv ON xv.node = nd.node', HOPS)},
{_hops_sql('v', f"SELECT nd.doc_id, nd.node, {_list_dot('xv.vec', _PROBE)} AS s FROM nd JOIN xv ON xv.node = nd.node", HOPS)}
SELECT u.doc_id, u.node, round(u.s, 6) AS total, round(v.s, 6) AS probe FROM u{HOPS} u JOIN v{HOPS} v ON v.doc_id = u.doc_id AND v.node = u.node""")
def graph_propagate(spark, sf_dir):
    """Two hops of H <- A_norm H from word vectors; every node's vector, reported as its sum
    and its product with a fixed probe vector."""
    h = G.propagated(graph_inputs(spark, sf_dir), WINDOW, HOPS, np.column_stack([np.ones(DIM), _PROBE]))
    return h.select("doc_id", "node", F.round(F.col("out")[0], 6).alias("total"), F.round(F.col("out")[1], 6).alias("probe"))


def pool_parameters(dim: int = DIM):
    """Pooling parameters drawn from hashes of their names (a caller with fitted weights
    passes those instead)."""
    w = np.array([[hash_weight("W", i, j) for j in range(dim)] for i in range(dim)])
    return (w, np.array([hash_weight("b", j) for j in range(dim)]), np.array([hash_weight("a", j) for j in range(dim)]),
            hash_weight("c"))


def document_vectors(spark, sf_dir, hops: int = 1, parameters=None):
    """``(doc_id, vec)``: attention pooling of ``hops``-hop node states."""
    return G.pooled(graph_inputs(spark, sf_dir), WINDOW, [hops], *(parameters or pool_parameters())).select("doc_id", "vec")


PREDICTOR_HOPS, VALUER_HOPS = 1, 5  # of the original: one hop for the predictor, five for the valuer


def depth_vectors(spark, sf_dir, depths=(PREDICTOR_HOPS, VALUER_HOPS), parameters=None, inputs=None):
    """``(doc_id, depth, vec)``: pooled vectors of several depths from one propagation."""
    return G.pooled(inputs or graph_inputs(spark, sf_dir), WINDOW, depths, *(parameters or pool_parameters()))


def fitted_pooling(spark, sf_dir, labels, k: int, epochs: int = 30, hops: int = PREDICTOR_HOPS, inputs=None):
    """Pooling weights fitted to ``labels (doc_id, y)``: ``(net, weights, trace, vectors)``, where
    ``vectors (doc_id, vec)`` are those of all documents. Node states would be many times the
    texts: they are neither stored nor computed."""
    inputs = inputs or graph_inputs(spark, sf_dir)
    net = PL.Pooling(DIM, k)
    train = stored(spread(inputs.seq.join(labels, "doc_id"), "doc_id"), "pooling-train")
    theta, trace = PL.fit_sequences(replace(inputs, seq=train), WINDOW, hops, net, epochs)
    return net, theta, trace, G.pooled(inputs, WINDOW, [hops], *net.attention(theta)).select("doc_id", "vec")


def _labels(spark, sf_dir):
    return lang_task(spark, sf_dir).select(F.col("row_id").alias("doc_id"), "y", "split")


@register("pooling_fit")
def pooling_fit(spark, sf_dir, epochs: int = 30):
    """Attention pooling fitted to the training split: loss and accuracy of every epoch."""
    train = _labels(spark, sf_dir).filter("split = 'train'").select("doc_id", "y")
    _, _, trace, _ = fitted_pooling(spark, sf_dir, train, K_LANG, epochs)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(trace)], "epoch int, loss double, accuracy double")


@register("embed_fitted")
def embed_fitted(spark, sf_dir, epochs: int = 30):
    """Document vectors of all splits by the fitted weights, with the predicted class."""
    labels = _labels(spark, sf_dir)
    net, theta, _, v = fitted_pooling(spark, sf_dir, labels.filter("split = 'train'").select("doc_id", "y"), K_LANG, epochs)
    parts = net.parts(theta)
    scores = F.array(*[G.dot("vec", parts["V"][:, j]) + F.lit(float(parts["e"][j])) for j in range(net.k)])
    out = labels.join(v, "doc_id").withColumn("pred", argmax_index(scores))
    return out.select(F.col("doc_id").alias("row_id"), "split", "y", "pred", F.posexplode("vec").alias("dim", "v"))


def _depths_sql(depths) -> str:
    w, b, a, c = pool_parameters()
    out = ", ".join(f"{_list_dot('m', w[:, j])} + {float(b[j])!r}" for j in range(DIM))
    top = max(depths)
    parts = []
    for k in depths:
        parts.append(f"""sc{k} AS (SELECT doc_id, node, greatest(0.0, s + {float(b @ a + c)!r}) AS s FROM t{k}),
ex{k} AS (SELECT doc_id, node, exp(s - max(s) OVER (PARTITION BY doc_id)) AS s FROM sc{k}),
{_hops_sql(f'r{k}x', f'SELECT doc_id, node, s / sum(s) OVER (PARTITION BY doc_id) AS s FROM ex{k}', k, True)},
pl{k} AS (SELECT r.doc_id, generate_subscripts(xv.vec, 1) AS d, r.s * unnest(xv.vec) AS x FROM r{k}x{k} r JOIN xv ON xv.node = r.node),
pm{k} AS (SELECT doc_id, list(x ORDER BY d) AS m FROM (SELECT doc_id, d, sum(x) AS x FROM pl{k} GROUP BY 1, 2) GROUP BY doc_id),
pv{k} AS (SELECT doc_id, {k} AS depth, [{out}] AS vec FROM pm{k})""")
    return f"""{_GRAPH_SQL},
{_hops_sql('t', f"SELECT nd.doc_id, nd.node, {_list_dot('xv.vec', w @ a)} AS s FROM nd JOIN xv ON xv.node = nd.node", top)},
{', '.join(parts)}, pv AS ({' UNION ALL '.join(f'SELECT * FROM pv{k}' for k in depths)})"""


@register("graph_depths", sql=f"""WITH {_depths_sql((PREDICTOR_HOPS, VALUER_HOPS))}
SELECT doc_id, depth, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS dim, round(unnest(vec), 6) AS v FROM pv""")
def graph_depths(spark, sf_dir):
    """Pooled vectors at one and at five hops from one propagation: the predictor's and the
    valuer's inputs."""
    d = depth_vectors(spark, sf_dir)
    return d.select("doc_id", "depth", F.posexplode("vec").alias("dim", "v")).withColumn("v", F.round("v", 6))


def _pool_sql() -> str:
    w, b, a, c = pool_parameters()
    out = ", ".join(f"{_list_dot('m', w[:, j])} + {float(b[j])!r}" for j in range(DIM))
    return f"""{_GRAPH_SQL},
{_hops_sql('t', f"SELECT nd.doc_id, nd.node, {_list_dot('xv.vec', w @ a)} AS s FROM nd JOIN xv ON xv.node = nd.node", 1)},
sc AS (SELECT doc_id, node, greatest(0.0, s + {float(b @ a + c)!r}) AS s FROM t1),
ex AS (SELECT doc_id, node, exp(s - max(s) OVER (PARTITION BY doc_id)) AS s FROM sc),
{_hops_sql('r', 'SELECT doc_id, node, s / sum(s) OVER (PARTITION BY doc_id) AS s FROM ex', 1, True)},
pl AS (SELECT r.doc_id, generate_subscripts(xv.vec, 1) AS d, r.s * unnest(xv.vec) AS x FROM r1 r JOIN xv ON xv.node = r.node),
pm AS (SELECT doc_id, list(x ORDER BY d) AS m FROM (SELECT doc_id, d, sum(x) AS x FROM pl GROUP BY 1, 2) GROUP BY doc_id),
pv AS (SELECT doc_id, [{out}] AS vec FROM pm)"""


@register("graph_pool", sql=f"""WITH {_pool_sql()}
SELECT doc_id, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS dim, round(unnest(vec), 6) AS v FROM pv""")
def graph_pool(spark, sf_dir):
    """Attention pooling of one-hop node states into a document vector."""
    d = document_vectors(spark, sf_dir)
    return d.select("doc_id", F.posexplode("vec").alias("dim", "v")).withColumn("v", F.round("v", 6))


@register("embed_documents", sql=f"""WITH {_pool_sql()}, {LANG_TASK_SQL}
SELECT l.row_id, l.split, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS dim, round(unnest(vec), 6) AS v
FROM pv JOIN lang_task l ON l.row_id = pv.doc_id""")
def embed_documents(spark, sf_dir):
    """All splits in one pass: clean -> encode -> graph -> one hop -> attention pool."""
    d = document_vectors(spark, sf_dir).withColumnRenamed("doc_id", "row_id")
    out = lang_task(spark, sf_dir).select("row_id", "split").join(d, "row_id")
    return out.select("row_id", "split", F.posexplode("vec").alias("dim", "v")).withColumn("v", F.round("v", 6))
