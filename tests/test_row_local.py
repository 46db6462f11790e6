"""Work on a document's own tokens stays in its row: nothing per token is shuffled."""

from collections import Counter

import pytest

from tessera.functions import text as T
from tessera.operators import tokens as TK
from tessera.plans import cat_text


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[-1].count("Exchange")


@pytest.mark.parametrize("kinds", [((1, 0), (2, 0)), ((2, 1),)])
def test_grams_are_counted_in_their_row(spark, monkeypatch, kinds):
    monkeypatch.setattr(TK, "PART_ITEMS", 7)
    lists = {n: T.ngrams("t", n, "_", skip) for n, skip in kinds}
    rows = [(1, "aa bb aa bb aa"), (2, ""), (3, None), (4, "cc"), (5, "dd ee dd ff ee dd")]
    once = cat_text._gram_counts(spark.createDataFrame(rows, "doc_id long, text string"), lists)
    assert exchanges(once) == 0
    got = {(r.doc_id, r.n, r.gram): r.cnt for r in once.collect()}
    if 1 in lists:
        assert got[1, 2, "aa_bb"] == 2 and got[1, 1, "aa"] == 3 and got[4, 2, "cc"] == 1
    assert {d for d, _, _ in got} == {1, 4, 5}
    # rows that share an id, or have none, are counted together
    rows = [(1, "aa bb"), (1, "aa bb"), (None, "aa bb"), (None, "bb"), (2, "aa bb")]
    got = Counter()
    for r in cat_text._gram_counts(spark.createDataFrame(rows, "doc_id long, text string"), {1: T.ngrams("t", 1)}).collect():
        assert (r.doc_id, r.gram) not in got
        got[r.doc_id, r.gram] = r.cnt
    assert got == {(1, "aa"): 2, (1, "bb"): 2, (None, "aa"): 1, (None, "bb"): 2, (2, "aa"): 1, (2, "bb"): 1}


def plain_clean(rows, min_freq, top, max_words, stop):
    """Kept tokens (doc, sent, pos, word) and sentence rows (doc, sent, n), token by token."""
    toks = [(d, i, j, w) for d, text in rows for i, s in enumerate(text.split(". ")) for j, w in enumerate(s.replace(".", " .").split())]
    freq = Counter(w for *_, w in toks)
    bar = sorted(freq.values(), reverse=True)[:top][-1]
    kept = sorted(t for t in toks if min_freq <= freq[t[3]] < bar and t[3] not in stop)
    counts, tokens, sents = Counter((d, i) for d, i, *_ in kept), [], []
    for t in kept:
        if sum(n for (d, i), n in counts.items() if d == t[0] and i < t[1]) <= max_words:
            tokens.append(t)
    every = sorted((d, i) for d, text in rows for i, _ in enumerate(text.split(". ")))
    for k, (d, i) in enumerate(every):
        if sum(counts[x] for x in every[:k] if x[0] == d) <= max_words:
            sents.append((d, i, counts[d, i]))
    return tokens, sents


def test_the_cleaning_plan_moves_no_token(spark, monkeypatch):
    from tessera.functions import rules as R
    from tessera.plans import documents as D
    monkeypatch.setattr(TK, "LOOKUP_ROWS", 5)  # several passes over the vocabulary
    words = [f"word{i}" for i in range(23)]
    def text(k):
        return ". ".join(" ".join(words[(k * i + j * j) % 23] for j in range(1 + (i + k) % 5)) for i in range(k))
    rows = [(k, text(k)) for k in range(1, 14)] + [(7, text(7)), (7, text(7)), (9, text(4))]
    monkeypatch.setattr(D, "spread", lambda d, key: d)
    cc = D.clean_document(spark.createDataFrame(rows, "doc_id long, text string"), min_freq=3, top=3, max_words=6)
    tokens, sents = plain_clean(rows, 3, 3, 6, set(R.ENGLISH_STOP_WORDS))
    assert tokens and sorted((r.doc_id, r.sent, r.pos, r.word) for r in cc.tokens.collect()) == sorted(tokens)
    assert sorted((r.doc_id, r.sent, r.n_kept) for r in cc.sent_counts.collect()) == sorted(sents)
    assert exchanges(cc.tokens) == exchanges(cc.sent_counts) == exchanges(cc.raw_tokens) == 0
    vocab = D.clean_vocab(cc)
    assert [r.word for r in vocab.orderBy("word_id").collect()] == sorted({t[3] for t in tokens})
    enc = D.encoded_documents(cc, vocab)
    assert exchanges(enc) == 0
    lists = {r.doc_id: r.ids for r in TK.nested_lists(enc).collect()}
    assert [len(x) for x in lists[5]] == [n for d, i, n in sorted(sents) if d == 5 and n]


def test_edges_are_counted_in_their_row(spark, monkeypatch):
    from tessera.operators import graph as G
    monkeypatch.setattr(G, "PART_TOKENS", 9)
    seqs = [(1, [3, 4, 3, 5, 3]), (2, [7]), (3, [2, 2, 9, 2]), (4, [])]
    seq = spark.createDataFrame(seqs, "doc_id long, ids array<int>")
    want = Counter((d, x, y) for d, s in seqs for i, x in enumerate(s) for j, y in enumerate(s) if i != j and abs(i - j) <= 2)
    assert exchanges(G.pair_counts(seq, 2)) == exchanges(G.symmetric(seq, 2)) == exchanges(G.term_counts(seq)) == 0
    assert {(r.doc_id, r.src, r.dst): r.n for r in G.pair_counts(seq, 2).collect()} == want
    want = {k: n for k, n in want.items() if k[1] != k[2]}
    for e in (G.edges(seq, 2), G.symmetric(seq, 2)):
        assert {(r.doc_id, r.src, r.dst): r.w for r in e.collect()} == want
    assert {(r.doc_id, r.node): r.tf for r in G.term_counts(seq).collect()} == Counter((d, x) for d, s in seqs for x in s)


def test_states_and_pooled_vectors_of_sequences(spark, monkeypatch):
    """The same as the operators on edge and feature tables, over several groups of vectors."""
    import numpy as np

    from tessera.operators import graph as G
    from tessera.operators import pooling as PL
    monkeypatch.setattr(G, "VECTOR_ROWS", 2)
    monkeypatch.setattr(G, "STATE_TOKENS", 11)
    monkeypatch.setattr(G, "PART_TOKENS", 17)
    monkeypatch.setattr(TK, "LOOKUP_ROWS", 3)
    rng = np.random.default_rng(5)
    seqs = [(d, [int(x) for x in rng.integers(0, 9, rng.integers(1, 14))]) for d in range(20)]
    seq = spark.createDataFrame(seqs, "doc_id long, ids array<int>")
    rest, vec = rng.normal(size=4), {n: rng.normal(size=4).astype("f4").tolist() for n in (0, 1, 3, 4, 6)}
    vectors = spark.createDataFrame(list(vec.items()), "node int, vec array<float>")
    h = spark.createDataFrame([(n, [float(x) for x in vec.get(n, rest)]) for n in range(9)], "node int, vec array<double>")
    inputs = G.Inputs(seq, vectors, rest)
    adj, h = G.normalized_adjacency(seq, 2), G.nodes(seq).join(h, "node")
    probes = rng.normal(size=(4, 3))
    want = {(r.doc_id, r.node): np.array(r.vec) @ probes for r in G.propagate(adj, h, 2).collect()}
    rows = G.propagated(inputs, 2, 2, probes)
    assert exchanges(rows) == 0
    got = {(r.doc_id, r.node): r.out for r in rows.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    want = {r.doc_id: np.frombuffer(r.states, "<f4") for r in PL.packed_states(G.propagate(adj, h, 1)).collect()}
    got = {r.doc_id: np.frombuffer(r.states, "<f4") for r in G.state_rows(inputs, 2, 1).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-5) for k in want)
    net = (rng.normal(size=(4, 4)), rng.normal(size=4), rng.normal(size=4), 0.1)
    want = {(r.doc_id, r.depth): r.vec for r in G.attention_pool_depths(adj, h, [0, 1, 3], *net).collect()}
    rows = G.pooled(inputs, 2, [0, 1, 3], *net)
    assert exchanges(rows) == 0
    got = {(r.doc_id, r.depth): r.vec for r in rows.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_repeated_and_missing_vectors_of_a_word(spark, monkeypatch):
    """A word whose embedding comes twice counts both; a null one is that of 'the'."""
    import numpy as np

    from tessera.plans import cat_graph as CG
    seq = spark.createDataFrame([(1, [1, 2, 3])], "doc_id long, ids array<int>")
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("the", 3)], "word string, word_id int")
    wv = spark.createDataFrame([("a", [1.0] * 64), ("a", [1.0] * 64), ("b", None), ("the", [2.0] * 64)], "word string, vec array<float>")
    monkeypatch.setattr(CG, "_encoded", lambda *_: (seq, vocab))
    monkeypatch.setattr(CG, "word_vectors", lambda *_: wv)
    inputs = CG.graph_inputs(spark, "")
    assert np.allclose(inputs.rest, 2)
    assert {r.node: r.vec[0] for r in inputs.vectors.collect()} == {1: 2.0, 2: 2.0, 3: 2.0}
