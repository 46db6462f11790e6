import random

import numpy as np
import pytest

from tessera.llm import decontaminate as D


def edits(a, b):
    """Edit distance of a to its best run in b, by the plain recurrence."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def pool(rng, n):
    return [f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(n)]


def changed(rng, words, d):
    x = list(words)
    for _ in range(d):
        p = rng.randrange(len(x))
        kind = rng.randrange(3)
        if kind == 0:
            x[p] = rng.choice(pool(rng, 3))
        elif kind == 1 and len(x) > 1:
            del x[p]
        else:
            x.insert(p, rng.choice(pool(rng, 3)))
    return x


def planted(seed, n_items=40, n_docs=150):
    rng = random.Random(seed)
    items = [(i, " ".join(pool(rng, rng.randint(8, 70)))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        w = pool(rng, rng.randint(0, 120))
        if i % 2 == 0:
            t = items[rng.randrange(n_items)][1].split()
            w += changed(rng, t, rng.randint(0, D.allowed(len(t), 0.8))) + pool(rng, 30)
        docs.append((i, ", ".join(w).upper() if i % 3 == 0 else " ".join(w)))
    return items, docs


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    items, docs = planted(seed)
    got = D.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for i, t in docs:
        for k, s in items:
            a, b = D.words(s), D.words(t)
            e = edits(a, b)
            if e <= D.allowed(len(a), 0.8):
                want[i, k] = e
    have = {(r.doc_id, r.item_id): r.distance for r in got}
    assert all(want.get(p) == d for p, d in have.items())        # exact, none too many
    assert len(have) >= 0.99 * len(want) and len(want) > 60
    by_id, by_item = dict(docs), dict(items)
    for r in got:                                                # the span is the run
        run = D.words(by_id[r.doc_id])[r.first_word:r.first_word + r.n_words]
        assert edits(D.words(by_item[r.item_id]), run) == r.distance and r.item_words == len(D.words(by_item[r.item_id]))


def test_recall_at_the_bound():
    """Items with every allowed edit, for many random walks: recall over 0.99."""
    rng = random.Random(7)
    items = [(i, " ".join(pool(rng, rng.randint(15, 60)))) for i in range(150)]
    x = D.Items.of(items)
    hit = 0
    for k, t in enumerate(x.texts):
        w = items[k][1].split()
        doc = pool(rng, 40) + changed(rng, w, D.allowed(len(t), 0.8)) + pool(rng, 40)
        hit += any(m[1] == k for m in x.matches(*D._numbers([" ".join(doc)], x.vocab)))
    assert hit >= 0.99 * len(items)


def test_q_gram_windows_lose_nothing():
    items, docs = planted(11)
    x = D.Items.of(items)
    for _, t in docs:
        n, _ = D._numbers([t], x.vocab)
        for c in x.classes:
            at = set(x.windows(n, c).tolist())
            for k in set(c.owners.tolist()):
                d, first, _ = D.nearest_run(x.texts[k], n)
                if d <= D.allowed(len(x.texts[k]), 0.8):
                    assert any(s in at for s in range(max(0, first - 1), first + 2))


def test_walks_of_equal_windows_are_equal():
    items, _ = planted(3)
    x = D.Items.of(items)
    t = x.texts[0]
    doc = np.concatenate([np.zeros(7, np.int64), t, np.zeros(5, np.int64)])
    own = x.walk(t, np.zeros(1, np.int64), np.array([len(t)]), 8)
    inside = x.walk(doc, np.array([7]), np.array([len(doc)]), 8)
    assert (own == inside).all()


def test_blocks_and_stage(spark, docs, empty):
    items, planted_docs = planted(5)
    bench = spark.createDataFrame([*items, (100, None), (101, ""), (102, items[0][1])], "item_id long, text string")
    d = spark.createDataFrame(planted_docs, "doc_id long, text string")
    one = sorted(map(tuple, D.find(d, bench).collect()))
    many = sorted(map(tuple, D.find(d, bench, block_chars=2000).collect()))
    assert {x[:2] for x in one} == {x[:2] for x in many}
    assert {x[0] for x in one if x[1] == 0} == {x[0] for x in one if x[1] == 102}
    bad = {x[0] for x in one}
    assert {r.doc_id for r in D.keep_clean(d, bench).collect()} == {i for i, _ in planted_docs} - bad
    assert D.find(d, empty.withColumnRenamed("doc_id", "item_id")).count() == 0 and D.find(empty, bench).count() == 0
    out = D.keep_clean(docs, bench)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_scripts_without_spaces(spark):
    """A passage without punctuation inside a longer run of letters, some letters changed."""
    rng = random.Random(8)
    letters = {"han": range(0x4E00, 0x5200), "kana": range(0x3041, 0x3091), "thai": range(0x0E01, 0x0E2F)}
    items, docs = [], []
    for k, (name, points) in enumerate(letters.items()):
        text = lambda n: "".join(chr(rng.choice(points)) for _ in range(n))  # noqa: B023, E731
        passage = text(60)
        edited = "".join(chr(rng.choice(points)) if i % 20 == 7 else x for i, x in enumerate(passage))
        items.append((k, passage))
        docs += [(10 * k, text(150) + passage + text(90)), (10 * k + 1, text(80) + edited + text(200)), (10 * k + 2, text(300)),
                 (10 * k + 3, f"{name} words, {name} 12 " + text(5))]
    got = D.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(10 * k + j, k) for k in range(3) for j in (0, 1)}
    assert {r.distance for r in got if r.doc_id % 10 == 0} == {0}
    assert D.words("ab\u4e2d\u6587c1 \u30c6 \u00e9t\u00e9") == ["ab", "\u4e2d", "\u6587", "c1", "\u30c6", "\u00e9t\u00e9"]
