import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import line_dedup as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows, min_docs=10):
    n = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if n[key(x)] < min_docs]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bound", [L.BROADCAST_BYTES, 0])
def test_against_brute_force(docs, rows, bound):
    got = result(L.LineIndex.build(docs).apply(docs, broadcast_bytes=bound))
    assert got == brute(rows)
    assert sum(x[2] for x in got) > 10


def test_deleting_gives_the_earlier_state_back(spark, docs, rows):
    added = spark.createDataFrame([(9000 + i, "a fresh line\nw1 w2") for i in range(12)], "doc_id long, text string")
    before = L.LineIndex.build(docs)
    more = before.update(added=added)
    assert result(more.apply(added))[0][2] == 2
    assert sorted(more.counts.collect()) == sorted(L.LineIndex.build(docs.select("doc_id", "text").unionByName(added)).counts.collect())
    after = more.update(removed=added)
    assert sorted(after.counts.collect()) == sorted(before.counts.collect())
    assert result(after.apply(docs)) == result(before.apply(docs))
    assert result(after.apply(added))[0][2] == 0
    assert {r.n_keys for r in after.filters.collect()} == {r.n_keys for r in before.filters.collect()}
    none = before.update(removed=docs)
    assert none.counts.count() == 0 and result(none.apply(docs)) == brute([(r[0], r[1]) for r in rows], 10**9)


def test_empty(empty):
    index = L.LineIndex.build(empty)
    assert index.apply(empty).count() == 0 and index.counts.count() == 0


def test_cuckoo_filter_inserts_and_deletes():
    h = np.random.default_rng(0).integers(0, 2**63, (5000, 2), dtype=np.uint64)
    f = L.CuckooFilter.of(h[:, 0], h[:, 1])
    assert f.contains(h[:, 0], h[:, 1]).all()
    for a, b in h[:2500].tolist():
        assert f.delete(a, b)
    assert f.contains(h[2500:, 0], h[2500:, 1]).all() and f.contains(h[:2500, 0], h[:2500, 1]).mean() < 0.001
    again = L.CuckooFilter.from_bytes(f.to_bytes())
    assert (again.table == f.table).all()


def test_key_is_ascii_only():
    for x in (" \x0bA  ", "É\x1f", "\x85ab\r"):
        assert L.line_key(x.encode()).decode() == key(x)
    assert re.fullmatch(r"[\x20\x09-\x0D]*", "".join(map(chr, [*range(9, 14), 32])))


@pytest.mark.parametrize("bound", [0, 40])
def test_filters_are_probed_in_passes(spark, docs, rows, monkeypatch, bound):
    """Many small filter shards: beyond the bound each group of shards is probed on its own."""
    monkeypatch.setattr(L, "SHARD_KEYS", 1)
    many = [(i, "\n".join(f"common line {j}" for j in range(9)) + f"\nown {i}", *r[2:]) for i, r in enumerate(rows[:30])]
    both = docs.unionByName(spark.createDataFrame(many, docs.schema))
    index = L.LineIndex.build(both)
    assert index.n_shards > 3
    passes = []
    probe = L._prober
    monkeypatch.setattr(L, "_prober", lambda tables, n: (passes.append(len(tables.value)), probe(tables, n))[1])
    assert result(index.apply(both, broadcast_bytes=bound)) == brute(rows + many)
    assert len(passes) > 3 and max(passes) < index.n_shards
