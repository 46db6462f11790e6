import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from tessera.llm import periodic as P
from tessera.llm.queries import QUERIES
from tests.llm.conftest import SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=24, power=3):
    out = []
    for q in range(1, len(w) // power + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if i > s and n >= max(least, power * q) and not any(w[s:s + n][p:] == w[s:s + n][:-p] for p in range(1, q)):
                out.append((s, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def nested(rng):
    k, w = rng.choice([1, 2, 3, 50]), []
    for _ in range(rng.randint(0, 6)):
        base = [b"%d" % rng.randrange(k) for _ in range(rng.randint(1, 9))]
        w += base * rng.randint(1, 12) + base[:rng.randint(0, len(base))]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        docs = [nested(rng) for _ in range(rng.randint(1, 5))]
        least, power = rng.choice([(24, 3), (6, 3), (5, 2), (24, 2), (12, 4)])
        assert P.find_runs(docs, least, power) == [brute(w, least, power) for w in docs]


def test_suffix_array_and_intervals():
    import numpy as np
    rng = random.Random(3)
    x = np.array([rng.randrange(3) for _ in range(300)] + [9])
    sa, isa, levels = P.suffix_array(x)
    lists = [x[i:].tolist() for i in range(len(x))]
    assert sa.tolist() == sorted(range(len(x)), key=lists.__getitem__) and (isa[sa] == np.arange(len(x))).all()
    lcp = P.common_prefixes(sa, levels)
    same = lambda a, b: next(k for k, (u, v) in enumerate(zip(a, b, strict=False)) if u != v)
    assert lcp.tolist() == [0] + [same(lists[sa[j - 1]], lists[sa[j]]) for j in range(1, len(x))]
    for j, a, b in zip(*P.intervals(lcp), strict=True):
        assert a < j < b and (lcp[a + 1:b] >= lcp[j]).all() and (b == len(x) or lcp[b] < lcp[j])


def test_long_single_run_and_long_text():
    assert P.find_runs([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]
    w = [b"%d" % (i * i % 7919) for i in range(60_000)] + [b"x", b"y", b"z"] * 5_000
    runs = P.find_runs([w])[0]
    assert (60_000, 15_000, 3) in runs


def expected(doc_id, text):
    w = WORD.findall(text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute(w) if n < 2_000 else P.find_runs([[x.encode() for x in w]])[0]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_brute_force(spark, rows, tmp_path):
    more = [(100_000 + i, " ".join(f"k{j * (i + 3) % 97}" for j in range(20 + 9 * i)), "en", "b", 1, *["x"] * 10) for i in range(60)]
    spark.createDataFrame(rows + more, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    want = sorted((expected(r[0], r[1]) for r in rows + more), key=repr)
    assert got == want
    assert sum(r[1] > 0 for r in want) > 5


def test_empty_and_bad_parameters(empty, docs):
    assert P.detect(empty).count() == 0
    with pytest.raises(ValueError):
        P.detect(docs, power=1)
