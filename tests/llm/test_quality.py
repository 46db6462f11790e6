import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    t = text or ""
    w = WORD.findall(t)
    win = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if win[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines))


def verdicts(rows, reject=0.5):
    """host -> verdict, by the formulas of the module text."""
    by = defaultdict(list)
    for r in rows:
        f = figures(r[1])
        rules = (f[0] < 50, 100 * f[4] > 50 * f[0], 100 * f[2] > 10 * f[0], 100 * f[3] > 30 * f[5])
        if r[3] is not None:
            by[r[3]].append(rules)
    bad, total = set(), sum(map(len, by.values()))
    for k in range(4):
        fails = {h: sum(x[k] for x in v) for h, v in by.items()}
        m = sum(fails.values()) / total
        tau2 = sum(fails[h] ** 2 / len(v) for h, v in by.items()) / total - m * m - m * (1 - m) * len(by) / total
        s = max(1.0, m * (1 - m) / tau2 - 1) if tau2 > 1e-12 else 1e6
        bad |= {h for h, v in by.items() if (fails[h] + m * s) / (len(v) + s) > reject}
    return bad


@pytest.mark.parametrize("reject", [0.5, 0.3])
@pytest.mark.parametrize("bound", [Q.HOST_BROADCAST_BYTES, -1])
def test_against_brute_force(docs, rows, monkeypatch, reject, bound):
    monkeypatch.setattr(Q, "HOST_BROADCAST_BYTES", bound)
    got = Q.judge(docs, reject_rate=reject).collect()
    bad = verdicts(rows, reject)
    want = []
    for r in rows:
        f = figures(r[1])
        failed = f[0] < 50 or 100 * f[4] > 50 * f[0]
        want.append((r[0], *f[:5], failed, not failed and r[3] not in bad))
    have = [(g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed, g.kept) for g in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_bad_host_takes_its_good_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good, "fine") for i in range(200)] + [(1000 + i, "too short", "bad") for i in range(50)]
    rows += [(2000, good, "bad"), (2001, good, None), (2002, "short", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in Q.keep_good(docs).collect()}
    assert kept == {*range(200), 2001}


def test_stage_keeps_all_columns(docs):
    out = Q.keep_good(docs)
    assert out.columns == docs.columns
    judged = {r.doc_id for r in Q.judge(docs).filter("kept").collect()}
    assert {r.doc_id for r in out.collect()} == judged
    assert out.filter(F.col("row") != "clash").count() == 0


def test_main_path_is_native(docs):
    plan = Q.judge(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(empty):
    assert Q.judge(empty).count() == 0 and Q.keep_good(empty).count() == 0
