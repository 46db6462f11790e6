import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid as L

SYLLABLES = {"aa": ["the", "ing", "and", "tion", "er"], "bb": ["sch", "ung", "lich", "und", "en"], "cc": ["que", "eau", "oir", "les", "ç"]}


def corpus(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(rng.integers(2, 60))]
        rows.append((i, " ".join(words), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    out = L.held_out(F.col("doc_id"))
    model = L.train(docs.filter(~out))
    got = L.predict(docs, model).join(docs.select("doc_id", "lang", out.alias("o")), "doc_id").filter("o").collect()
    assert len(got) > 60 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_filter_holds_every_learned_gram(spark):
    """No gram is missed, and accidental hits are near the estimate."""
    docs = corpus(spark)
    model = L.train(docs)
    rows = docs.collect()
    for i, lang in enumerate(model.languages):
        texts = [r.text for r in rows if r.lang == lang]
        h, own, _ = L.grams(texts)
        n = {}
        for g in {(int(a), int(b)) for a, b in zip(h, own, strict=True)}:
            n[g[0]] = n.get(g[0], 0) + 1
        learned = np.array([g for g, c in n.items() if c >= max(2, L.MIN_RATE * len(texts))], np.uint64)
        assert ((model.masks(learned)[:, 0] >> np.uint64(i)) & np.uint64(1)).all()
        other = np.random.default_rng(1).integers(0, 2**63, 200_000, dtype=np.uint64)
        rate = ((model.masks(other)[:, 0] >> np.uint64(i)) & np.uint64(1)).mean()
        assert abs(rate - model.accidental[i]) < 0.002


def test_many_languages_need_several_words(spark):
    letters = [chr(0x4E00 + i) for i in range(140)]
    rows = [(k * 10 + j, (letters[2 * k] + letters[2 * k + 1]) * 9 + " " + letters[2 * k], f"l{k:03}") for k in range(70) for j in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs)
    assert model.slots.shape[1] == 2
    got = L.predict(docs, model).join(docs.drop("text"), "doc_id").collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_awkward_rows(docs, rows, empty):
    model = L.train(docs)
    assert model.languages == ["de", "en", "fr"]
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in L.predict(docs, model).collect()), key=repr)
    want = {r[0]: any(c.isalpha() for c in r[1] or "") for r in rows}
    assert len(got) == len(rows) and all((p != "und") == want[i] for i, p, _ in got)
    assert all(s == 0 for _, p, s in got if p == "und")
    assert L.predict(empty, model).count() == 0
    nothing = L.train(empty)
    assert {r.lang_pred for r in L.predict(docs, nothing).collect()} == {"und"}


@pytest.mark.parametrize("text", ["a", "Ab", "x1y", "ΑΒΓ", "a" * 3, "İ"])
def test_short_texts_have_grams(text):
    h, own, has = L.grams([text, "", None, "12"])
    assert has.tolist() == [True, False, False, False] and len(h) > 0 and set(own.tolist()) == {0}


def test_votes_against_plain_sets(spark):
    """With a set of grams per language in place of the filter: the same language, and scores
    that differ by the corrected accidental hits only."""
    docs = corpus(spark)
    model = L.train(docs)
    rows = docs.collect()
    known = {}
    for lang in model.languages:
        texts = [r.text for r in rows if r.lang == lang]
        h, own, _ = L.grams(texts)
        n = {}
        for g, _ in {(int(a), int(b)) for a, b in zip(h, own, strict=True)}:
            n[g] = n.get(g, 0) + 1
        known[lang] = {g for g, c in n.items() if c >= max(2, L.MIN_RATE * len(texts))}
    for r in L.predict(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        h, _, has = L.grams([r.text])
        hits = [sum(int(x) in known[lang] for x in h) for lang in model.languages]
        best = max(hits, default=0)
        if not has[0]:
            assert r.lang_pred == "und"
        elif best and hits.count(best) == 1 and sorted(hits)[-2] < 0.9 * best:
            assert r.lang_pred == model.languages[hits.index(best)]
            assert abs(r.score - best / len(h)) < 0.02


def test_more_languages_than_one_filter_holds(spark, monkeypatch, docs):
    """Asking group by group gives what one filter with all languages gives."""
    letters = [chr(0x4E00 + i) for i in range(40)]
    rows = [(k * 10 + j, (letters[2 * k] + letters[2 * k + 1]) * 9 + " " + letters[2 * k], f"l{k:03}") for k in range(20) for j in range(5)]
    own = spark.createDataFrame([*rows, (900, None, "l001"), (901, "12", None), (902, "zzz", None)], "doc_id long, text string, lang string")
    key = lambda df: sorted(((r.doc_id, r.lang_pred, round(r.score, 6)) for r in df.collect()), key=repr)
    want = key(L.predict(own, L.train(own)))
    monkeypatch.setattr(L, "MAX_LANGUAGES", 6)
    model = L.train(own)
    assert len(model.rest) == 3
    got = key(L.predict(own, model))
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 0.02 for a, b in zip(got, want, strict=True))
