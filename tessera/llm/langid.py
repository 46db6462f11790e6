"""Language ID with language-bitmask n-gram filters.

Training counts, for each character 4-gram and language, the documents that hold it; a
language contains the 4-grams found in ``MIN_RATE`` of its documents or more (and in two at
least). A share of documents, not a number, decides, so a filter holds at most (4-grams of
a mean document) / MIN_RATE entries at any corpus size.

Up to ``MAX_LANGUAGES`` languages share one bit-sliced Bloom filter (further ones have filters of
their own, asked in further passes): slot -> bitmask of languages. The AND of a
4-gram's ``HASHES`` slots gives every language that contains it in one probe. A document's
hits are counted per language; with f = (filled share of the language's bits) ** HASHES, the
expected accidental hits are taken away, (hits - f n) / (1 - f), and the largest count
decides (ties: the first language by code point). The score is that count's share of the
document's 4-grams, within 0 and 1; with no hit at all the language of most training
documents is given with score 0.

Texts are lower-cased, all but letters become one space, and a space is put before and
three after.

Defined cases: null text, text without a letter, and a model without languages give ``und``
and score 0; null languages and null texts are not learned from; rows that repeat count
again; a null id is never held out; an empty table gives an empty result; columns other than
the id, the text and (in training) the language are not read; a very long text is one row of a
task, with memory in proportion to its characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, slices, written

N = 4
HASHES = 3
MIN_RATE = 0.005
MAX_LANGUAGES = 1024  # of one filter
_PAD = 3


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number) of all 4-grams of some texts, and which texts have a letter."""
    lowered = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    own = np.repeat(np.arange(len(texts)), [len(x) // 4 + 1 + _PAD for x in lowered])
    pad = " ".encode("utf-32-le")
    c = np.frombuffer(b"".join(pad + x + pad * _PAD for x in lowered), "<u4")
    letter = _letters()[c]
    has = np.zeros(len(texts), bool)
    has[own[letter]] = True
    # keep letters, the first space of each run, and the padding behind the text
    tail = np.cumsum([len(x) // 4 + 1 + _PAD for x in lowered]) if texts else np.zeros(0, np.int64)
    keep = letter | np.concatenate(([True], letter[:-1])) if len(c) else letter
    for k in range(1, _PAD + 1):
        keep[tail - k] = True
    c, own = np.where(letter, c, 32)[keep].astype(np.uint64), own[keep]
    if len(c) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    h = np.zeros(len(c) - N + 1, np.uint64)
    for k in range(N):
        h = h * np.uint64(0x100000001B3) + c[k:len(c) - N + 1 + k]
    whole = (own[:len(h)] == own[N - 1:]) & has[own[:len(h)]]
    return _mix(h[whole] * np.uint64(0x9E3779B97F4A7C15)), own[:len(h)][whole], has


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    languages: list[str]      # by code point
    default: int              # index of the language of most training documents
    slots: np.ndarray         # (slots, words) uint64 bitmasks
    accidental: np.ndarray    # per language: chance that a 4-gram hits by accident
    learned: int = 0          # training documents of the default language
    rest: list = field(default_factory=list)  # models of the languages after the first MAX_LANGUAGES

    def masks(self, h: np.ndarray) -> np.ndarray:
        a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        m = np.uint64(len(self.slots) - 1)
        out = self.slots[(a & m).astype(np.int64)]
        for k in range(1, HASHES):
            out = out & self.slots[((a + np.uint64(k) * b) & m).astype(np.int64)]
        return out

    def best(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: the language with most corrected hits, these hits, its 4-grams, and whether it
        has a letter."""
        h, own, has = grams(texts)
        n = np.bincount(own, minlength=len(texts)).astype(float)
        masks = self.masks(h)
        found = np.empty((len(texts), len(self.languages)))
        for i, f in enumerate(self.accidental):
            bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits = np.bincount(own, weights=bit.astype(float), minlength=len(texts))
            found[:, i] = np.maximum(0, (hits - f * n) / (1 - f)) if f < 1 else 0
        best = found.argmax(1)
        return best, found[np.arange(len(texts)), best], n, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages or not len(texts):
            return ["und"] * len(texts), np.zeros(len(texts))
        best, top, n, has = self.best(texts)
        best[top <= 0] = self.default
        score = np.clip(top / np.maximum(n, 1), 0, 1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, score, 0.0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on all rows of ``docs`` with a text and a language."""
    rows = docs.select(col(text_col).alias("text"), col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            langs = b.column(1).to_pylist()
            h, own, _ = grams(b.column(0).to_pylist())
            for lang in sorted(set(langs)):
                of = np.fromiter((x == lang for x in langs), bool, len(langs))
                # distinct within each text, then documents by 4-gram
                ends = np.searchsorted(own, np.flatnonzero(of), side="right")
                begins = np.searchsorted(own, np.flatnonzero(of), side="left")
                each = [np.unique(h[i:j]) for i, j in zip(begins, ends, strict=True)]
                u, n = np.unique(np.concatenate(each), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(u) + 1)), pa.array(np.append(u.view(np.int64), 0)),
                     pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(len(u), np.int64), int(of.sum())))],
                    names=["lang", "h", "n", "docs"])

    counts = written(rows.mapInArrow(count, "lang string, h long, n long, docs long").groupBy("lang", "h")
                     .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "gram-counts")
    sizes = counts.groupBy("lang").agg(F.sum("docs").alias("docs")).orderBy("lang").collect()  # a row per language
    if not sizes:
        return Model([], 0, np.zeros((1, 1), np.uint64), np.zeros(0))
    models = [_filter_of(counts, sizes[i:i + MAX_LANGUAGES]) for i in range(0, len(sizes), MAX_LANGUAGES)]
    models[0].rest = models[1:]
    return models[0]


def _filter_of(counts: DataFrame, sizes: list) -> Model:
    """The model of some languages, given by their rows (lang, docs)."""
    names = [r["lang"] for r in sizes]
    spark = counts.sparkSession
    need = spark.createDataFrame([(r["lang"], i, float(max(2, MIN_RATE * r["docs"])) if r["docs"] > 1 else 1.0) for i, r in enumerate(sizes)],
                                 "lang string, i int, least double")
    kept = written(counts.join(F.broadcast(need), "lang").filter("n >= least").select("i", "h"), "grams")
    most = kept.groupBy("i").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    m = 1 << (int(most) * 16 - 1).bit_length()
    words = -(-len(names) // 64)
    a, b = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("h", 32).bitwiseOR(F.lit(1).cast("long"))
    at = F.array(*[(a + k * b).bitwiseAND(F.lit(m - 1).cast("long")) for k in range(HASHES)])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i") % 64)
    filled = (kept.select(F.explode(at).alias("slot"), F.floor(F.col("i") / 64).cast("int").alias("word"), bit.alias("bit"))
              .groupBy("slot", "word").agg(F.bit_or("bit").alias("mask")).toPandas())  # at most m * words rows
    slots = np.zeros((m, words), np.uint64)
    slots[filled["slot"].to_numpy(), filled["word"].to_numpy()] = filled["mask"].to_numpy().astype(np.int64).view(np.uint64)
    fill = np.array([((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(names))])
    default = max(range(len(names)), key=lambda i: (sizes[i]["docs"], -i))
    return Model(names, default, slots, fill ** HASHES, sizes[default]["docs"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row. With more than MAX_LANGUAGES languages every
    group of them is asked in a pass of its own, with its filter broadcast."""
    if model.rest:
        return _in_passes(docs, [model, *model.rest], id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MIN_RATE, see above

    def run(batches):
        for b in slices(batches):
            lang, score = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def _in_passes(docs: DataFrame, models: list[Model], id_col: str, text_col: str) -> DataFrame:
    sc, kind = docs.sparkSession.sparkContext, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("top"))
    for m in models:
        shared = sc.broadcast(Model(m.languages, m.default, m.slots, m.accidental))

        def ask(batches, shared=shared):
            m = shared.value
            for b in slices(batches):
                best, top, n, has = m.best(b.column(1).to_pylist())
                share = np.where(has, np.clip(top / np.maximum(n, 1), 0, 1), 0.0)
                lang, had = b.column(2).to_pylist(), b.column(3).to_numpy()
                lang = [m.languages[k] if s > h else x for x, k, s, h in zip(lang, best.tolist(), share, had, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(np.maximum(share, had))],
                                                 names=["doc_id", "text", "lang", "top"])
        rows = written(rows.mapInArrow(ask, f"doc_id {kind}, text string, lang string, top double"), "language-pass")
    usual = max(models, key=lambda m: m.learned)  # the first of those with most documents
    fallback = usual.languages[usual.default]

    def named(batches):
        for b in slices(batches):
            letter = grams(b.column(1).to_pylist())[2]
            lang = ["und" if not ok else x or fallback for x, ok in zip(b.column(2).to_pylist(), letter, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), b.column(3)], names=["doc_id", "lang_pred", "score"])
    return rows.mapInArrow(named, f"doc_id {kind}, lang_pred string, score double")
