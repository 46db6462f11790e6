"""The pipeline against the operators' brute-force versions, one after the other."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from tessera.llm import decontaminate as D
from tessera.llm.queries import ORACLE, QUERIES, TOKENIZER
from tests.conftest import SMALL
from tests.harness import compare, duck
from tests.llm import test_decontaminate as dec
from tests.llm import test_mixing as mix
from tests.llm import test_quality as qual
from tests.llm import test_simhash as sim
from tests.llm.conftest import SCHEMA, awkward_rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    items = [(i, " ".join(f"q{i}x{j}" for j in range(12 + i))) for i in range(6)]
    rows = awkward_rows()
    long = " ".join(f"v{j}" for j in range(70))
    rows += [(5000 + i, f"{long} {i} {i * 7} " + items[i][1] + f" tail{i} " * 3 + " ".join(f"z{i}{j}" for j in range(40)), "en", "b", 1, *["x"] * 10) for i in range(6)]
    rows += [(6000 + i, " ".join(f"m{i}k{j}" for j in range(60 + i)), "en", ["hot", None, "é"][i % 3], 1, *["x"] * 10) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"{folder}", rows, items


def test_against_brute_force(spark, sf_dir):
    folder, rows, items = sf_dir
    bad = qual.verdicts(rows)
    kept = [r for r in rows if (f := qual.figures(r[1]))[0] >= 50 and 100 * f[4] <= 50 * f[0] and r[3] not in bad]
    assert 40 < len(kept) < len(rows)
    order = sorted({r[0]: r for r in kept if r[0] is not None}.values())
    comp = sim.brute_components([sim.brute_fp(r[1]) for r in order])
    kept = [r for i, r in enumerate(order) if comp[i] == i] + [r for r in kept if r[0] is None]
    item_words = [D.words(t) for _, t in items]
    clean = [r for r in kept if all(dec.edits(w, D.words(r[1])) > D.allowed(len(w), 0.8) for w in item_words)]
    assert len(clean) < len(kept)
    tok = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    size_of = {r[0]: len(mix.WORD.findall(r[1] or "")) for r in clean}
    ids = {r[0]: np.array([*tok.encode(r[1], add_special_tokens=False).ids, 2], "<u4") for r in clean}
    for i, _, _, _, taken in mix.brute(clean):
        if taken:
            want[i, len(ids[i]), zlib.crc32(ids[i].tobytes())] += taken // size_of[i]
    out = P.run(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_stages_return_the_documents_columns(spark, sf_dir):
    folder, _, _ = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights",
                                        "token-ID / binary output"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, folder).schema.names == docs.schema.names
        none = stage(spark, docs.limit(0), folder)
        assert none.schema.names == docs.schema.names and none.count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_oracle(spark, name):
    problems, n, _, _ = compare(spark, duck(SMALL), name, QUERIES[name], ORACLE[name], SMALL)
    assert not problems and n > 0
