"""Golden values stated in, or following directly from, the original sources."""

from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.functions import text as T
from tessera.operators import recode as RC
from tessera.operators.ranking import bin_of_rank


def _one(spark, col, **lits):
    df = spark.createDataFrame([tuple(lits.values())], ", ".join(f"{k} {_ty(v)}" for k, v in lits.items()))
    return df.select(col.alias("r")).first()["r"]


def _ty(v):
    if isinstance(v, list):
        return "array<string>"
    if isinstance(v, int):
        return "bigint"
    return "string"


def test_ngrams_examples(spark):
    w3 = ["I", "am", "Denny"]
    assert _one(spark, T.ngrams("w", 2, "_"), w=w3) == ["I_am", "am_Denny"]
    assert _one(spark, T.ngrams("w", 3, "_"), w=w3) == ["I_am_Denny"]
    assert _one(spark, T.ngrams("w", 4, "_"), w=w3 + ["boy"]) == ["I_am_Denny_boy"]
    assert _one(spark, T.ngrams("w", 4, "_"), w=w3) == ["I_am_Denny"]          # falls back to trigrams
    assert _one(spark, T.ngrams("w", 2, "_"), w=["I"]) == ["I"]                # falls back to unigrams
    assert _one(spark, T.ngrams_multi("w", 12, "_"), w=["I"]) == ["I"]         # fall-back item dropped


def test_nterms_examples(spark):
    w4 = ["I", "am", "Denny", "boy"]
    assert _one(spark, T.nterms("w", 2, "_"), w=w4) == ["I_am", "I_Denny", "I_boy", "am_Denny", "am_boy", "Denny_boy"]
    assert _one(spark, T.nterms("w", 3, "_"), w=w4) == ["I_am_Denny", "I_am_boy", "I_Denny_boy", "am_Denny_boy"]
    assert _one(spark, T.nterms("w", 4, "_"), w=w4 + ["ha"]) == [
        "I_am_Denny_boy", "I_am_Denny_ha", "I_am_boy_ha", "I_Denny_boy_ha", "am_Denny_boy_ha"]


def test_skip_bigrams(spark):
    assert _one(spark, T.ngrams("w", 2, "_", skip=1), w=["a", "b", "c"]) == ["a_b", "a_c", "b_c"]


def test_clean_text_units(spark):
    assert _one(spark, T.apply_rules("t", T.R.CLEAN_TEXT_RULES[:3]), t="4kgs ") == "4 kg "
    assert _one(spark, T.apply_rules("t", T.R.CLEAN_TEXT_RULES[:3]), t="4kg ") == "4 kg "
    assert _one(spark, T.apply_rules("t", T.R.CLEAN_TEXT_RULES[:3]), t="4k ") == "4000 "


def test_clean_str_keeps_backslash(spark):
    assert _one(spark, T.clean_str("t"), t="a(b") == "a \\( b"
    assert _one(spark, T.clean_str("t"), t="It's   OK?") == "it 's ok \\?"


def test_binary_and_bits(spark):
    assert _one(spark, RC.binary_string("x"), x=5) == "101"
    assert _one(spark, RC.binary_string("x"), x=0) == ""
    assert _one(spark, F.bit_count("x"), x=5) == 2


def test_distance_edge_cases(spark):
    assert _one(spark, S.edit_dist("a", "b"), a="", b="") == 0.0
    assert _one(spark, S.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), a="") == 0.0
    assert _one(spark, S.dice(F.array().cast("array<string>"), F.array().cast("array<string>")), a="") == 0.0
    v = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0, 3.0], [0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>, z array<double>, c array<double>")
    r = v.select(S.cosine("a", "b").alias("bad"), S.cosine("z", "c").alias("zero"), S.cosine("c", "c").alias("same")).first()
    assert r["bad"] == -1.0 and r["zero"] == 0.0 and abs(r["same"] - 1.0) < 1e-12


def test_safe_divide_and_logit(spark):
    assert _one(spark, RC.safe_divide(F.lit(1.0), F.lit(0.0)), a="") == 0.0
    r = spark.range(1).select(RC.logistic(RC.logit(F.lit(0.25))).alias("x")).first()["x"]
    assert abs(r - 0.25) < 1e-12


def test_prefix_bins():
    # lowest int(b * n / 20) rows form prefix b; n = 1314, b = 1 -> 65 rows
    n = 1314
    assert int(1 * n / 20) == 65
    # a row with rank r lies in prefix b iff its first bin is < b
    for r in (0, 64, 65, 1313):
        first = ((r + 1) * 20 - 1) // n
        for b in range(1, 21):
            assert (r < int(b * n / 20)) == (first < b)


def test_bin_of_rank_column(spark):
    df = spark.range(1314).select(bin_of_rank(F.col("id"), 1314).alias("b"))
    assert df.filter("b = 0").count() == 65
    assert df.agg(F.max("b")).first()[0] == 19
