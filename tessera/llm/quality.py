"""Quality rules at host level, in DataFrame functions only.

Each document gets base figures and four rule failures (too short, repeated word
windows, symbols, repeated lines). Failures are summed by host; each host's failure
rate per rule is shrunk with a beta prior whose mean and strength are estimated from
all hosts (method of moments), so that a host of two documents is not judged on two
documents. A host is rejected if the shrunk rate of some rule is over ``reject_rate``;
the verdict is joined back to its documents.

Only narrow figures are shuffled, never texts. Hosts are broadcast below a checked
size and else joined on salted keys, so a host with a third of all rows is spread out.

Defined cases: null and empty text have no words (too short, so the document fails);
a null host has no verdict, its documents stand on their own figures; repeated rows are
counted and returned again; an empty table gives an empty result; columns other than
the id, the text and the host are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, words, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10      # symbols per 100 words
MAX_DUP_LINE_PERCENT = 30    # repeated lines per 100 lines
REJECT_RATE = 0.5
HOST_BROADCAST_BYTES = 32 << 20
SALTS = 64
WINDOW = 3
RULES = ("fail_short", "fail_repeat", "fail_symbols", "fail_lines")


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words from ``_w``: words covered by a 3-word window that occurs twice.

    Per document: 64-bit hashes of all windows, packed with their position (the low
    ``_b`` bits) and sorted as plain longs; equal neighbours are repeats, confirmed on
    the whole hash. Linear in the text but for the sort, whatever repeats."""
    n = F.size("_w")
    w = F.col("_w")
    df = df.withColumn("_win", F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)),
        lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))))
        .otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_b", F.length(F.bin(F.size("_win"))))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_b")) - 1
    df = df.withColumn("_mask", mask)
    df = df.withColumn("_srt", F.sort_array(F.transform("_win", lambda h, i: h.bitwiseAND(F.bitwise_not(F.col("_mask")))
                                                        .bitwiseOR(i.cast("long")))))
    m, win, srt = F.col("_mask"), F.col("_win"), F.col("_srt")

    def same(x: Column, j: Column) -> Column:
        y = F.get(srt, j)
        near = F.coalesce(x.bitwiseAND(F.bitwise_not(m)) == y.bitwiseAND(F.bitwise_not(m)), F.lit(False))
        return near & (F.get(win, x.bitwiseAND(m).cast("int")) == F.get(win, y.bitwiseAND(m).cast("int")))

    df = df.withColumn("_rep", F.filter("_srt", lambda x, i: same(x, i - 1) | same(x, i + 1)))
    return df.withColumn("n_repeat_words", F.when(F.size("_rep") == 0, F.lit(0).cast("long")).otherwise(F.size(
        F.array_distinct(F.flatten(F.transform("_rep", lambda x: F.array(
            *[x.bitwiseAND(F.col("_mask")) + k for k in range(WINDOW)]))))).cast("long")))


def base_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                 carry: bool = False) -> DataFrame:
    """``(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, base_failed)`` and one boolean per rule, for every row; with ``carry`` also
    the whole input row as the struct ``row``."""
    rest = ["row"] if carry else []
    df = docs.select(col(id_col).alias("doc_id"), col(host_col).cast("string").alias("host"), col(text_col).alias("_t"),
                     *([F.struct(*[col(c) for c in docs.columns]).alias("row")] if carry else []))
    t = F.coalesce(F.col("_t"), F.lit(""))
    df = _repeat_words(df.withColumn("_w", words(F.col("_t"))))
    df = df.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")))
    df = df.select(
        "doc_id", "host", F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", F.size("_l").cast("long").alias("n_lines"), *rest)
    short = F.col("n_words") < MIN_WORDS
    repeat = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return (df.withColumn("base_failed", short | repeat)
            .withColumn("fail_short", short).withColumn("fail_repeat", repeat)
            .withColumn("fail_symbols", 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"))
            .withColumn("fail_lines", 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")))


def host_verdicts(figures: DataFrame, reject_rate: float = REJECT_RATE) -> DataFrame:
    """``(host, n, rate_<rule>..., host_ok)``: shrunk failure rates of every host.

    For each rule: m = overall rate, tau2 = variance of host rates around m beyond what
    binomial noise explains, strength s = m(1-m)/tau2 - 1 (at least 1), prior
    Beta(m s, (1-m) s), rate = (k + m s) / (n + s)."""
    by = (figures.filter(F.col("host").isNotNull()).groupBy("host")
          .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES]))
    by = written(by, "hosts")  # one row per host, read three times below
    g = by.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("H"),
               *[F.sum(r).alias(f"k_{r}") for r in RULES],
               *[F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"q_{r}") for r in RULES]).first()
    out, ok = [], F.lit(True)
    for r in RULES:
        m = (g[f"k_{r}"] or 0) / (g["N"] or 1)
        between = (g[f"q_{r}"] or 0.0) / (g["N"] or 1) - m * m
        tau2 = between - m * (1 - m) * g["H"] / (g["N"] or 1)
        s = max(1.0, m * (1 - m) / tau2 - 1) if tau2 > 1e-12 else 1e6
        rate = (F.col(r) + m * s) / (F.col("n") + s)
        out.append(rate.alias(f"rate_{r}"))
        ok = ok & (rate <= reject_rate)
    return by.select("host", "n", *out, ok.alias("host_ok"))


def _join_hosts(figures: DataFrame, hosts: DataFrame) -> DataFrame:
    verdict = hosts.filter(~F.col("host_ok")).select(F.col("host").alias("h"), "host_ok")
    size = verdict.agg(F.coalesce(F.sum(F.length("h") * 4 + 40), F.lit(0))).first()[0]
    if size <= HOST_BROADCAST_BYTES:
        return figures.join(F.broadcast(verdict), F.col("host") == F.col("h"), "left").drop("h")
    salted = verdict.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    figures = figures.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return figures.join(salted, (F.col("host") == F.col("h")) & (F.col("_s") == F.col("s")), "left").drop("h", "s", "_s")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          reject_rate: float = REJECT_RATE) -> DataFrame:
    """Base figures, rule failures and ``kept`` of every row."""
    figures = written(base_figures(docs, id_col, text_col, host_col), "figures")
    both = _join_hosts(figures, host_verdicts(figures, reject_rate))
    return (both.withColumn("host_ok", F.coalesce("host_ok", F.lit(True)))
            .withColumn("kept", ~F.col("base_failed") & F.col("host_ok")))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
              reject_rate: float = REJECT_RATE) -> DataFrame:
    """The rows of ``docs`` (all columns) that the rules keep. Rows are written once with
    their own figures, so these are computed once and no text is shuffled."""
    marked = written(base_figures(docs, id_col, text_col, host_col, carry=True).select("row", "host", "base_failed", *RULES,
                                                                                     F.xxhash64("doc_id").alias("doc_id")), "marked")
    hosts = host_verdicts(marked, reject_rate)
    kept = _join_hosts(marked.filter(~F.col("base_failed")), hosts).filter(F.coalesce("host_ok", F.lit(True)))
    return kept.select("row.*")
