"""Catalogue: tabular recodes, scaling, joins, set operations, splits and noise
(``customer``, ``orders``, ``part``, ``lineitem``, ``embeddings`` and the lang task)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import uniform, uniform_sql
from ..operators import recode as RC
from ..operators import sampling as SM
from ..operators.ranking import global_rank
from ..session import stored
from ..tables import table
from .registry import register
from .tasks import LANG_TASK_SQL, SEED, K_LANG, lang_task, noisy_train, noisy_train_sql

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _customer_nulls(spark, sf_dir):
    """``customer`` with planted nulls (10 % balances, 5 % segments), row-keyed."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_nationkey",
                    F.when(uniform(SEED, "c_custkey") >= 0.1, F.col("c_acctbal")).alias("c_acctbal"),
                    F.when(uniform(SEED + 1, "c_custkey") >= 0.05, F.col("c_mktsegment")).alias("c_mktsegment"))


CUST_NULLS_SQL = (f"cn AS (SELECT c_custkey, c_nationkey, CASE WHEN {uniform_sql(SEED, 'c_custkey')} >= 0.1 "
                  f"THEN c_acctbal END AS c_acctbal, CASE WHEN {uniform_sql(SEED + 1, 'c_custkey')} >= 0.05 "
                  f"THEN c_mktsegment END AS c_mktsegment FROM customer)")


@register("project_cols", sql="SELECT c_custkey AS row_id, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def project_cols(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return (c.drop("c_name", "c_nationkey").withColumnRenamed("c_custkey", "row_id")
            .withColumnRenamed("c_acctbal", "balance").withColumnRenamed("c_mktsegment", "segment"))


@register("cast_cols", sql="""SELECT p_partkey, TRY_CAST(substring(p_brand, 7) AS INTEGER) AS brand_no,
CAST(p_size AS DOUBLE) AS size_d, TRY_CAST(CAST(p_retailprice AS VARCHAR) AS DOUBLE) AS price FROM part""")
def cast_cols(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.expr("substring(p_brand, 7)").try_cast("int").alias("brand_no"),
                    F.col("p_size").cast("double").alias("size_d"),
                    F.col("p_retailprice").cast("string").try_cast("double").alias("price"))


@register("recode_map", sql="""SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS INTEGER) AS status_id,
CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '1' ELSE o_orderpriority END AS priority FROM orders""")
def recode_map(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", RC.recode_map("o_orderstatus", {"F": 0, "O": 1}).cast("int").alias("status_id"),
                    RC.replace_values("o_orderpriority", ["1-URGENT", "2-HIGH"], "1").alias("priority"))


@register("binarize", sql="SELECT c_custkey, CAST(c_acctbal > 0 AS INTEGER) AS positive FROM customer")
def binarize(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", RC.binarize("c_acctbal").alias("positive"))


@register("concat_text", sql="""SELECT p_partkey, p_name || ' ' || CASE WHEN p_size > 40 THEN NULL ELSE p_type END AS text_all FROM part""")
def concat_text(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    desc = F.when(F.col("p_size") > 40, F.lit(None)).otherwise(F.col("p_type"))
    return p.select("p_partkey", F.concat(F.col("p_name"), F.lit(" "), desc).alias("text_all"))


@register("shift_label", sql="""SELECT o_orderkey, CAST(TRY_CAST(substring(o_orderpriority, 1, 1) AS INTEGER) - 1 AS INTEGER) AS y,
CAST(TRY_CAST(substring('"' || substring(o_orderpriority, 1, 1), 2) AS INTEGER) - 1 AS INTEGER) AS y_quoted FROM orders""")
def shift_label(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    quoted = F.concat(F.lit('"'), F.substring("o_orderpriority", 1, 1))
    return o.select("o_orderkey", RC.first_char_label("o_orderpriority").alias("y"),
                    RC.shift_label(quoted).alias("y_quoted"))


@register("drop_null", sql=f"WITH {CUST_NULLS_SQL} SELECT * FROM cn WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL")
def drop_null(spark, sf_dir):
    return _customer_nulls(spark, sf_dir).na.drop("any")


@register("fill_null", sql=f"""WITH {CUST_NULLS_SQL}
SELECT c_custkey, c_nationkey, coalesce(c_acctbal, 0.0) AS c_acctbal, coalesce(c_acctbal, -1.0) AS acctbal_or_missing,
coalesce(c_mktsegment, 'NONE') AS c_mktsegment FROM cn""")
def fill_null(spark, sf_dir):
    c = _customer_nulls(spark, sf_dir).withColumn("acctbal_or_missing", F.col("c_acctbal"))
    return c.na.fill(0.0, ["c_acctbal"]).na.fill(-1.0, ["acctbal_or_missing"]).na.fill("NONE", ["c_mktsegment"])


@register("one_hot", sql=f"""WITH {CUST_NULLS_SQL}
SELECT c_custkey, c_nationkey, c_acctbal, {", ".join(f"CAST(coalesce(c_mktsegment = '{s}', false) AS INTEGER) AS c_mktsegment_{s}" for s in SEGMENTS)} FROM cn""")
def one_hot(spark, sf_dir):
    return RC.one_hot(_customer_nulls(spark, sf_dir), "c_mktsegment", SEGMENTS)


WIDE = ("o_custkey", "o_orderstatus", "o_orderpriority")


@register("one_hot_wide", sql=f"""WITH e AS ({" UNION ALL ".join(f"SELECT o_orderkey, {k} AS place, CAST({c} AS VARCHAR) AS value FROM orders" for k, c in enumerate(WIDE))}),
ix AS (SELECT place, value, row_number() OVER (ORDER BY place, value) - 1 AS i FROM (SELECT DISTINCT place, value FROM e WHERE value IS NOT NULL))
SELECT e.o_orderkey, ix.i AS index, (SELECT count(*) FROM ix) AS size FROM e JOIN ix ON ix.place = e.place AND ix.value = e.value""")
def one_hot_wide(spark, sf_dir):
    """One-hot codes of columns with any number of categories: the places of the ones of every
    row and the length of the vector."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", *WIDE)
    index = stored(RC.category_index(o, WIDE), "categories")
    size = index.count()
    out = RC.one_hot_indices(o, "o_orderkey", WIDE, index)
    return out.select("o_orderkey", F.explode("indices").alias("index"), F.lit(size).cast("bigint").alias("size"))


@register("label_one_hot", sql=f"""WITH {LANG_TASK_SQL}
SELECT row_id, CAST(k AS INTEGER) AS k, CAST(k = y AS DOUBLE) AS v FROM lang_task, range(0, {K_LANG}) r(k)""")
def label_one_hot(spark, sf_dir):
    lt = lang_task(spark, sf_dir)
    return lt.select("row_id", F.posexplode(RC.label_one_hot("y", K_LANG)).alias("k", "v"))


@register("split_xy", sql="""SELECT vec_id AS row_id, label AS y, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS k,
round(CAST(unnest(embedding) AS DOUBLE), 6) AS v FROM embeddings""")
def split_xy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"),
                    F.posexplode("embedding").alias("k", "v")).withColumn("v", F.round(F.col("v").cast("double"), 6))


@register("parse_ids", sql="""WITH s AS (SELECT doc_id, '[' || array_to_string(list_transform(
    regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[.!?] '),
    lambda x: '[' || array_to_string(list_transform(list_filter(string_split(x, ' '), lambda w: w <> ''), lambda w: CAST(length(w) AS VARCHAR)), ', ') || ']'), ', ') || ']' AS printed FROM documents),
p AS (SELECT doc_id, CAST(printed AS INTEGER[][]) AS ids FROM s)
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_sent, CAST(len(flatten(ids)) AS INTEGER) AS n_ids,
CAST(coalesce(list_sum(flatten(ids)), 0) AS BIGINT) AS sum_ids FROM p""")
def parse_ids(spark, sf_dir):
    """Parse a printed nested id list ``[[a, b], [c]]`` (here: word lengths per sentence)."""
    d = table(spark, sf_dir, "documents")
    sents = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), "[.!?] ")
    printed = F.concat(F.lit("["), F.array_join(F.transform(sents, lambda x: F.concat(
        F.lit("["), F.array_join(F.transform(F.filter(F.split(x, " "), lambda w: w != ""),
                                             lambda w: F.length(w).cast("string")), ", "), F.lit("]"))), ", "),
        F.lit("]"))
    ids = F.from_json(printed, "array<array<int>>")
    flat = F.flatten(ids)
    return d.select("doc_id", F.size(ids).alias("n_sent"), F.size(flat).alias("n_ids"),
                    F.aggregate(flat, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_ids"))


@register("assign_row_id", sql="""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id FROM orders""")
def assign_row_id(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return global_rank(o, ["o_orderdate", "o_orderkey"], out="row_id").select("o_orderkey", "row_id")


@register("batch_id", sql=f"""WITH {LANG_TASK_SQL}
SELECT row_id, CAST(floor((row_number() OVER (ORDER BY row_id) - 1) / 256) AS BIGINT) AS batch,
CAST(floor((row_number() OVER (ORDER BY {uniform_sql(SEED + 1, 'row_id')}, row_id) - 1) / 256) AS BIGINT) AS batch_epoch1
FROM lang_task""")
def batch_id(spark, sf_dir):
    """Consecutive mini-batches of 256 (last one short), plain and shuffled for epoch 1."""
    lt = lang_task(spark, sf_dir).select("row_id")
    a = global_rank(lt, ["row_id"], out="r0")
    b = SM.shuffle_rank(a, SEED + 1, "row_id", out="r1")
    return b.select("row_id", F.floor(F.col("r0") / 256).cast("bigint").alias("batch"),
                    F.floor(F.col("r1") / 256).cast("bigint").alias("batch_epoch1"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_const"]


def _lineitem_num(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                     F.lit(1.0).alias("l_const"))


@register("scale_minmax", sql=f"""WITH li AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, 1.0 AS l_const FROM lineitem),
s AS (SELECT {", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in _NUM)} FROM li)
SELECT l_orderkey, l_linenumber, {", ".join(f"round(CASE WHEN mx_{c} = mn_{c} THEN 0.0 ELSE ({c} - mn_{c}) / (mx_{c} - mn_{c}) END, 6) AS {c}" for c in _NUM)}
FROM li, s""")
def scale_minmax(spark, sf_dir):
    df = RC.minmax_scale(_lineitem_num(spark, sf_dir), _NUM)
    return df.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in _NUM])


@register("scale_standard", sql=f"""WITH li AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, 1.0 AS l_const FROM lineitem),
s AS (SELECT {", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in _NUM)} FROM li)
SELECT l_orderkey, l_linenumber, {", ".join(f"round(CASE WHEN sd_{c} = 0 THEN 0.0 ELSE ({c} - mu_{c}) / sd_{c} END, 6) AS {c}" for c in _NUM)}
FROM li, s""")
def scale_standard(spark, sf_dir):
    df = RC.standard_scale(_lineitem_num(spark, sf_dir), _NUM)
    return df.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in _NUM])


# ---------------------------------------------------------------------------
# Fact x dimension (orders x customer): domain = market segment, target = price.
# ---------------------------------------------------------------------------

def _fact_dim(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    # No broadcast hint: the dimension grows with the data; AQE switches to a
    # broadcast join at run time when the shuffled side turns out small.
    return o.join(c, o.o_custkey == c.c_custkey).drop("c_custkey")


@register("read_two_tables", sql="""SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment
FROM orders JOIN customer ON o_custkey = c_custkey""")
def read_two_tables(spark, sf_dir):
    return _fact_dim(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice", "c_mktsegment")


@register("join_dim", sql="""SELECT o_orderkey, o_totalprice, c_mktsegment, c_nationkey
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'""")
def join_dim(spark, sf_dir):
    return (_fact_dim(spark, sf_dir).filter(F.col("o_orderstatus") != "P")
            .select("o_orderkey", "o_totalprice", "c_mktsegment", "c_nationkey"))


_TARGET = "CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END"


@register("filter_open", sql=f"""SELECT o_orderkey, target FROM (SELECT o_orderkey, {_TARGET} AS target
FROM orders JOIN customer ON o_custkey = c_custkey) WHERE target <> 0""")
def filter_open(spark, sf_dir):
    fd = _fact_dim(spark, sf_dir).withColumn(
        "target", F.when(F.col("o_orderstatus") == "P", F.lit(0.0)).otherwise(F.col("o_totalprice")))
    return fd.filter(F.col("target") != 0).select("o_orderkey", "target")


def domain_filter(df, mode: str, domain: str, col: str = "c_mktsegment"):
    """all / rest (every domain but one) / only (one domain)."""
    if mode == "all":
        return df
    if mode == "rest":
        return df.filter(F.col(col) != domain)
    return df.filter(F.col(col) == domain)


@register("filter_domain", sql="""SELECT o_orderkey, c_mktsegment AS domain, 'rest' AS mode FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT o_orderkey, c_mktsegment AS domain, 'only' AS mode FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def filter_domain(spark, sf_dir):
    """Both non-trivial modes in one scan: 'rest' (all but the target domain) and
    'only' (the target domain) partition the rows with a known segment."""
    fd = _fact_dim(spark, sf_dir).select("o_orderkey", F.col("c_mktsegment").alias("domain"))
    fd = fd.filter(F.col("domain").isNotNull())
    return fd.withColumn("mode", F.when(F.col("domain") == "BUILDING", "only").otherwise("rest"))


N_SOURCE, N_VALID = 9000, 1000


@register("split_three", sql=f"""SELECT o_orderkey, CASE WHEN r < {N_SOURCE} THEN 'source' WHEN r < {N_SOURCE + N_VALID} THEN 'valid' ELSE 'rest' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {uniform_sql(SEED, 'o_orderkey')}, o_orderkey) - 1 AS r FROM orders)""")
def split_three(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    r = SM.shuffle_rank(o, SEED, "o_orderkey", out="r")
    return r.select("o_orderkey", F.when(F.col("r") < N_SOURCE, "source")
                    .when(F.col("r") < N_SOURCE + N_VALID, "valid").otherwise("rest").alias("split"))


DOMAIN_SQL = f"""{CUST_NULLS_SQL},
j AS (SELECT o.o_orderkey AS row_id, {_TARGET} AS y, coalesce(cn.c_acctbal, 0.0) AS c_acctbal, cn.c_nationkey,
      {", ".join(f"CAST(coalesce(cn.c_mktsegment = '{s}', false) AS INTEGER) AS seg_{s}" for s in SEGMENTS)},
      coalesce(cn.c_mktsegment, 'NONE') AS domain FROM orders o JOIN cn ON o.o_custkey = cn.c_custkey),
op AS (SELECT * FROM j WHERE y <> 0),
rr AS (SELECT *, row_number() OVER (ORDER BY {uniform_sql(SEED, 'row_id')}, row_id) - 1 AS rk FROM op),
dv AS (SELECT row_id, y, c_acctbal, c_nationkey, {", ".join(f"seg_{s}" for s in SEGMENTS)}, domain,
CASE WHEN rk < {N_SOURCE} THEN 'source' WHEN rk < {N_SOURCE + N_VALID} THEN 'valid' ELSE 'rest' END AS split
FROM rr WHERE NOT (rk < {N_SOURCE} AND domain = 'BUILDING'))"""


@register("domain_value", sql=f"WITH {DOMAIN_SQL} SELECT * FROM dv")
def domain_value(spark, sf_dir):
    """Domain-adaptation set-up: fill nulls, one-hot the segment, join, drop closed
    orders, split source/valid/rest, and keep the target domain out of the source."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    c = _customer_nulls(spark, sf_dir).na.fill(0.0, ["c_acctbal"])
    c = c.withColumn("domain", F.coalesce("c_mktsegment", F.lit("NONE")))
    c = RC.one_hot(c, "c_mktsegment", SEGMENTS, prefix="seg")
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .select(F.col("o_orderkey").alias("row_id"),
                 F.when(F.col("o_orderstatus") == "P", F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("y"),
                 "c_acctbal", "c_nationkey", *[f"seg_{s}" for s in SEGMENTS], "domain"))
    op = j.filter(F.col("y") != 0)
    r = SM.shuffle_rank(op, SEED, "row_id", out="rk")
    r = r.withColumn("split", F.when(F.col("rk") < N_SOURCE, "source")
                     .when(F.col("rk") < N_SOURCE + N_VALID, "valid").otherwise("rest"))
    r = r.filter(~((F.col("split") == "source") & (F.col("domain") == "BUILDING")))
    return r.drop("rk")


# ---------------------------------------------------------------------------
# Row-position joins, label maps, set operations.
# ---------------------------------------------------------------------------

@register("join_features", sql=f"""WITH {LANG_TASK_SQL}
SELECT l.row_id, l.y, l.split, f.n_words AS title_n_words, g.n_chars AS description_n_chars FROM lang_task l
JOIN (SELECT doc_id, CAST(len({T.tokenize_en_sql('text')}) AS INTEGER) AS n_words FROM documents) f ON f.doc_id = l.row_id
JOIN (SELECT doc_id, n_chars FROM documents) g ON g.doc_id = l.row_id""")
def join_features(spark, sf_dir):
    base = lang_task(spark, sf_dir).select("row_id", "y", "split")
    d = table(spark, sf_dir, "documents")
    f1 = d.select(F.col("doc_id").alias("row_id"), F.size(T.tokenize_en("text")).alias("title_n_words"))
    f2 = d.select(F.col("doc_id").alias("row_id"), F.col("n_chars").alias("description_n_chars"))
    return base.join(f1, "row_id").join(f2, "row_id")


@register("map_labels", sql=f"""WITH {LANG_TASK_SQL},
meta AS (SELECT row_id, lang, CASE split WHEN 'train' THEN 'train' WHEN 'valid' THEN 'test_train' ELSE 'test' END AS tag
         FROM lang_task JOIN documents ON doc_id = row_id),
ld AS (SELECT lang, CAST(row_number() OVER (ORDER BY min(row_id)) - 1 AS INTEGER) AS label_id FROM meta GROUP BY lang)
SELECT m.row_id, CASE WHEN instr(m.tag, 'test') > 0 THEN 'test' WHEN instr(m.tag, 'train') > 0 THEN 'train' END AS part,
ld.label_id FROM meta m JOIN ld ON m.lang = ld.lang""")
def map_labels(spark, sf_dir):
    """Label string -> id by first appearance; 'test' wins over 'train' in the tag."""
    lt = lang_task(spark, sf_dir).select("row_id", "split")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    meta = lt.join(d, "row_id").withColumn(
        "tag", F.when(F.col("split") == "train", "train").when(F.col("split") == "valid", "test_train")
        .otherwise("test"))
    first = meta.groupBy("lang").agg(F.min("row_id").alias("first"))
    ids = global_rank(first, ["first"], out="label_id").withColumn("label_id", F.col("label_id").cast("int"))
    part = F.when(F.instr("tag", "test") > 0, "test").when(F.instr("tag", "train") > 0, "train")
    # no hint: the planner knows the size of the label table when it runs
    return meta.join(ids.select("lang", "label_id"), "lang").select("row_id", part.alias("part"), "label_id")


@register("union_all", sql=f"""WITH {LANG_TASK_SQL}
SELECT row_id, split FROM lang_task WHERE split = 'train' UNION ALL
SELECT row_id, split FROM lang_task WHERE split = 'valid' UNION ALL SELECT row_id, split FROM lang_task WHERE split = 'test'
UNION ALL SELECT row_id, 'all' AS split FROM lang_task""")
def union_all(spark, sf_dir):
    lt = lang_task(spark, sf_dir).select("row_id", "split")
    parts = [lt.filter(F.col("split") == s) for s in ("train", "valid", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(lt.withColumn("split", F.lit("all")))


@register("corrupt_label", sql=f"WITH {noisy_train_sql()} SELECT row_id, y_clean, y, is_noisy FROM noisy")
def corrupt_label(spark, sf_dir):
    return noisy_train(spark, sf_dir).select("row_id", "y_clean", "y", "is_noisy")


@register("semi_noisy", sql=f"""WITH {noisy_train_sql()}
SELECT t.row_id, t.y FROM lang_task t SEMI JOIN (SELECT row_id FROM noisy WHERE is_noisy) n ON t.row_id = n.row_id""")
def semi_noisy(spark, sf_dir):
    nz = noisy_train(spark, sf_dir).filter("is_noisy").select("row_id")
    return lang_task(spark, sf_dir).select("row_id", "y").join(nz, "row_id", "left_semi")


@register("except_label", sql=f"""WITH {noisy_train_sql()}
SELECT row_id, y_clean, array_to_string(list_filter(cls.c, lambda x: x <> y_clean), ',') AS others FROM noisy, cls""")
def except_label(spark, sf_dir):
    nz = noisy_train(spark, sf_dir)
    classes = F.array(*[F.lit(k) for k in range(K_LANG)])
    return nz.select("row_id", "y_clean", F.array_join(F.array_except(classes, F.array("y_clean")), ",").alias("others"))


@register("intersect_ids", sql=f"""WITH {noisy_train_sql()},
low AS (SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {uniform_sql(7, 'row_id')}, row_id) AS r FROM noisy)
        WHERE r <= (SELECT floor(count(*) * 0.2) FROM noisy))
SELECT row_id FROM low INTERSECT SELECT row_id FROM noisy WHERE is_noisy""")
def intersect_ids(spark, sf_dir):
    nz = noisy_train(spark, sf_dir)
    n = nz.count()
    ranked = global_rank(nz.withColumn("value", uniform(7, "row_id")), ["value", "row_id"], out="r")
    low = ranked.filter(F.col("r") < int(n * 0.2)).select("row_id")
    return low.intersect(nz.filter("is_noisy").select("row_id"))


@register("split_sample", sql=f"""WITH {LANG_TASK_SQL},
tr AS (SELECT row_id FROM lang_task WHERE split = 'train'), te AS (SELECT row_id FROM lang_task WHERE split <> 'train'),
a AS (SELECT row_id, 'train' AS split FROM (SELECT row_id, row_number() OVER (ORDER BY {uniform_sql(SEED, 'row_id')}, row_id) AS r FROM tr) WHERE r <= 1000),
b AS (SELECT row_id, 'valid' AS split FROM (SELECT row_id, row_number() OVER (ORDER BY {uniform_sql(SEED + 1, 'row_id')}, row_id) AS r FROM te) WHERE r <= 400)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT row_id, 'test' AS split FROM te""")
def split_sample(spark, sf_dir, n_train: int = 1000, n_valid: int = 400):
    """train = n_train rows of the training part; valid = n_valid rows of the test
    part; test = the whole test part (so valid rows are also test rows)."""
    lt = lang_task(spark, sf_dir).select("row_id", "split")
    tr, te = lt.filter(F.col("split") == "train"), lt.filter(F.col("split") != "train")
    a = SM.shuffle_rank(tr, SEED, "row_id", "r").filter(F.col("r") < n_train).select("row_id", F.lit("train").alias("split"))
    b = SM.shuffle_rank(te, SEED + 1, "row_id", "r").filter(F.col("r") < n_valid).select("row_id", F.lit("valid").alias("split"))
    return a.unionByName(b).unionByName(te.select("row_id", F.lit("test").alias("split")))


@register("split_rates", sql=f"""SELECT * FROM (SELECT doc_id AS row_id, CASE WHEN u < 0.6 THEN 0 WHEN u < 0.8 THEN 1 WHEN u < 0.9 THEN 2 END AS part
FROM (SELECT doc_id, {uniform_sql(SEED + 5, 'doc_id')} AS u FROM documents)) WHERE part IS NOT NULL""")
def split_rates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"))
    p = SM.split_rates(uniform(SEED + 5, "row_id"), [0.6, 0.2, 0.1])
    return d.select("row_id", p.alias("part")).filter(F.col("part").isNotNull())


@register("split_valid", sql=f"""WITH {LANG_TASK_SQL}, tr AS (SELECT row_id FROM lang_task WHERE split = 'train'),
r AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS r0,
             row_number() OVER (ORDER BY {uniform_sql(SEED + 2, 'row_id')}, row_id) - 1 AS r1 FROM tr),
k AS (SELECT round_even(count(*) * (1 - 0.1), 0) AS n_train FROM tr)
SELECT row_id, CASE WHEN r0 < n_train THEN 'train' ELSE 'valid' END AS split,
CASE WHEN r1 < n_train THEN 'train' ELSE 'valid' END AS split_shuffled FROM r, k""")
def split_valid(spark, sf_dir, portion: float = 0.1):
    """First round(n * (1 - p)) rows are train (half to even), the rest valid;
    ``split_shuffled`` does the same after a seeded shuffle."""
    tr = lang_task(spark, sf_dir).filter(F.col("split") == "train").select("row_id")
    n = tr.count()
    import numpy as np
    n_train = int(np.round(n * (1.0 - portion)))
    r = SM.shuffle_rank(global_rank(tr, ["row_id"], out="r0"), SEED + 2, "row_id", "r1")
    return r.select("row_id", F.when(F.col("r0") < n_train, "train").otherwise("valid").alias("split"),
                    F.when(F.col("r1") < n_train, "train").otherwise("valid").alias("split_shuffled"))


@register("bernoulli_select", sql=f"""WITH {LANG_TASK_SQL}
SELECT row_id, {uniform_sql(SEED + 3, 'row_id')} < {uniform_sql(7, 'row_id')} AS keep FROM lang_task WHERE split = 'train'""")
def bernoulli_select(spark, sf_dir):
    tr = lang_task(spark, sf_dir).filter(F.col("split") == "train").select("row_id")
    return SM.bernoulli_select(tr.withColumn("prob", uniform(7, "row_id")), "prob", SEED + 3).select("row_id", "keep")


@register("sample_n", sql=f"""WITH {LANG_TASK_SQL}
SELECT row_id FROM lang_task ORDER BY {uniform_sql(SEED + 4, 'row_id')}, row_id LIMIT 100""")
def sample_n(spark, sf_dir, n: int = 100):
    lt = lang_task(spark, sf_dir).select("row_id")
    return lt.orderBy(uniform(SEED + 4, "row_id"), "row_id").limit(n)
