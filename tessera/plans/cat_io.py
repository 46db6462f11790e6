"""Catalogue: sources and sinks as round trips. Whole tables are written to a fresh
run folder under the shared checkpoint folder and read back; the oracle is the
plain table expression."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import uniform, uniform_sql
from ..operators import vocab as V
from ..operators.tokens import explode_tokens, nested_lists
from ..sources import readers as RD
from ..sources import writers as W
from ..tables import spread, table
from .registry import register
from .cat_vocab import _NESTED_SQL
from .documents import clean_document_sql
from .tasks import CORPUS_TOKENS_SQL, LANG_TASK_SQL, WORD_VECTORS_SQL, lang_task, word_vectors

CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
ORDERS_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"


def _run(spark, name):
    return W.run_dir(spark, f"{name}-{uuid.uuid4().hex[:10]}")


@register("read_tabular", sql="SELECT * FROM customer")
def read_tabular(spark, sf_dir):
    """Headerless CSV with hand-named columns; a second copy with a title line that
    the reader skips."""
    run = _run(spark, "tabular")
    c = table(spark, sf_dir, "customer")
    c.write.mode("overwrite").option("header", False).csv(f"{run}/plain")
    c.write.mode("overwrite").option("header", True).csv(f"{run}/titled")
    a = RD.read_tabular(spark, f"{run}/plain", CUSTOMER_SCHEMA)
    b = RD.read_tabular(spark, f"{run}/titled", CUSTOMER_SCHEMA, skip_first_line=True)
    return a.join(b.select("c_custkey"), "c_custkey", "left_semi")


@register("read_many", sql="SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority AS source FROM orders")
def read_many(spark, sf_dir):
    """One CSV folder per priority value, read back as one table with the folder as
    the source column."""
    run = _run(spark, "many")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                              "o_orderpriority")
    o.write.mode("overwrite").partitionBy("o_orderpriority").option("header", False).csv(run)
    df = RD.read_many(spark, f"{run}/*/*.csv", ORDERS_SCHEMA, r"o_orderpriority=([^/]+)/")
    return df.withColumn("source", F.regexp_replace(F.expr("url_decode(source)"), r"\+", " "))


@register("read_tsv_text", sql=f"""WITH {LANG_TASK_SQL}
SELECT y AS label, {T.clean_simple_sql('text')} AS text_all FROM lang_task""")
def read_tsv_text(spark, sf_dir):
    run = _run(spark, "tsv")
    lt = lang_task(spark, sf_dir).select(F.col("y").alias("label"), T.clean_simple("text").alias("text_all"))
    lt.write.mode("overwrite").option("sep", "\t").option("quote", "").option("escape", "").csv(run)
    return RD.read_tsv_text(spark, run)


@register("read_multisep", sql=f"""WITH {LANG_TASK_SQL}
SELECT CAST(y AS INTEGER) AS label, lang AS title, {T.clean_simple_sql('l.text')} || '"' AS description
FROM lang_task l JOIN documents d ON d.doc_id = l.row_id""")
def read_multisep(spark, sf_dir):
    """Lines ``"label","title","description"`` read with the 3-character separator;
    the label loses its leading quote (shift_label) and the last field keeps its
    trailing quote."""
    run = _run(spark, "multisep")
    d = table(spark, sf_dir, "documents")
    lt = lang_task(spark, sf_dir).join(d.select(F.col("doc_id").alias("row_id"), "lang"), "row_id")
    line = F.concat(F.lit('"'), (F.col("y") + 1).cast("string"), F.lit('","'), F.col("lang"), F.lit('","'),
                    T.clean_simple("text"), F.lit('"'))
    lt.select(line.alias("value")).write.mode("overwrite").text(run)
    raw = RD.read_multisep(spark, run, "label string, title string, description string")
    from ..operators.recode import shift_label
    return raw.select(shift_label("label").alias("label"), "title", "description")


_VOCAB_Q = ("voc AS (SELECT word, n, CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS word_id FROM "
            "(SELECT word, count(*) AS n FROM ent GROUP BY word ORDER BY n DESC, word LIMIT 800))")
_ENT = (f"ent AS (SELECT doc_id, unnest({T.tokenize_en_sql('text')}) AS word FROM documents)")


def _vocab800(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    toks = explode_tokens(d.select("doc_id", T.tokenize_en("text").alias("t")), "doc_id", "t")
    return V.build_vocab(toks, 800)


@register("read_vocab", sql=f"""WITH {_ENT}, {_VOCAB_Q}
SELECT word, word_id + 1 AS line_id, word_id AS file_id FROM voc""")
def read_vocab(spark, sf_dir):
    """Vocabulary written one word per line and as ``word<TAB>id``; ids read back
    from the line number (from 1) and from the second field."""
    run = _run(spark, "vocab")
    v = _vocab800(spark, sf_dir)
    v.orderBy("word_id").select("word").write.mode("overwrite").text(f"{run}/lines")
    v.orderBy("word_id").select(F.concat_ws("\t", "word", F.col("word_id").cast("string"))).write.mode(
        "overwrite").text(f"{run}/pairs")
    a = RD.read_vocab(spark, f"{run}/lines").withColumnRenamed("word_id", "line_id")
    b = RD.read_vocab(spark, f"{run}/pairs", with_ids=True).withColumnRenamed("word_id", "file_id")
    return a.join(b, "word")


@register("read_word_vectors", sql=f"""WITH {CORPUS_TOKENS_SQL}, {WORD_VECTORS_SQL}
SELECT word, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS dim, round(CAST(unnest(vec) AS DOUBLE), 6) AS v FROM wv""")
def read_word_vectors(spark, sf_dir):
    """Word-vector text file with an ``n d`` title line."""
    run = _run(spark, "vectors")
    wv = word_vectors(spark, sf_dir)
    n = wv.count()
    body = wv.orderBy("vec_id").select(F.concat_ws(" ", "word", F.array_join(F.col("vec").cast("array<string>"), " "))
                                       .alias("value"))
    head = spark.range(1).select(F.lit(f"{n} 64").alias("value"))
    head.write.mode("overwrite").text(f"{run}/a_head")
    body.write.mode("overwrite").text(f"{run}/b_body")
    back = RD.read_word_vectors(spark, f"{run}/*", header=True)
    return back.select("word", F.posexplode("vec").alias("dim", "v")).withColumn("v", F.round(F.col("v").cast("double"), 6))


@register("read_aligned", sql=f"""WITH {LANG_TASK_SQL}
SELECT CAST(y AS VARCHAR) AS label, {T.clean_simple_sql('text')} AS text, CAST(row_id AS VARCHAR) || '\t' || split || '\t' || CAST(y AS VARCHAR) AS meta
FROM lang_task""")
def read_aligned(spark, sf_dir):
    """Three line-aligned files (labels, texts, name<TAB>split<TAB>label) zipped by line."""
    run = _run(spark, "aligned")
    lt = lang_task(spark, sf_dir).orderBy("row_id")
    lt.select(F.col("y").cast("string")).write.mode("overwrite").text(f"{run}/labels")
    lt.select(T.clean_simple("text")).write.mode("overwrite").text(f"{run}/text")
    lt.select(F.concat_ws("\t", F.col("row_id").cast("string"), "split", F.col("y").cast("string"))) \
        .write.mode("overwrite").text(f"{run}/meta")
    out = RD.read_aligned(spark, {"label": f"{run}/labels", "text": f"{run}/text", "meta": f"{run}/meta"})
    return out.drop("line")


@register("read_splits", sql=f"WITH {LANG_TASK_SQL} SELECT row_id, y, split FROM lang_task WHERE split IN ('train', 'valid')")
def read_splits(spark, sf_dir):
    """Split table written partitioned by split; reading two splits prunes the third folder."""
    run = _run(spark, "splits")
    W.write_splits(lang_task(spark, sf_dir).select("row_id", "y", "split"), run)
    return RD.read_splits(spark, run, ["train", "valid"]).select("row_id", "y", "split")


@register("read_matrix", sql="""SELECT vec_id AS row_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS k,
round(CAST(unnest(embedding) AS DOUBLE), 6) AS v, CAST(label AS DOUBLE) AS label FROM embeddings""")
def read_matrix(spark, sf_dir):
    """Embedding matrix written as comma lines (write_matrix) and labels one per
    line, read back and aligned by line number."""
    run = _run(spark, "matrix")
    e = table(spark, sf_dir, "embeddings").orderBy("vec_id")
    e2 = e.select("vec_id", "label", *[F.col("embedding")[i].alias(f"f{i}") for i in range(64)])
    W.write_matrix(e2, [f"f{i}" for i in range(64)], f"{run}/x")
    W.write_matrix(e2, ["label"], f"{run}/y")
    W.write_matrix(e2, ["vec_id"], f"{run}/ids")
    x = RD.read_matrix(spark, f"{run}/x", "float")
    y = RD.read_vector(spark, f"{run}/y", "double").withColumnRenamed("value", "label")
    ids = RD.read_vector(spark, f"{run}/ids", "bigint").withColumnRenamed("value", "row_id")
    j = x.join(y, "line").join(ids, "line")
    return j.select("row_id", F.posexplode("values").alias("k", "v"), "label").withColumn(
        "v", F.round(F.col("v").cast("double"), 6))


@register("read_corpus", sql=f"""WITH {clean_document_sql()}, {LANG_TASK_SQL},
meta AS (SELECT l.row_id + 1 AS doc_id, l.split, d.lang FROM lang_task l JOIN documents d ON d.doc_id = l.row_id),
lab AS (SELECT lang, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) AS label_id FROM meta GROUP BY lang),
av AS (SELECT word, CAST(row_number() OVER (ORDER BY word) AS INTEGER) AS word_id FROM (SELECT DISTINCT word FROM cd_tokens)),
ei AS (SELECT t.doc_id + 1 AS doc_id, t.sent, t.pos, av.word_id AS id FROM cd_tokens t JOIN av ON t.word = av.word), {_NESTED_SQL}
SELECT m.doc_id, CASE WHEN instr(m.split, 'test') > 0 THEN 'test' WHEN instr(m.split, 'train') > 0 THEN 'train' ELSE 'other' END AS part,
lab.label_id, coalesce(dn.ids, '[]') AS ids FROM meta m JOIN lab ON lab.lang = m.lang LEFT JOIN dn ON dn.doc_id = m.doc_id""")
def read_corpus(spark, sf_dir):
    """Corpus lines + meta lines (name, split, label): clean, build the vocabulary,
    encode; labels get ids by first appearance and 'test' wins over 'train'."""
    from ..operators.ranking import global_rank
    from .documents import clean_document, clean_vocab, encoded_documents
    run = _run(spark, "corpus")
    lt = lang_task(spark, sf_dir).orderBy("row_id")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    lt = lt.join(d, "row_id").orderBy("row_id")
    lt.select(T.clean_simple("text")).write.mode("overwrite").text(f"{run}/corpus")
    lt.select(F.concat_ws("\t", F.col("row_id").cast("string"), "split", "lang")).write.mode("overwrite").text(f"{run}/meta")
    al = RD.read_aligned(spark, {"text": f"{run}/corpus", "meta": f"{run}/meta"})
    m = F.split("meta", "\t")
    al = al.select(F.col("line").alias("doc_id"), "text", m[1].alias("split"), m[2].alias("label"))
    cc = clean_document(al.select("doc_id", "text"))
    enc = encoded_documents(cc, clean_vocab(cc)).filter(F.size("ids") > 0)
    first = al.groupBy("label").agg(F.min("doc_id").alias("f"))
    lab = global_rank(first, ["f"], out="label_id").select("label", F.col("label_id").cast("int"))
    nested = nested_lists(enc).select("doc_id", V.printed("ids").alias("ids"))
    part = F.when(F.instr("split", "test") > 0, "test").when(F.instr("split", "train") > 0, "train").otherwise("other")
    return al.join(lab, "label").join(nested, "doc_id", "left").select(
        "doc_id", part.alias("part"), "label_id", F.coalesce("ids", F.lit("[]")).alias("ids"))


@register("write_map_csv", sql="""WITH t AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY word)
SELECT word, CAST(n AS VARCHAR) AS n, '"' || word || '"' AS quoted FROM t""")
def write_map_csv(spark, sf_dir):
    """A word -> count map written with every field quoted and read back as text
    (fields as written, quotes included) and as CSV."""
    run = _run(spark, "mapcsv")
    p = table(spark, sf_dir, "part")
    m = p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).cast("string").alias("n"))
    W.write_map_csv(m, run)
    back = spark.read.option("header", True).csv(run)
    raw = spark.read.text(run).filter(~F.col("value").startswith('"word"'))
    q = raw.select(F.split("value", ",")[0].alias("quoted"), F.regexp_replace(F.split("value", ",")[0], '"', "").alias("word"))
    return back.join(q, "word")


@register("write_matrix", sql="""SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem""")
def write_matrix(spark, sf_dir):
    """Rows written as comma-joined numbers (overwrite with one block of rows, then append
    of the other) and parsed back."""
    run = _run(spark, "wmatrix")
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"]
    li = table(spark, sf_dir, "lineitem").select(*cols)
    W.write_matrix(li.filter("l_linenumber <= 2"), cols, run, mode="overwrite")
    W.write_matrix(li.filter("l_linenumber > 2"), cols, run, mode="append")
    back = spark.read.text(run).select(F.split("value", ",").alias("a"))
    return back.select(F.col("a")[0].cast("bigint").alias("l_orderkey"), F.col("a")[1].cast("int").alias("l_linenumber"),
                       F.col("a")[2].cast("double").alias("l_quantity"), F.col("a")[3].cast("double").alias("l_discount"))


@register("write_splits", sql=f"WITH {LANG_TASK_SQL} SELECT row_id, y, split FROM lang_task")
def write_splits_q(spark, sf_dir):
    run = _run(spark, "wsplits")
    W.write_splits(lang_task(spark, sf_dir).select("row_id", "y", "split"), run)
    return RD.read_splits(spark, run).select("row_id", "y", "split")


@register("write_label_text", sql=f"""WITH {LANG_TASK_SQL}
SELECT split, CAST(y AS INTEGER) AS label, {T.clean_simple_sql('text')} AS text FROM lang_task""")
def write_label_text(spark, sf_dir):
    run = _run(spark, "labeltext")
    lt = lang_task(spark, sf_dir).select("split", F.col("y").alias("label"), T.clean_simple("text").alias("text"))
    W.write_label_text(lt, run)
    back = (spark.read.schema("label int, text string").option("sep", "\t").option("quote", "")
            .csv(f"{run}/split=*").withColumn("split", F.regexp_extract(F.col("_metadata.file_path"), r"split=([^/]+)/", 1)))
    return back.select("split", "label", "text")


@register("write_values", sql=f"""WITH {LANG_TASK_SQL}
SELECT row_id, round({uniform_sql(7, 'row_id')}, 6) AS data_value FROM lang_task WHERE split = 'train'""")
def write_values_q(spark, sf_dir):
    """Values stored as a table and read back (stored deterministic values)."""
    run = _run(spark, "values")
    tr = lang_task(spark, sf_dir).filter(F.col("split") == "train")
    W.write_values(tr.select("row_id", F.round(uniform(7, "row_id"), 6).alias("data_value")), run)
    return spark.read.parquet(run)


@register("write_predictions", sql=f"""WITH {LANG_TASK_SQL}
SELECT row_id, CAST(y AS INTEGER) AS prediction, {T.clean_simple_sql('text')} AS raw_text FROM lang_task WHERE split = 'test'""")
def write_predictions_q(spark, sf_dir):
    """Raw text and prediction written as CSV (quoted, so commas and quotes in the
    text survive) and read back."""
    run = _run(spark, "preds")
    lt = lang_task(spark, sf_dir).filter(F.col("split") == "test")
    W.write_predictions(lt.select("row_id", F.col("y").alias("prediction"), T.clean_simple("text").alias("raw_text")), run)
    return (spark.read.schema("row_id bigint, prediction int, raw_text string").option("header", True)
            .option("escape", '"').csv(run))
