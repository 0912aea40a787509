"""Source / sink queries.

Each writes a file in the reference's format from a driver table into a
fresh folder below the shared checkpoint folder, then reads it back with
the library's reader, so the reader is exercised end to end on the whole
table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.functions.text import normalise
from tessera.operators.splits import split_80_10_10
from tessera.plans import views as V
from tessera.plans.catalog import register
from tessera.plans.q_links import H1_RE
from tessera.plans.q_vocab import _SPLIT_SQL
from tessera.session import read_table, scratch_path
from tessera.sources import readers as rd


@register("src_articles_jsonl", """
SELECT CAST(id AS VARCHAR) AS QID, 'Doc ' || CAST(id AS VARCHAR) AS title, toks AS tokens,
       cats AS mid_level_categories FROM article_tokens
""", ["article_tokens"])
def src_articles_jsonl(spark, sf):
    """Articles written as JSON lines (qid, entitle, wikitext,
    mid_level_categories) and parsed back by the reader."""
    a = V.articles(spark, sf)
    path = scratch_path(spark, "articles")
    (a.select(F.col("id").cast("string").alias("qid"), F.concat(F.lit("Doc "), F.col("id").cast("string")).alias("entitle"),
              F.col("text").alias("wikitext"), F.col("cats").alias("mid_level_categories"), "lang")
     .write.mode("overwrite").partitionBy("lang").json(path))
    langs = sorted(r[0] for r in a.select("lang").distinct().collect())      # languages, not articles
    return reduce(lambda x, y: x.unionByName(y), [rd.read_articles(spark, f"{path}/lang={x}", lang=x) for x in langs])


@register("src_articles_flags")
def src_articles_flags(spark, sf):
    """The older format (QID key) with every flag: headings (with a
    trailing comment) and raw outlinks next to their targets."""
    p = V.outlinks(spark, sf).join(read_table(spark, sf, "pages").select("page_id", F.regexp_extract("html", H1_RE, 1).alias("h")), "page_id")
    path = scratch_path(spark, "older")
    (p.select(F.col("page_id").cast("string").alias("QID"), F.lit("t").alias("entitle"),
              F.concat(F.lit("== "), "h", F.lit(" == <!-- x -->\n"), "raw").alias("wikitext"),
              F.array().cast("array<string>").alias("mid_level_categories"))
     .write.mode("overwrite").json(path))
    return rd.read_articles(spark, path, lang="en", key_col="QID", extract_tokens=False, extract_categories=False,
                            extract_section=True, extract_outlinks=True).select("QID", "sections_tokens", "raw_outlinks", "outlinks")


@register("src_inlinks", """
SELECT CAST(l_orderkey AS VARCHAR) AS qid, CAST(row_number() OVER (PARTITION BY l_orderkey
       ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS pos, l_partkey AS pid, l_linenumber - 1 AS ns
FROM lineitem
""")
def src_inlinks(spark, sf):
    """S3: inlinks JSON lines ([pid, namespace] pairs per article) read
    back into long form."""
    li = read_table(spark, sf, "lineitem")
    per = (li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey"))).alias("s"))
        .select(F.col("l_orderkey").cast("string").alias("qid"), F.lit("t").alias("entitle"),
                F.lit(0).cast("long").alias("rid"), F.col("l_orderkey").alias("pid"),
                F.transform("s", lambda x: F.array(x["l_partkey"], (x["l_linenumber"] - 1).cast("long"))).alias("inlinks"),
                F.array().cast("array<string>").alias("mid_level_categories")))
    path = scratch_path(spark, "inlinks")
    per.write.mode("overwrite").json(path)
    return rd.read_inlinks(spark, path).select("qid", "pos", "pid", "ns")


@register("src_title_map", f"""
SELECT lower(substr(w, 1, 1)) || substr(w, 2) AS title, arg_max(CAST(page_id AS VARCHAR), page_id) AS page_id
FROM (SELECT page_id, string_split(regexp_extract(html, '{H1_RE}', 1), ' ')[1] AS w FROM pages) GROUP BY 1
""")
def src_title_map(spark, sf):
    """A bz2 TSV title map (one malformed line per ten pages) read back:
    malformed lines skipped, first letter lowered, last line wins."""
    p = read_table(spark, sf, "pages").select(
        "page_id", F.split(F.regexp_extract("html", H1_RE, 1), " ").getItem(0).alias("w"))
    lines = p.select("page_id", F.concat_ws("\t", "w", F.col("page_id").cast("string")).alias("value")).unionByName(
        p.filter(F.col("page_id") % 10 == 0).select("page_id", F.concat(F.lit("broken line "), F.col("page_id").cast("string")).alias("value")))
    path = scratch_path(spark, "titles")
    lines.orderBy("page_id", "value").select("value").write.mode("overwrite").option("compression", "bzip2").text(path)
    return rd.read_title_map(spark, path)


@register("src_word_vectors", "SELECT word, vec FROM wvec", ["wvec"])
def src_word_vectors(spark, sf):
    """Vectors written in the fastText text layout and read back."""
    wv = V.wvec(spark, sf)
    path = scratch_path(spark, "vectors")
    rd.write_word_vectors(wv, path)
    return rd.read_word_vectors(spark, path)


@register("src_word_vectors_noheader", "SELECT word, vec FROM wvec", ["wvec"])
def src_word_vectors_noheader(spark, sf):
    """The variant that does not consume the header -- the header line
    has the wrong vector length and is filtered out."""
    wv = V.wvec(spark, sf)
    path = scratch_path(spark, "vectors")
    rd.write_word_vectors(wv, path)
    return rd.read_word_vectors(spark, path, has_header=False)


@register("src_point_lookup", """
SELECT d.doc_id AS id, d.text, t.toks FROM documents d JOIN tokens t ON d.doc_id = t.id WHERE d.doc_id = 7
""", ["tokens"])
def src_point_lookup(spark, sf):
    """S9 + T18: one article by key (early exit), raw next to cleaned."""
    d = read_table(spark, sf, "documents").filter(F.col("doc_id") == 7).limit(1)
    return normalise(d.select(F.col("doc_id").alias("id"), "lang", "text"), "text", "lang", "toks",
                     keep_cols=["id", "text"])


@register("src_debug_sample", "SELECT doc_id AS id, lang FROM documents ORDER BY doc_id LIMIT 6")
def src_debug_sample(spark, sf):
    """The debug sample -- the first six articles (explicit order)."""
    return read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang").orderBy("id").limit(6)


@register("sink_split_parquet", _SPLIT_SQL + """
SELECT t.id, t.toks FROM tokens t JOIN split s USING (id) WHERE t.lang = 'en' AND s.split = 'val'
""", ["tokens"])
def sink_split_parquet(spark, sf):
    """Token table written partitioned by (lang, split); one partition
    read back through partition pruning."""
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    s = split_80_10_10(docs, "id", seed=1)
    t = V.tokens(spark, sf).join(s, "id")
    path = scratch_path(spark, "splits")
    rd.write_partitioned(t, path, ("lang", "split"))
    back = spark.read.parquet(path)
    return back.filter((F.col("lang") == "en") & (F.col("split") == "val")).select("id", "toks")
