"""Readers and writers with explicit schemas.

No schema inference anywhere: JSON lines are read FAILFAST with a declared
schema, text formats are split with native expressions, and every reader
returns a lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import normalise, profile
from tessera.operators.links import extract_links, link_target, title_map
from tessera.operators.text_ops import section_text

ARTICLE_SCHEMA = T.StructType([
    T.StructField("qid", T.StringType()), T.StructField("entitle", T.StringType()),
    T.StructField("wikitext", T.StringType()),
    T.StructField("mid_level_categories", T.ArrayType(T.StringType()))])

INLINKS_SCHEMA = T.StructType([
    T.StructField("qid", T.StringType()), T.StructField("entitle", T.StringType()),
    T.StructField("rid", T.LongType()), T.StructField("pid", T.LongType()),
    T.StructField("inlinks", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("mid_level_categories", T.ArrayType(T.StringType()))])


def read_articles(spark: SparkSession, path: str, *, lang: str = "en", key_col: str = "qid",
                  extract_title: bool = True, extract_tokens: bool = True, extract_categories: bool = True,
                  extract_section: bool = False, extract_outlinks: bool = False,
                  tokens_from_sections: bool = False, stop_lists: dict | None = None) -> DataFrame:
    """One JSON article per line -> parsed article (QID, title,
    tokens, mid_level_categories, sections_tokens, raw_outlinks, outlinks);
    the flags only choose columns (Catalyst prunes the rest).  ``key_col``
    accepts the older 'QID' key; ``tokens_from_sections`` is the older
    variant that tokenises the headings instead of the text; ``stop_lists``
    replaces a language's stop words ({"hi": read_stopwords(...)}).  An
    unknown language raises."""
    profile(lang)
    schema = T.StructType([T.StructField(key_col, T.StringType())] +
                          [f for f in ARTICLE_SCHEMA.fields if f.name != "qid"])
    raw = (spark.read.schema(schema).option("mode", "FAILFAST").json(path)
           .withColumn("__lang", F.lit(lang)))
    raw = raw.withColumn("__sections", section_text(F.col("wikitext"), html=False))
    cols = [F.col(key_col).alias("QID")]
    df = raw
    if extract_tokens:
        df = normalise(df, "__sections" if tokens_from_sections else "wikitext", "__lang", "tokens",
                       langs=(lang,), stop_lists=stop_lists)
    if extract_section:
        df = normalise(df, "__sections", "__lang", "sections_tokens", langs=(lang,), stop_lists=stop_lists)
    if extract_title:
        cols.append(F.col("entitle").alias("title"))
    if extract_tokens:
        cols.append("tokens")
    if extract_categories:
        cols.append("mid_level_categories")
    if extract_section:
        cols.append("sections_tokens")
    if extract_outlinks:
        cols.append(extract_links("wikitext").alias("raw_outlinks"))
        cols.append(F.transform(extract_links("wikitext"), link_target).alias("outlinks"))
    return df.select(*cols)


def read_inlinks(spark: SparkSession, path: str) -> DataFrame:
    """S3: inlinks JSON lines -> long form (qid, title, pos, pid, ns) plus the
    article columns; positional [pid, namespace] pairs become columns."""
    raw = spark.read.schema(INLINKS_SCHEMA).option("mode", "FAILFAST").json(path)
    return raw.select(F.col("qid"), F.col("entitle").alias("title"), "mid_level_categories",
                      F.posexplode("inlinks").alias("pos", "__pair")).select(
        "qid", "title", "mid_level_categories", "pos",
        F.col("__pair")[0].alias("pid"), F.col("__pair")[1].cast("int").alias("ns"))


def read_title_map(spark: SparkSession, path: str) -> DataFrame:
    """title<TAB>page_id text files (bz2 is splittable), malformed lines
    skipped, last line wins."""
    return title_map(spark.read.text(path))


def read_stopwords(spark: SparkSession, path: str, max_words: int = 100_000) -> tuple:
    """S8 file form: one stop word per line, blank lines dropped (e.g. the
    Hindi list, which Spark has no default for).  A stop list is a small
    parameter: it is size-checked, then returned to the driver to become a
    literal set inside the normalisation expression."""
    words = spark.read.text(path).select(F.trim("value").alias("w")).filter(F.col("w") != "").distinct()
    n = words.count()
    if n > max_words:
        raise ValueError(f"{n} stop words exceed {max_words}")
    return tuple(sorted(r["w"] for r in words.collect()))


def read_word_vectors(spark: SparkSession, path: str, has_header: bool = True) -> DataFrame:
    """fastText text vectors -> (word, vec ARRAY<FLOAT>).  The header
    'n d' gives d, without one the most frequent length is d; any line whose
    vector length is not d (the header itself, when a reader forgets to
    consume it), or with a component that is no number, is dropped.  The last occurrence of
    a word wins."""
    lines = spark.read.text(path).select(
        F.split(F.rtrim("value"), " ").alias("__f"), F.input_file_name().alias("__file"),
        F.input_file_block_start().alias("__block"), F.monotonically_increasing_id().alias("__line"))
    if has_header:
        d = lines.filter(F.size("__f") == 2).orderBy("__file", "__block", "__line").select(
            F.col("__f")[1].cast("int")).limit(1).scalar()
    else:
        d = lines.select(F.mode(F.size("__f")) - 1).scalar()
    rows = lines.filter(F.size("__f") == d + 1).select(
        F.col("__f")[0].alias("word"),
        F.transform(F.slice("__f", 2, F.size("__f") - 1), lambda x: x.try_cast("float")).alias("vec"),
        F.struct("__file", "__block", "__line").alias("__order")).filter(~F.exists("vec", F.isnull))
    return rows.groupBy("word").agg(F.max_by("vec", "__order").alias("vec"))


def write_word_vectors(df: DataFrame, path: str) -> None:
    """fastText text layout: a header line 'n d' with the true numbers, then
    one 'word v1 ... vd' line per word in word order.  Every task writes its
    range of words as a part file; the parts in the order of their names are
    the file that other readers of the format take (the header is the first
    line of the first part).  Spark's committer shows all parts or none."""
    size = df.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    spark = df.sparkSession
    head = spark.createDataFrame([(0, "", f"{size[0]} {size[1] or 0}")], "part int, word string, value string")
    body = df.select(F.lit(1).alias("part"), "word", F.concat_ws(" ", "word", F.transform("vec", lambda x: x.cast("string"))).alias("value"))
    head.unionByName(body).orderBy("part", "word").select("value").write.mode("overwrite").text(path)


def write_partitioned(df: DataFrame, path: str, cols=("lang", "split")) -> None:
    """Artifact store as Parquet partitioned by language and split."""
    df.write.mode("overwrite").partitionBy(*cols).parquet(path)
