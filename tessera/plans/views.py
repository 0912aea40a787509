"""Canonical views over the driver tables, in Spark and in DuckDB SQL.

articles(id, lang, text, cats)   documents LEFT JOIN labels; cats is empty when
                                 no label row exists
tokens(id, lang, toks)           normalised documents
aligned(key, part, row_id)       events: user_id shared across five "languages"
inlinks(qid, pos, pid, ns)       lineitem in long form (one row per link)
outlinks(page_id, lang, raw)     pages with anchors rewritten as [[target|anchor]]
                                 plus the page url as a namespaced link
wvec(word, vec)                  n-th word of the sorted English vocabulary <->
                                 embeddings.vec_id = n
scores(id, class_idx, class, score, y)  deterministic scores for labelled
                                 articles, one row per (article, class)
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalise
from tessera.operators.labels import class_table
from tessera.operators.lookup import word_occurrences
from tessera.operators.vocab import build_vocab, vocab_per_group
from tessera.plans import sqlgen
from tessera.session import materialize, read_table, spread


def _t(spark, sf, name):
    return read_table(spark, sf, name)


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

def category_list(doc_id, quality, toxic, source):
    """Categories of the test corpus: Quality.high|low, Safety.toxic when
    toxic, Source.<source>; an empty list when the document has no label
    row."""
    cats = F.filter(F.array(
        F.when(F.col(quality) == 1, F.lit("Quality.high")).otherwise(F.lit("Quality.low")),
        F.when(F.col(toxic) == 1, F.lit("Safety.toxic")),
        F.concat(F.lit("Source."), F.col(source))), lambda x: x.isNotNull())
    return F.when(F.col(doc_id).isNull(), F.array().cast("array<string>")).otherwise(cats)


def articles(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text", "source")
    lab = _t(spark, sf, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, d.id == lab.doc_id, "left")
    return j.select("id", "lang", "text", category_list("doc_id", "quality", "toxic", "source").alias("cats"))


def tokens_fresh(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised documents, computed from the raw text (lazy)."""
    d = spread(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text"))
    return normalise(d, "text", "lang", "toks", keep_cols=["id", "lang"])


_SHARED: dict = {}


def _identity(spark: SparkSession, sf: str, names=("documents", "labels", "embeddings")) -> tuple:
    """Names, lengths and times of the files behind the shared tables."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for n in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf}/{n}.parquet")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            out += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)]
    return tuple(sorted(out))


def _shared(spark: SparkSession, name: str, sf: str, build, sources=("documents", "labels", "embeddings")):
    """Materialise a derived table once per application and state of the
    input files (written as Parquet below the shared checkpoint folder) --
    the token table feeds most queries, so it is normalised once, as the
    reference pickles its token tables once.  Files that change make a new
    table."""
    k = (spark.sparkContext.applicationId, name, sf, _identity(spark, sf, sources))
    if k not in _SHARED:
        _SHARED[k] = materialize(build(), name)
    return _SHARED[k]


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _shared(spark, "tokens", sf, lambda: tokens_fresh(spark, sf))


def frequent_words(spark: SparkSession, sf: str) -> DataFrame:
    """(lang, word, n): words frequent enough to be looked up by broadcast."""
    return _shared(spark, "frequent_words", sf, lambda: word_occurrences(tokens(spark, sf), "toks", ["lang"]))


def article_tokens(spark: SparkSession, sf: str) -> DataFrame:
    def build():
        lab = articles(spark, sf).select("id", "cats")
        return tokens(spark, sf).join(lab, "id").select("id", "lang", "cats", "toks")
    return _shared(spark, "article_tokens", sf, build)


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select(F.col("user_id").alias("key"),
                                         F.col("event_type").alias("part"),
                                         F.col("event_id").alias("row_id"))


def inlinks(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("pos"),
        F.col("l_partkey").alias("pid"), (F.col("l_linenumber") - 1).alias("ns"))


ANCHOR_RE = r'<a href="/?([^"]*)">([^<]*)</a>'
PAGE_LANG_RE = r'<html lang="([a-z]+)"'


def outlinks(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "pages")
    raw = F.concat(F.lit("[["), F.col("url"), F.lit("]] "),
                   F.regexp_replace("html", ANCHOR_RE, "[[$1|$2]]"))
    return p.select("page_id", F.regexp_extract("html", PAGE_LANG_RE, 1).alias("lang"), raw.alias("raw"))


def english_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted English vocabulary with dense ids (shared like the tokens)."""
    return _shared(spark, "english_vocab", sf, lambda: build_vocab(tokens(spark, sf).filter(F.col("lang") == "en"), "toks"))


def lang_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """(lang, word, idx): each language's sorted vocabulary with dense ids."""
    return _shared(spark, "lang_vocab", sf, lambda: vocab_per_group(tokens(spark, sf), "lang", "toks", prefix=()))


def wvec(spark: SparkSession, sf: str) -> DataFrame:
    v = english_vocab(spark, sf)
    e = _t(spark, sf, "embeddings").select("vec_id", "embedding")
    return v.join(e, v.idx == e.vec_id, "inner").select("word", F.col("embedding").alias("vec"))


def lang_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(lang, word, vec): the n-th word of each language's sorted vocabulary
    <-> embeddings.vec_id = n (a second language table for stacking and
    summing vectors)."""
    v = lang_vocab(spark, sf)
    e = _t(spark, sf, "embeddings").select("vec_id", "embedding")
    return v.join(e, v.idx == e.vec_id, "inner").select("lang", "word", F.col("embedding").alias("vec"))


def score_expr(id_col, class_idx_col):
    return ((F.col(id_col) * 37 + F.col(class_idx_col) * 11) % 100) / F.lit(100.0)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf).filter(F.size("cats") > 0).select("id", "cats")
    classes = class_table(a, "cats")
    return (classes.expand(a, "cats")
            .select("id", "class_idx", "class", score_expr("id", "class_idx").alias("score"), "y"))


# ---------------------------------------------------------------------------
# DuckDB side (same definitions)
# ---------------------------------------------------------------------------

SQL_CATS = ("CASE WHEN l.doc_id IS NULL THEN []::VARCHAR[] ELSE list_filter(["
            "CASE WHEN l.quality = 1 THEN 'Quality.high' ELSE 'Quality.low' END, "
            "CASE WHEN l.toxic = 1 THEN 'Safety.toxic' END, 'Source.' || d.source], "
            "lambda x: x IS NOT NULL) END")


@lru_cache(maxsize=None)
def sql_views() -> dict[str, tuple[tuple[str, ...], str]]:
    """name -> (names it needs, CTE)."""
    nz, nz_final = sqlgen.normalise_ctes(
        "(SELECT doc_id AS id, lang, text FROM documents)", "id", "text", "lang", ["id", "lang"],
        out="toks", prefix="tk")
    at, at_final = sqlgen.normalise_ctes(
        "articles", "id", "text", "lang", ["id", "lang", "cats"], out="toks", prefix="atk")

    return {
        "articles": ((), f"articles AS (SELECT d.doc_id AS id, d.lang, d.text, {SQL_CATS} AS cats "
                         "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"),
        "tokens": ((), nz + f",\ntokens AS (SELECT * FROM {nz_final})"),
        "article_tokens": (("articles",), at + f",\narticle_tokens AS (SELECT * FROM {at_final})"),
        "aligned": ((), "aligned AS (SELECT user_id AS key, event_type AS part, event_id AS row_id FROM events)"),
        "inlinks": ((), "inlinks AS (SELECT l_orderkey AS qid, l_linenumber AS pos, l_partkey AS pid, "
                        "l_linenumber - 1 AS ns FROM lineitem)"),
        "outlinks": ((), "outlinks AS (SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, "
                         "'[[' || url || ']] ' || regexp_replace(html, '<a href=\"/?([^\"]*)\">([^<]*)</a>', "
                         "'[[\\1|\\2]]', 'g') AS raw FROM pages)"),
        "lang_vocab": (("tokens",), "lang_vocab AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY word) - 1 AS idx "
                                    "FROM (SELECT DISTINCT lang, unnest(toks) AS word FROM tokens))"),
        "english_vocab": (("tokens",), "english_vocab AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx "
                                       "FROM (SELECT DISTINCT unnest(toks) AS word FROM tokens WHERE lang = 'en'))"),
        "wvec": (("english_vocab",), "wvec AS (SELECT v.word, e.embedding AS vec FROM english_vocab v "
                                     "JOIN embeddings e ON v.idx = e.vec_id)"),
        "lang_vectors": (("lang_vocab",), "lang_vectors AS (SELECT v.lang, v.word, e.embedding AS vec FROM lang_vocab v "
                                          "JOIN embeddings e ON v.idx = e.vec_id)"),
        "classes": (("articles",), "classes AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS class_idx "
                                   "FROM (SELECT DISTINCT unnest(cats) AS class FROM articles))"),
        "scores": (("articles", "classes"),
                   "scores AS (SELECT a.id, c.class_idx, c.class, ((a.id * 37 + c.class_idx * 11) % 100) / 100.0 AS score, "
                   "CAST(list_contains(a.cats, c.class) AS INTEGER) AS y FROM articles a CROSS JOIN classes c "
                   "WHERE len(a.cats) > 0)"),
    }


def with_views(names, body: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (and their dependencies)."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for dep in sql_views()[n][0]:
            visit(dep)
        order.append(n)
    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(sql_views()[n][1] for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ctes + ",\n" + body[5:]
    return "WITH " + ctes + "\n" + body
