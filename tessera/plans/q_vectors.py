"""Vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import stats as st
from tessera.operators import vectors as vx
from tessera.operators import vocab as vb
from tessera.plans import views as V
from tessera.plans.catalog import register
from tessera.plans.q_links import _LINK_SQL, kept_pages
from tessera.plans.q_stats import _IDF_SQL, train_idf
from tessera.session import read_table

_DIM = "(SELECT max(len(embedding)) FROM embeddings)"


def _dim(spark, sf) -> int:
    """Vector dimension: one aggregated value (used inside higher-order
    functions, where scalar subqueries are not allowed)."""
    return int(read_table(spark, sf, "embeddings").select(F.max(F.size("embedding"))).first()[0])


@register("emb_matrix", f"""
WITH v AS (SELECT DISTINCT lang, '<pad>' AS word, CAST(0 AS BIGINT) AS idx FROM lang_vocab
  UNION ALL SELECT DISTINCT lang, '<unk>', 1 FROM lang_vocab UNION ALL SELECT lang, word, idx + 2 FROM lang_vocab)
SELECT v.lang, v.idx, v.word, coalesce(w.vec, list_transform(range({_DIM}), lambda x: CAST(0.0 AS FLOAT))) AS vec,
       w.vec IS NOT NULL AS found
FROM v LEFT JOIN lang_vectors w ON v.lang = w.lang AND v.word = w.word
""", ["lang_vocab", "lang_vectors"])
def emb_matrix(spark, sf):
    """Each language's vocabulary (<pad>, <unk> first) with vectors,
    zeros when missing, and the found flag."""
    vocab = vb.vocab_per_group(V.tokens(spark, sf), "lang", "toks")
    return vx.embedding_matrix(vocab, V.lang_vectors(spark, sf), _dim(spark, sf), ["lang"])


@register("emb_matrix_noise")
def emb_matrix_noise(spark, sf):
    """Same table, missing vectors drawn as 0.6 * N(0, 1) per component
    (reproducible by seed; rows-only check)."""
    dim = _dim(spark, sf)
    return emb_matrix(spark, sf).withColumn(
        "vec", F.when(F.col("found"), F.col("vec")).otherwise(vx.gaussian_fill("word", dim, 57)))


@register("emb_stack", f"""
WITH w AS (SELECT DISTINCT lang, unnest(toks) AS word FROM tokens),
cv AS (SELECT lang, word, CAST(row_number() OVER (ORDER BY lang, word) + 1 AS BIGINT) AS idx FROM w
  UNION ALL SELECT NULL, '<pad>', 0 UNION ALL SELECT NULL, '<unk>', 1)
SELECT cv.idx, coalesce(lv.vec, list_transform(range({_DIM}), lambda x: CAST(0.0 AS FLOAT))) AS vec
FROM cv LEFT JOIN lang_vectors lv ON cv.lang = lv.lang AND cv.word = lv.word
""", ["tokens", "lang_vectors"])
def emb_stack(spark, sf):
    """M8: the combined multilingual vocabulary with each language's
    vectors stacked block by block (zeros where a word has none)."""
    voc = vb.multilingual_vocab(V.tokens(spark, sf), "lang", toks_col="toks")
    lv = V.lang_vectors(spark, sf).withColumnRenamed("vec", "__v")
    j = voc.join(lv, ["lang", "word"], "left")
    return j.select("idx", F.coalesce("__v", vx.zeros(_dim(spark, sf))).alias("vec"))


@register("emb_sum", """
WITH u AS (SELECT l.word, x.i, x.v FROM lang_vectors l,
           LATERAL (SELECT generate_subscripts(l.vec, 1) AS i, unnest(l.vec) AS v) x),
s AS (SELECT word, i, sum(round(CAST(v AS DOUBLE) * 1000000.0)) AS m FROM u GROUP BY word, i),
n AS (SELECT word, count(*) AS n FROM lang_vectors GROUP BY word)
SELECT s.word, n.n, list(round(s.m / 1000000.0, 6) ORDER BY s.i) AS vec FROM s JOIN n USING (word) GROUP BY s.word, n.n
""", ["lang_vectors"])
def emb_sum(spark, sf):
    """M9: vectors of the same word in several languages summed
    element-wise (exact)."""
    return vx.summed_by_word(V.lang_vectors(spark, sf), ["word"]).select("word", "n", "vec")


def _doc_vec_sql(src: str, weight: str | None, mean: bool, p: str, by_lang: bool = True) -> str:
    """CTEs {p}c .. {p}out(id, vec) computing exact summed / averaged vectors."""
    wjoin = f"LEFT JOIN {weight} wt ON wt.lang = c.lang AND wt.word = c.word" if weight else ""
    factor = "c.n * coalesce(wt.weight, 0)" if weight else "c.n"
    div = "floor(x / t.len + 0.5) / 1000000.0" if mean else "x / 1000000.0"
    return f"""
{p}t AS (SELECT id, lang, toks, len(toks) AS len FROM {src} WHERE len(toks) > 0),
{p}c AS (SELECT id, lang, word, count(*) AS n FROM (SELECT id, lang, unnest(toks) AS word FROM {p}t) GROUP BY ALL),
{p}j AS (SELECT c.id, {factor} AS f, w.vec FROM {p}c c JOIN wv w ON c.word = w.word {"AND c.lang = w.lang" if by_lang else ""} {wjoin}),
{p}u AS (SELECT j.id, x.i, round(CAST(x.v AS DOUBLE) * 1000000.0) * j.f AS m FROM {p}j j,
        LATERAL (SELECT generate_subscripts(j.vec, 1) AS i, unnest(j.vec) AS v) x),
{p}s AS (SELECT id, list(m ORDER BY i) AS vec FROM (SELECT id, i, sum(m) AS m FROM {p}u GROUP BY id, i) GROUP BY id),
{p}out AS (SELECT t.id, CASE WHEN s.vec IS NULL THEN list_transform(range({_DIM}), lambda x: CAST(0.0 AS DOUBLE))
        ELSE list_transform(s.vec, lambda x: {div}) END AS vec
        FROM {p}t t LEFT JOIN {p}s s ON t.id = s.id)
"""


@register("feat_mean_vec", "WITH wv AS (SELECT lang, word, vec FROM lang_vectors)," + _doc_vec_sql("tokens", None, True, "fm")
          + "SELECT id, vec FROM fmout", ["tokens", "lang_vectors"])
def feat_mean_vec(spark, sf):
    """Article vector = sum of the vectors of its tokens in its language
    / token count (OOV zero but counted)."""
    return vx.weighted_doc_vectors(V.tokens(spark, sf), "id", "toks", V.lang_vectors(spark, sf), _dim(spark, sf), by=["lang"])


@register("feat_idf_vec", _IDF_SQL + """
, idf AS (SELECT lang, word, CAST(trunc(idf) AS INTEGER) AS weight FROM i),
wv AS (SELECT lang, word, vec FROM lang_vectors),""" + _doc_vec_sql("tokens", "idf", False, "b") + "SELECT id, vec FROM bout",
          ["tokens", "lang_vectors"])
def feat_idf_vec(spark, sf):
    """Sum over positions of the train split's integer-truncated IDF
    weight times the word vector of the article's language (the reference
    truncates its IDF weights, Q4)."""
    w = train_idf(spark, sf).select("lang", "word", F.col("idf_trunc").alias("weight"))
    return vx.weighted_doc_vectors(V.tokens(spark, sf), "id", "toks", V.lang_vectors(spark, sf), _dim(spark, sf), weights=w,
                                   by=["lang"], mean=False)


_LINKVEC_SQL = _LINK_SQL + """
, ne AS (SELECT count(*) AS n FROM embeddings),
wv AS (SELECT CAST(vec_id AS VARCHAR) AS word, embedding AS vec FROM embeddings),
kept AS (SELECT j.qid AS id, 'x' AS lang,
  list_transform(j.pid_inlinks, lambda p: CAST(p % ne.n AS VARCHAR)) AS tin,
  list_transform(j.pid_outlinks, lambda s: coalesce(CAST(TRY_CAST(s AS BIGINT) % ne.n AS VARCHAR), '')) AS tout
  FROM jio j, ne WHERE j.status = 'kept'),
kin AS (SELECT id, lang, tin AS toks FROM kept),
kout AS (SELECT id, lang, tout AS toks FROM kept),
""" + _doc_vec_sql("kin", None, True, "li", False) + "," + _doc_vec_sql("kout", None, True, "lo", False) + """
SELECT i.id AS qid, list_concat(i.vec, o.vec) AS vec FROM liout i JOIN loout o USING (id)
"""


@register("feat_link_vec", _LINKVEC_SQL, ["outlinks", "inlinks"])
def feat_link_vec(spark, sf):
    """Mean in-link vector concatenated with the mean out-link
    vector (link id -> embeddings row id mod table size)."""
    e = read_table(spark, sf, "embeddings")
    n = int(e.select(F.count(F.lit(1))).first()[0])
    dim = _dim(spark, sf)
    wv = e.select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))
    pages = kept_pages(spark, sf)

    def side(name):
        row = F.transform("ids", lambda p: F.coalesce((p.try_cast("bigint") % n).cast("string"), F.lit("")))
        toks = pages.filter(F.col("side") == name).select(F.col("qid").alias("id"), row.alias("toks"))
        return vx.weighted_doc_vectors(toks, "id", "toks", wv, dim, paged=True)
    return side("in").join(side("out").withColumnRenamed("vec", "vec_out"), "id").select(
        F.col("id").alias("qid"), F.concat("vec", "vec_out").alias("vec"))
