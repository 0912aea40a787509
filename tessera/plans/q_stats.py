"""Corpus statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import stats as st
from tessera.operators.text_ops import word_counts
from tessera.operators.topk import top_k_per_group
from tessera.plans import views as V
from tessera.plans.catalog import register
from tessera.plans.q_vocab import _SPLIT_SQL, train_tokens
from tessera.session import scratch_path
from tessera.sources import results as rs


@register("agg_token_freq", """
SELECT lang, word, count(*) AS n, count(*) > 5 AS frequent
FROM (SELECT lang, unnest(toks) AS word FROM tokens) GROUP BY lang, word
""", ["tokens"])
def agg_token_freq(spark, sf):
    """A2 + P6: occurrences per (language, word); frequent = count > 5."""
    c = word_counts(V.tokens(spark, sf), "toks", by=["lang"])
    return c.withColumn("frequent", F.col("n") > 5)


@register("agg_len_hist", """
WITH l AS (SELECT CAST(len(toks) AS INTEGER) AS n_tokens, count(*) AS n_articles FROM tokens GROUP BY 1),
m AS (SELECT min(n_tokens) AS mn, max(n_tokens) AS mx FROM l)
SELECT n_tokens, n_articles,
  CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((n_tokens - mn) * 100 / (mx - mn)), 99) END AS INTEGER) AS bin
FROM l, m
""", ["tokens"])
def agg_len_hist(spark, sf):
    """A3: articles per token count and the 100 equal-width histogram bins."""
    return st.histogram_bins(st.length_table(V.tokens(spark, sf)), "n_tokens", 100)


TRIM_LONGEST = 100


@register("agg_len_hist_trim", f"""
WITH t AS (SELECT id, CAST(len(toks) AS INTEGER) AS n FROM tokens),
keep AS (SELECT n FROM t QUALIFY row_number() OVER (ORDER BY n DESC, id DESC) > {TRIM_LONGEST}),
l AS (SELECT n AS n_tokens, count(*) AS n_articles FROM keep GROUP BY 1),
m AS (SELECT min(n_tokens) AS mn, max(n_tokens) AS mx FROM l)
SELECT n_tokens, n_articles,
  CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((n_tokens - mn) * 10 / (mx - mn)), 9) END AS INTEGER) AS bin
FROM l, m
""", ["tokens"])
def agg_len_hist_trim(spark, sf):
    """A3': the histogram after discarding the longest articles (10 bins).
    The longest ones are a bounded top-k (TakeOrderedAndProject), removed
    with an anti join."""
    t = V.tokens(spark, sf).select("id", F.size("toks").alias("n"))
    longest = t.orderBy(F.col("n").desc(), F.col("id").desc()).limit(TRIM_LONGEST).select("id")
    kept = t.join(longest, "id", "left_anti")
    lengths = kept.groupBy(F.col("n").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_articles"))
    return st.histogram_bins(lengths, "n_tokens", 10)


@register("agg_mean_len", """
SELECT class, count(*) AS n_articles, round(avg(len(toks)), 6) AS mean_len
FROM (SELECT toks, unnest(cats) AS class FROM article_tokens) GROUP BY class
UNION ALL
SELECT NULL AS class, count(*) AS n_articles, round(avg(len(toks)), 6) AS mean_len FROM article_tokens
""", ["article_tokens"])
def agg_mean_len(spark, sf):
    """Mean token count within each class, plus the overall mean
    (class NULL) over articles counted once."""
    at = V.article_tokens(spark, sf).select("cats", F.size("toks").alias("n"))
    per = (at.select(F.explode("cats").alias("class"), "n").groupBy("class")
           .agg(F.count(F.lit(1)).alias("n_articles"), F.round(F.avg("n"), 6).alias("mean_len")))
    total = at.agg(F.count(F.lit(1)).alias("n_articles"), F.round(F.avg("n"), 6).alias("mean_len")) \
        .select(F.lit(None).cast("string").alias("class"), "n_articles", "mean_len")
    return per.unionByName(total)


@register("agg_doc_freq", _SPLIT_SQL + """
SELECT lang, word, count(*) AS df FROM
 (SELECT t.lang, unnest(list_distinct(t.toks)) AS word FROM tokens t JOIN split s USING (id) WHERE s.split = 'train')
GROUP BY lang, word
""", ["tokens"])
def agg_doc_freq(spark, sf):
    """A10: number of training articles containing each word, per language."""
    return st.doc_freq(train_tokens(spark, sf), "toks", ["lang"])


_IDF_SQL = _SPLIT_SQL + """
, d AS (SELECT lang, word, count(*) AS df FROM
        (SELECT t.lang, unnest(list_distinct(t.toks)) AS word FROM tokens t JOIN split s USING (id) WHERE s.split = 'train')
        GROUP BY lang, word),
v AS (SELECT lang, count(*) AS n FROM d GROUP BY lang),
i AS (SELECT d.lang, d.word, d.df, ln(v.n / (1 + d.df)) AS idf FROM d JOIN v USING (lang))
"""


def train_idf(spark, sf):
    """IDF table of the train split, per language."""
    return st.idf(st.doc_freq(train_tokens(spark, sf), "toks", ["lang"]), ["lang"])


@register("agg_idf", _IDF_SQL + """
SELECT lang, word, df, round(idf, 6) AS idf, CAST(trunc(idf) AS INTEGER) AS idf_trunc FROM i
""", ["tokens"])
def agg_idf(spark, sf):
    """ln(|V| / (1 + df)) learnt on the train split, with |V| the
    language's vocabulary size there."""
    i = train_idf(spark, sf)
    return i.select("lang", "word", "df", F.round("idf", 6).alias("idf"), "idf_trunc")


@register("agg_idf_weights", _IDF_SQL + """
, p AS (SELECT t.id, t.lang, u.word, u.pos FROM tokens t,
        LATERAL (SELECT unnest(t.toks) AS word, generate_subscripts(t.toks, 1) AS pos) u)
SELECT p.id, list(coalesce(round(i.idf, 6), 0.0) ORDER BY p.pos) AS weights
FROM p LEFT JOIN i ON p.lang = i.lang AND p.word = i.word GROUP BY p.id
UNION ALL SELECT id, []::DOUBLE[] AS weights FROM tokens WHERE len(toks) = 0
""", ["tokens"])
def agg_idf_weights(spark, sf):
    """The train split's IDF weight of every token position of all
    articles (0 when unknown)."""
    i = train_idf(spark, sf).withColumn("idf", F.round("idf", 6))
    return st.position_weights(V.tokens(spark, sf), "id", "toks", i, "idf", ["lang"], 0.0,
                               frequent=V.frequent_words(spark, sf))


_TFIDF_SQL = """
WITH terms AS (SELECT id, lang, list_filter(toks, lambda t: length(t) >= 2) AS t FROM tokens),
tf AS (SELECT id, lang, word, count(*) AS tf FROM (SELECT id, lang, unnest(t) AS word FROM terms) GROUP BY ALL),
dfq AS (SELECT lang, word, count(*) AS df FROM (SELECT lang, unnest(list_distinct(t)) AS word FROM terms) GROUP BY ALL),
nd AS (SELECT lang, count(*) AS n FROM terms GROUP BY lang),
s AS (SELECT tf.id, tf.lang, tf.word, tf.tf * (ln((1 + nd.n) / (1 + dfq.df)) + 1) AS raw
      FROM tf JOIN dfq USING (lang, word) JOIN nd USING (lang)),
r AS (SELECT id, lang, word, raw, sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS norm,
      CAST(row_number() OVER (PARTITION BY id ORDER BY raw DESC, word) AS INTEGER) AS rank FROM s)
"""


@register("agg_tfidf_top", _TFIDF_SQL + """
SELECT id, lang, rank, word, round(raw / norm, 6) AS tfidf FROM r WHERE rank <= 10
""", ["tokens"])
def agg_tfidf_top(spark, sf):
    """A12 + W3 + O4: top-10 TF-IDF terms per article."""
    return st.tfidf_top(V.tokens(spark, sf), "id", "toks", 10, ["lang"])


_WW_SQL = """
, ww AS (SELECT id, word, avg(len(toks) - pos + 1) AS weight FROM
         (SELECT id, toks, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM tokens) GROUP BY id, word),
wr AS (SELECT id, word, weight, CAST(row_number() OVER (PARTITION BY id ORDER BY weight DESC, word) AS INTEGER) AS rank FROM ww)
"""


@register("agg_word_weight", "WITH _x AS (SELECT 1)" + _WW_SQL + """
SELECT id, rank, word, round(weight, 6) AS weight FROM wr WHERE rank <= 10
""", ["tokens"])
def agg_word_weight(spark, sf):
    """A13 + W3: mean per-position weight of each distinct word of an
    article (weight = tokens remaining from that position, an integer, so
    means are exact), top 10 per article."""
    t = V.tokens(spark, sf)
    w = t.withColumn("w", F.transform("toks", lambda x, i: (F.size("toks") - i).cast("double")))
    return st.word_weight_top(w, "id", "w", "toks", 10)


@register("agg_top_overlap", _TFIDF_SQL + _WW_SQL + """
, a AS (SELECT id, list(word) AS top_w FROM wr WHERE rank <= 10 GROUP BY id),
b AS (SELECT id, list(word) AS top_t FROM r WHERE rank <= 10 GROUP BY id)
SELECT a.id, CAST(len(list_intersect(a.top_w, b.top_t)) AS INTEGER) AS n_common FROM a JOIN b USING (id)
""", ["tokens"])
def agg_top_overlap(spark, sf):
    """Size of the overlap between the top-10 weighted words and the
    top-10 TF-IDF terms of each article."""
    t = V.tokens(spark, sf)
    w = t.withColumn("w", F.transform("toks", lambda x, i: (F.size("toks") - i).cast("double")))
    a = st.word_weight_top(w, "id", "w", "toks", 10).groupBy("id").agg(F.collect_list("word").alias("top_w"))
    b = st.tfidf_top(t, "id", "toks", 10, ["lang"]).groupBy("id").agg(F.collect_list("word").alias("top_t"))
    return a.join(b, "id").select("id", F.size(F.array_intersect("top_w", "top_t")).alias("n_common"))


@register("agg_top_terms", """
WITH d AS (SELECT lang, word, count(*) AS df FROM (SELECT lang, unnest(list_distinct(toks)) AS word FROM tokens)
           GROUP BY lang, word)
SELECT lang, word, df, rank FROM
 (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY df DESC, word) AS INTEGER) AS rank FROM d) WHERE rank <= 20
""", ["tokens"])
def agg_top_terms(spark, sf):
    """Flagship: per-language top-20 terms by document frequency (two-phase
    exact top-k, so a dominant language is split across tasks)."""
    d = st.doc_freq(V.tokens(spark, sf), "toks", ["lang"])
    return top_k_per_group(d, ["lang"], [F.col("df").desc(), F.col("word")], 20, "word").select(
        "lang", "word", "df", "rank")


# ---------------------------------------------------------------------------
# Vector coverage, per language
# ---------------------------------------------------------------------------

@register("cov_corpus", """
WITH w AS (SELECT DISTINCT lang, unnest(toks) AS word FROM tokens),
j AS (SELECT w.lang, w.word, v.word IS NOT NULL AS hit FROM w LEFT JOIN (SELECT DISTINCT lang, word FROM lang_vectors) v
      ON w.lang = v.lang AND w.word = v.word)
SELECT lang, count(*) AS n_words, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS n_found,
       CAST(sum(CAST(NOT hit AS INTEGER)) AS BIGINT) AS n_missing,
       round(sum(CAST(hit AS INTEGER)) * 100.0 / count(*), 4) AS pct_found FROM j GROUP BY lang
""", ["tokens", "lang_vectors"])
def cov_corpus(spark, sf):
    """Distinct words of each language found / not found among its vectors."""
    vec = V.lang_vectors(spark, sf).select("lang", "word").distinct().withColumn("hit", F.lit(True))
    j = V.lang_vocab(spark, sf).join(vec, ["lang", "word"], "left").select("lang", F.coalesce("hit", F.lit(False)).alias("hit"))
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n_words"),
                                 F.sum(F.col("hit").cast("long")).alias("n_found"),
                                 F.sum((~F.col("hit")).cast("long")).alias("n_missing"),
                                 F.round(F.sum(F.col("hit").cast("long")) * F.lit(100.0) / F.count(F.lit(1)), 4).alias("pct_found"))


@register("cov_missing_words", """
SELECT w.lang, w.word FROM (SELECT DISTINCT lang, unnest(toks) AS word FROM tokens) w
LEFT JOIN lang_vectors v ON w.lang = v.lang AND w.word = v.word WHERE v.word IS NULL
""", ["tokens", "lang_vectors"])
def cov_missing_words(spark, sf):
    """Words of each language without a vector (anti join)."""
    words = V.lang_vocab(spark, sf).select("lang", "word")
    return words.join(V.lang_vectors(spark, sf).select("lang", "word"), ["lang", "word"], "left_anti")


_COV_SQL = """
, p AS (SELECT t.id, t.lang, u.word, u.pos FROM tokens t,
        LATERAL (SELECT unnest(t.toks) AS word, generate_subscripts(t.toks, 1) AS pos) u),
h AS (SELECT p.id, p.lang, p.word, p.pos, v.word IS NOT NULL AS hit
      FROM p LEFT JOIN (SELECT DISTINCT lang, word FROM lang_vectors) v ON p.lang = v.lang AND p.word = v.word),
c AS (SELECT id, lang, count(*) AS total, sum(CAST(hit AS BIGINT)) * 100.0 / count(*) AS coverage,
      coalesce(list(word ORDER BY pos) FILTER (WHERE NOT hit), []::VARCHAR[]) AS missing FROM h GROUP BY id, lang
      UNION ALL SELECT id, lang, 0 AS total, 100.0 AS coverage, []::VARCHAR[] AS missing
      FROM tokens WHERE len(toks) = 0)
"""


def _coverage(spark, sf):
    return st.article_coverage(V.tokens(spark, sf), V.lang_vectors(spark, sf), "id", "toks", ["lang"],
                               V.frequent_words(spark, sf))


@register("cov_article", "WITH _x AS (SELECT 1)" + _COV_SQL + """
SELECT id, lang, round(coverage, 6) AS coverage, missing, total FROM c WHERE coverage < 75
""", ["tokens", "lang_vectors"])
def cov_article(spark, sf):
    """A9 + O2: articles whose coverage by their language's vectors is below
    75 %, with the missing tokens in order and the total (sorted by
    coverage, total)."""
    return (_coverage(spark, sf).filter(F.col("coverage") < 75)
            .orderBy("coverage", "total")
            .select("id", "lang", F.round("coverage", 6).alias("coverage"), "missing", "total"))


@register("cov_article_mean", "WITH _x AS (SELECT 1)" + _COV_SQL + """
SELECT lang, round(avg(coverage), 6) AS mean_coverage, count(*) AS n_articles FROM c GROUP BY lang
""", ["tokens", "lang_vectors"])
def cov_article_mean(spark, sf):
    """Each language's mean of the per-article coverage (empty article = 100)."""
    return _coverage(spark, sf).groupBy("lang").agg(
        F.round(F.avg("coverage"), 6).alias("mean_coverage"), F.count(F.lit(1)).alias("n_articles"))


@register("sink_coverage", "WITH _x AS (SELECT 1)" + _COV_SQL + """
SELECT id, lang, round(coverage, 6) AS coverage, missing, total FROM c WHERE coverage < 75
""", ["tokens", "lang_vectors"])
def sink_coverage(spark, sf):
    """The coverage report appended to its result table, its job run
    twice, and read back."""
    path = scratch_path(spark, "coverage")
    report = cov_article(spark, sf)
    for _ in range(2):
        rs.append_rows(report, path, "coverage")
    return rs.read_rows(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in report.schema)).drop("run")
