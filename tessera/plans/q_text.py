"""Text normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.text_ops import HTML_HEADING_RE, drop_rare_words, section_text
from tessera.plans import sqlgen
from tessera.plans import views as V
from tessera.plans.catalog import register
from tessera.session import read_table


@register("txt_normalise", "SELECT id, lang, toks FROM tokens", ["tokens"])
def txt_normalise(spark, sf):
    """T12 on every document, from the raw text."""
    return V.tokens_fresh(spark, sf)


_PG_SRC = ("(SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, html FROM pages)")
_PG_CTE, _PG_FINAL = sqlgen.normalise_ctes(_PG_SRC, "page_id", "html", "lang", ["page_id", "lang"],
                                           out="toks", prefix="pg")


def _pages(spark, sf):
    return read_table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("html", V.PAGE_LANG_RE, 1).alias("lang"), "html")


@register("txt_normalise_markup", f"WITH {_PG_CTE} SELECT page_id, lang, toks FROM {_PG_FINAL}")
def txt_normalise_markup(spark, sf):
    """Full markup chain on raw HTML pages (tags, entities, braces)."""
    return tx.normalise(_pages(spark, sf), "html", "lang", "toks", keep_cols=["page_id", "lang"])


_LG_CTE, _LG_FINAL = sqlgen.normalise_ctes("pages", "page_id", "html", "'en'", ["page_id"],
                                           out="toks", prefix="lg", stopwords=False, legacy=True)


@register("txt_normalise_legacy", f"WITH {_LG_CTE} SELECT page_id, toks FROM {_LG_FINAL}")
def txt_normalise_legacy(spark, sf):
    """T2': the earlier English-only variant (greedy templates), no stop
    words."""
    p = read_table(spark, sf, "pages").select("page_id", "html")
    return tx.normalise(p, "html", "lang", "toks", legacy=True, stopwords=False, keep_cols=["page_id"])


@register("txt_digits_to_words",
          "SELECT doc_id AS id, " + sqlgen.digits_to_words("text", "lang") + " AS text_words FROM documents")
def txt_digits_to_words(spark, sf):
    """T5: every digit of the raw text as ' <name>' in the document's language."""
    d = read_table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), tx.digits_to_words("text", "lang").alias("text_words"))


_RAW_CTE, _RAW_FINAL = sqlgen.normalise_ctes(
    "(SELECT doc_id AS id, lang, text FROM documents)", "id", "text", "lang", ["id", "lang"],
    out="raw", prefix="sw", stopwords=False)
_SW_KEPT = sqlgen.remove_stopwords("raw", "lang")


@register("txt_stopwords",
          f"WITH {_RAW_CTE}, sw AS (SELECT id, lang, raw, {_SW_KEPT} AS toks FROM {_RAW_FINAL}) "
          "SELECT id, lang, toks, CAST(len(raw) - len(toks) AS BIGINT) AS n_removed FROM sw")
def txt_stopwords(spark, sf):
    """Stop words removed per language (order and duplicates kept), with the count removed."""
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    raw = tx.normalise(d, "text", "lang", "raw", stopwords=False, keep_cols=["id", "lang"])
    kept = raw.withColumn("toks", tx.remove_stopwords("raw", "lang"))
    return kept.select("id", "lang", "toks", (F.size("raw") - F.size("toks")).cast("long").alias("n_removed"))


@register("txt_short_words",
          "SELECT id, list_filter(toks, lambda t: length(t) >= 3) AS toks FROM tokens", ["tokens"])
def txt_short_words(spark, sf):
    """Tokens shorter than 3 characters dropped."""
    return V.tokens(spark, sf).select("id", tx.drop_short_tokens("toks", 3).alias("toks"))


@register("txt_rare_words", """
WITH cnt AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(toks) AS w FROM tokens) GROUP BY w),
pos AS (SELECT id, unnest(toks) AS word, generate_subscripts(toks, 1) AS p FROM tokens),
kept AS (SELECT pos.id, list(pos.word ORDER BY pos.p) AS toks FROM pos JOIN cnt USING (word)
         WHERE cnt.n >= 6 GROUP BY pos.id)
SELECT t.id, t.lang, coalesce(k.toks, []::VARCHAR[]) AS toks FROM tokens t LEFT JOIN kept k ON t.id = k.id
""", ["tokens"])
def txt_rare_words(spark, sf):
    """Tokens whose corpus count is at most 5 dropped, order kept."""
    return drop_rare_words(V.tokens(spark, sf), "id", "toks", min_count=6,
                           frequent=V.frequent_words(spark, sf).select("word").distinct()).select("id", "lang", "toks")


_SEC_SRC = ("(SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, "
            f"array_to_string(regexp_extract_all(html, '{HTML_HEADING_RE}', 1), ' ') AS sec FROM pages)")
_SEC_CTE, _SEC_FINAL = sqlgen.normalise_ctes(_SEC_SRC, "page_id", "sec", "lang", ["page_id", "lang"],
                                             out="sections_tokens", prefix="sc")


@register("txt_sections", f"WITH {_SEC_CTE} SELECT page_id, lang, sections_tokens FROM {_SEC_FINAL}")
def txt_sections(spark, sf):
    """Page headings normalised into one token list per page."""
    p = read_table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("html", V.PAGE_LANG_RE, 1).alias("lang"),
        section_text(F.col("html")).alias("sec"))
    return tx.normalise(p, "sec", "lang", "sections_tokens", keep_cols=["page_id", "lang"])
