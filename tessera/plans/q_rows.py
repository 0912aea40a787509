"""Row filters, rejects, alignment and size reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import rows as rw
from tessera.plans import views as V
from tessera.plans.catalog import register


@register("flt_nonempty", """
SELECT id, lang, cats, CAST(len(toks) AS INTEGER) AS n_tokens FROM article_tokens
WHERE len(cats) > 0 AND len(toks) > 0
""", ["article_tokens"])
def flt_nonempty(spark, sf):
    """Drop articles without labels, then without tokens."""
    at = V.article_tokens(spark, sf)
    kept = rw.drop_empty(rw.drop_empty(at, "cats"), "toks")
    return kept.select("id", "lang", "cats", F.size("toks").alias("n_tokens"))


@register("flt_report", """
WITH s AS (SELECT count(*) AS n0, sum(CAST(len(cats) = 0 AS BIGINT)) AS d0,
                  sum(CAST(len(cats) > 0 AS BIGINT)) AS n1,
                  sum(CAST(len(cats) > 0 AND len(toks) = 0 AS BIGINT)) AS d1 FROM article_tokens)
SELECT 'cats' AS "column", CAST(n0 AS BIGINT) AS n_total, CAST(d0 AS BIGINT) AS n_dropped, round(d0 / n0, 4) AS share_dropped FROM s
UNION ALL SELECT 'toks', CAST(n1 AS BIGINT), CAST(d1 AS BIGINT), round(d1 / n1, 4) FROM s
""", ["article_tokens"])
def flt_report(spark, sf):
    """P1 report: rows seen / dropped / share for labels then tokens."""
    return rw.empty_report(V.article_tokens(spark, sf), ["cats", "toks"])


@register("flt_rejects", """
SELECT id, CASE WHEN len(cats) = 0 THEN 'no_labels' WHEN len(toks) = 0 THEN 'no_tokens' ELSE 'kept' END AS status
FROM article_tokens
""", ["article_tokens"])
def flt_rejects(spark, sf):
    """Kept rows and rejected rows (with the reason) from one pass."""
    at = V.article_tokens(spark, sf)
    return rw.with_status(at, [("no_labels", rw.nonempty("cats")), ("no_tokens", rw.nonempty("toks"))]).select(
        "id", "status")


@register("lbl_has_label", """
WITH m AS (SELECT a.id, list(CAST(list_contains(a.cats, c.class) AS INTEGER) ORDER BY c.class_idx) AS labels,
           list_contains(a.cats, 'Safety.toxic') AS has_toxic
           FROM articles a CROSS JOIN classes c WHERE len(a.cats) > 0 GROUP BY a.id, a.cats)
SELECT id, has_toxic, labels[1] = 1 AS has_first_class FROM m
""", ["articles", "classes"])
def lbl_has_label(spark, sf):
    """Label test by name (Safety.toxic) and by position (class 0 of
    the multi-hot vector)."""
    from tessera.operators.labels import class_table, has_label
    a = V.articles(spark, sf).filter(rw.nonempty("cats"))
    cl = class_table(a, "cats")
    return a.select("id", has_label("cats", "Safety.toxic").alias("has_toxic"),
                    (cl.multihot("cats")[0] == 1).alias("has_first_class"))


@register("align_common_keys", """
WITH n AS (SELECT count(DISTINCT part) AS n FROM aligned),
k AS (SELECT key FROM aligned GROUP BY key HAVING count(DISTINCT part) = (SELECT n FROM n))
SELECT key, part, row_id FROM aligned WHERE key IN (SELECT key FROM k)
""", ["aligned"])
def align_common_keys(spark, sf):
    """U1 + J2 + O1: rows whose key exists in every part, duplicates kept,
    sorted by key."""
    return rw.align(V.aligned(spark, sf), "key", "part")


@register("align_pair_diff", """
WITH kp AS (SELECT DISTINCT part, key FROM aligned),
p AS (SELECT DISTINCT part FROM kp)
SELECT a.part AS group_a, b.part AS group_b,
  (SELECT count(*) FROM kp x WHERE x.part = a.part AND NOT EXISTS
     (SELECT 1 FROM kp y WHERE y.part = b.part AND y.key = x.key)) AS n_only_a
FROM p a, p b WHERE a.part <> b.part
""", ["aligned"])
def align_pair_diff(spark, sf):
    """Pairwise key differences in both directions."""
    return rw.pair_difference_counts(V.aligned(spark, sf), "part", "key")


@register("rep_sizes", """
WITH n AS (SELECT count(DISTINCT part) AS n FROM aligned),
k AS (SELECT key FROM aligned GROUP BY key HAVING count(DISTINCT part) = (SELECT n FROM n))
SELECT part, 'initial' AS stage, count(*) AS n FROM aligned GROUP BY part
UNION ALL SELECT part, 'aligned' AS stage, count(*) AS n FROM aligned WHERE key IN (SELECT key FROM k) GROUP BY part
""", ["aligned"])
def rep_sizes(spark, sf):
    """Rows per part before and after alignment."""
    a = V.aligned(spark, sf)
    init = a.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit("initial"))
    al = (a.join(rw.common_keys(a, "key", "part"), "key", "left_semi").groupBy("part")
          .agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit("aligned")))
    return init.unionByName(al).select("part", "stage", "n")
