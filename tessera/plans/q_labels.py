"""Label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import labels as lb
from tessera.operators import rows as rw
from tessera.operators.vocab import dense_index
from tessera.plans import views as V
from tessera.plans.catalog import register

# The classes of the test corpus, for the oracle's static column list; the
# query itself learns them from the data.
_ALL_CLASSES = sorted(["Quality.high", "Quality.low", "Safety.toxic"] + [f"Source.src{i}" for i in range(20)])
# Fixed rename map for the rename operator.
RENAMES = {"Quality.high": "Quality.good", "Quality.low": "Quality.poor"}


@register("lbl_classes", "SELECT class, CAST(class_idx AS BIGINT) AS class_idx FROM classes", ["classes"])
def lbl_classes(spark, sf):
    """A4: sorted distinct classes with their index (distributed)."""
    return dense_index(lb.distinct_classes(V.articles(spark, sf), "cats"), ["class"], "class_idx")


@register("lbl_multihot", """
SELECT a.id, list(CAST(list_contains(a.cats, c.class) AS INTEGER) ORDER BY c.class_idx) AS labels
FROM articles a CROSS JOIN classes c WHERE len(a.cats) > 0 GROUP BY a.id
""", ["articles", "classes"])
def lbl_multihot(spark, sf):
    """L1/L2: multi-hot label vector in sorted class order."""
    a = V.articles(spark, sf).filter(rw.nonempty("cats"))
    cl = lb.class_table(a, "cats")
    return a.select("id", cl.multihot("cats").alias("labels"))


@register("lbl_class_ids", """
WITH p AS (SELECT a.id, u.c, u.pos FROM articles a,
           LATERAL (SELECT unnest(a.cats) AS c, generate_subscripts(a.cats, 1) AS pos) u)
SELECT p.id, list(CAST(cl.class_idx AS BIGINT) ORDER BY p.pos) AS class_ids
FROM p JOIN classes cl ON p.c = cl.class GROUP BY p.id
""", ["articles", "classes"])
def lbl_class_ids(spark, sf):
    """L3: categories -> class ids, category order kept."""
    a = V.articles(spark, sf).filter(rw.nonempty("cats"))
    cl = lb.class_table(a, "cats")
    return a.select("id", cl.class_ids("cats").alias("class_ids"))


def _wide_sql():
    cols = ", ".join(f"CAST(list_contains(cats, '{c}') AS INTEGER) AS {c.replace('.', '_')}" for c in _ALL_CLASSES)
    return f"SELECT id, {cols} FROM articles"


@register("lbl_wide", _wide_sql(), ["articles"])
def lbl_wide(spark, sf):
    """One column per class of the data, from a multi-hot vector,
    same-row select."""
    a = V.articles(spark, sf)
    cl = lb.class_table(a, "cats")
    m = a.select("id", cl.multihot("cats").alias("labels"))
    return lb.wide_columns(m, "labels", [c.replace(".", "_") for c in cl.names])


def _rename_sql():
    case = " ".join(f"WHEN c = '{k}' THEN '{v}'" for k, v in RENAMES.items())
    return f"SELECT id, cats AS cats_orig, list_transform(cats, lambda c: CASE {case} ELSE c END) AS cats FROM articles"


@register("lbl_rename", _rename_sql(), ["articles"])
def lbl_rename(spark, sf):
    """Renamed categories next to the original list."""
    a = V.articles(spark, sf)
    return a.select("id", F.col("cats").alias("cats_orig"), lb.rename_classes("cats", RENAMES).alias("cats"))


@register("lbl_support", """
SELECT class, CAST(sum(y) AS BIGINT) AS n_true, CAST(sum(CAST(score > 0.5 AS INTEGER)) AS BIGINT) AS n_pred
FROM scores GROUP BY class
""", ["scores"])
def lbl_support(spark, sf):
    """A5 + O3: true and predicted support per class."""
    s = V.scores(spark, sf).withColumn("pred", (F.col("score") > 0.5).cast("int"))
    return lb.support(s, "class", "y", "pred").orderBy("n_true", "class")


@register("lbl_cooccurrence", """
SELECT t.class AS true_class, p.class AS pred_class, count(*) AS n
FROM scores t JOIN scores p ON t.id = p.id WHERE t.y = 1 AND p.score > 0.5 GROUP BY 1, 2
""", ["scores"])
def lbl_cooccurrence(spark, sf):
    """Articles of true class t predicted as class p."""
    s = V.scores(spark, sf).withColumn("pred", (F.col("score") > 0.5).cast("int"))
    return lb.cooccurrence(s, "id", "class", "y", "pred")


@register("lbl_class_diff", """
WITH lc AS (SELECT DISTINCT lang, unnest(cats) AS class FROM articles),
l AS (SELECT DISTINCT lang FROM lc)
SELECT a.lang AS group_a, b.lang AS group_b, a.class FROM lc a, l b
WHERE a.lang <> b.lang AND NOT EXISTS (SELECT 1 FROM lc x WHERE x.lang = b.lang AND x.class = a.class)
""", ["articles"])
def lbl_class_diff(spark, sf):
    """Classes present in one language's corpus and missing from
    another's, both directions."""
    lc = V.articles(spark, sf).select("lang", F.explode("cats").alias("class"))
    return rw.set_differences(lc, "lang", "class")
