"""Metric and result-table queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import metrics as mt
from tessera.plans import views as V
from tessera.plans.catalog import register
from tessera.session import scratch_path
from tessera.sources import results as rs

GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
RUN_THRESHOLDS = [0.3, 0.5, 0.7]
KFOLD = 5

_CONF = """
conf AS (SELECT {by} class, CAST(sum(y) AS DOUBLE) AS count,
  CAST(sum((1 - y) * (1 - pred)) AS BIGINT) AS TN, CAST(sum(y * (1 - pred)) AS BIGINT) AS FN,
  CAST(sum(y * pred) AS BIGINT) AS TP, CAST(sum((1 - y) * pred) AS BIGINT) AS FP FROM {src} GROUP BY {by} class),
pc AS (SELECT *, CASE WHEN TP + FP = 0 THEN 0.0 ELSE TP / (TP + FP) END AS precision,
  CASE WHEN TP + FN = 0 THEN 0.0 ELSE TP / (TP + FN) END AS recall,
  CASE WHEN 2 * TP + FP + FN = 0 THEN 0.0 ELSE 2 * TP / (2 * TP + FP + FN) END AS f1 FROM conf)
"""


def _mm(by: str = "", digits: int | None = 4) -> str:
    def r(x):
        return f"round({x}, {digits})" if digits is not None else x
    return (f"SELECT {by} {r('avg(precision)')} AS precision_macro, {r('avg(recall)')} AS recall_macro, "
            f"{r('avg(f1)')} AS f1_macro, "
            f"{r('CASE WHEN sum(TP) + sum(FP) = 0 THEN 0.0 ELSE sum(TP) / (sum(TP) + sum(FP)) END')} AS precision_micro, "
            f"{r('CASE WHEN sum(TP) + sum(FN) = 0 THEN 0.0 ELSE sum(TP) / (sum(TP) + sum(FN)) END')} AS recall_micro, "
            f"{r('CASE WHEN 2 * sum(TP) + sum(FP) + sum(FN) = 0 THEN 0.0 ELSE 2 * sum(TP) / (2 * sum(TP) + sum(FP) + sum(FN)) END')} AS f1_micro "
            f"FROM pc" + (f" GROUP BY {by.rstrip(', ')}" if by else ""))


_PRED = "pr AS (SELECT *, CAST(score > 0.5 AS INTEGER) AS pred FROM scores)"


def _pred(spark, sf):
    return V.scores(spark, sf).withColumn("pred", mt.threshold("score", 0.5))


@register("met_threshold", "SELECT id, class, CAST(score > 0.5 AS INTEGER) AS pred FROM scores", ["scores"])
def met_threshold(spark, sf):
    """M2: label = score > 0.5 (strictly)."""
    return _pred(spark, sf).select("id", "class", "pred")


@register("met_per_class", "WITH " + _PRED + "," + _CONF.format(by="", src="pr") + """
SELECT class, count, TN, FN, TP, FP, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM pc
""", ["scores"])
def met_per_class(spark, sf):
    """Per-class count, TN, FN, TP, FP, precision, recall, f1."""
    pc = mt.per_class(mt.confusion(_pred(spark, sf)))
    return pc.select("class", "count", "TN", "FN", "TP", "FP", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("met_micro_macro", "WITH " + _PRED + "," + _CONF.format(by="", src="pr") + _mm(), ["scores"])
def met_micro_macro(spark, sf):
    """Macro and micro precision / recall / F1, rounded to 4."""
    return mt.micro_macro(mt.confusion(_pred(spark, sf)))


@register("met_kfold", f"""
WITH {_PRED},
ids AS (SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) % {KFOLD} AS INTEGER) AS fold
        FROM (SELECT DISTINCT id FROM scores)),
fp AS (SELECT pr.*, ids.fold FROM pr JOIN ids USING (id)),
""" + _CONF.format(by="fold,", src="fp") + ", pf AS (" + _mm("fold,", None) + """)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std
FROM (UNPIVOT pf ON precision_macro, recall_macro, f1_macro, precision_micro, recall_micro, f1_micro
      INTO NAME metric VALUE value) GROUP BY metric
""", ["scores"])
def met_kfold(spark, sf):
    """A17 + W6: 5 interleaved folds by id position; mean and sample std of
    every metric."""
    return mt.kfold(_pred(spark, sf), "id", KFOLD)


@register("met_log_loss", """
SELECT round(-avg(CASE WHEN score <= 0 THEN -100.0 * y WHEN score >= 1 THEN (1 - y) * -100.0
  ELSE y * greatest(ln(score), -100.0) + (1 - y) * greatest(ln(1 - score), -100.0) END), 6) AS log_loss FROM scores
""", ["scores"])
def met_log_loss(spark, sf):
    """Mean binary cross-entropy of the stored scores."""
    return mt.log_loss(V.scores(spark, sf))


_GRID_SQL = "[" + ", ".join(str(t) for t in GRID) + "]::DOUBLE[]"


@register("met_threshold_sweep", f"""
WITH g AS (SELECT unnest({_GRID_SQL}) AS threshold),
fan AS (SELECT s.class, s.y, g.threshold, CAST(s.score > g.threshold AS INTEGER) AS pred FROM scores s, g),
""" + _CONF.format(by="threshold,", src="fan") + _mm("threshold,"), ["scores"])
def met_threshold_sweep(spark, sf):
    """M3: micro/macro metrics for each threshold of the grid."""
    return mt.threshold_sweep(V.scores(spark, sf), GRID)


@register("met_best_threshold", f"""
WITH g AS (SELECT unnest({_GRID_SQL}) AS threshold),
fan AS (SELECT s.class, s.y, g.threshold, CAST(s.score > g.threshold AS INTEGER) AS pred FROM scores s, g),
""" + _CONF.format(by="threshold,", src="fan") + ", sw AS (" + _mm("threshold,") + """)
SELECT * FROM sw ORDER BY f1_micro DESC, threshold LIMIT 1
""", ["scores"])
def met_best_threshold(spark, sf):
    """M3: the threshold of the grid with the best micro F1."""
    return mt.best_threshold(mt.threshold_sweep(V.scores(spark, sf), GRID))


@register("res_best_epoch", f"""
WITH g AS (SELECT unnest({_GRID_SQL}) AS threshold),
fan AS (SELECT s.class, s.y, g.threshold, CAST(s.score > g.threshold AS INTEGER) AS pred FROM scores s, g),
""" + _CONF.format(by="threshold,", src="fan") + ", sw AS (" + _mm("threshold,") + """)
SELECT epoch, threshold, f1_micro FROM (
  SELECT CAST(round(threshold * 10) AS INTEGER) AS epoch, threshold, f1_micro,
         row_number() OVER (ORDER BY f1_micro DESC, threshold) AS r FROM sw) WHERE r = 1
""", ["scores"])
def res_best_epoch(spark, sf):
    """The sweep read as epochs 1..9; keep the first strict maximum of
    f1_micro (ties go to the earlier epoch)."""
    sw = mt.threshold_sweep(V.scores(spark, sf), GRID).withColumn(
        "epoch", F.round(F.col("threshold") * 10).cast("int"))
    w = Window.orderBy(F.col("f1_micro").desc(), F.col("epoch"))
    return sw.withColumn("r", F.row_number().over(w)).filter("r = 1").select("epoch", "threshold", "f1_micro")


RUN_SCHEMA = ("run string, threshold double, subset string, precision_macro double, recall_macro double, "
              "f1_macro double, precision_micro double, recall_micro double, f1_micro double")


def _runs_sql():
    parts = []
    for t in RUN_THRESHOLDS:
        for subset, filt in (("all", ""), ("en", "WHERE a.lang = 'en'")):
            src = (f"(SELECT s.class, s.y, CAST(s.score > {t} AS INTEGER) AS pred FROM scores s "
                   f"JOIN articles a ON s.id = a.id {filt})")
            parts.append(f"SELECT 'run_{subset}_{t}' AS run, CAST({t} AS DOUBLE) AS threshold, '{subset}' AS subset, * "
                         f"FROM (WITH " + _CONF.format(by="", src=src) + _mm() + ")")
    return " UNION ALL ".join(parts)


@register("res_leaderboard", "SELECT *, CAST(row_number() OVER (ORDER BY f1_micro DESC, run) AS INTEGER) AS rank FROM (" + _runs_sql() + ")",
          ["scores", "articles"])
def res_leaderboard(spark, sf):
    """M5 + U8 + S11: result rows of several runs (thresholds x subsets)
    from one pass over the scores, stored as CSV result files, read back with
    an explicit schema and ranked by f1_micro."""
    s = V.scores(spark, sf).join(V.articles(spark, sf).select("id", "lang"), "id")
    subsets = F.filter(F.array(F.lit("all"), F.when(F.col("lang") == "en", F.lit("en"))), F.isnotnull)
    runs = mt.threshold_sweep(s, RUN_THRESHOLDS, by=["lang"], subsets=subsets).select(
        F.concat(F.lit("run_"), "subset", F.lit("_"), F.col("threshold").cast("string")).alias("run"), "threshold", "subset", *mt.METRIC_COLS)
    path = scratch_path(spark, "runs")
    runs.coalesce(1).write.mode("overwrite").csv(path, header=True)
    back = spark.read.schema(RUN_SCHEMA).option("header", True).csv(path)
    w = Window.orderBy(F.col("f1_micro").desc(), F.col("run"))
    return back.withColumn("rank", F.row_number().over(w))


def _per_class_sql():
    cols = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
    return " UNION ALL ".join(
        f"SELECT 'run_{t}' AS run, * FROM (WITH " + _CONF.format(by="", src=f"(SELECT class, y, CAST(score > {t} AS INTEGER) AS pred FROM scores)")
        + f"SELECT class, count, TN, FN, TP, FP, {cols} FROM pc)" for t in RUN_THRESHOLDS)


PER_CLASS_SCHEMA = "class string, count double, TN long, FN long, TP long, FP long, precision double, recall double, f1 double"


@register("sink_per_class", _per_class_sql(), ["scores"])
def sink_per_class(spark, sf):
    """S12 + U8: per-class tables of three runs appended as CSV result files
    with a manifest, the last run's job twice, and read back."""
    path = scratch_path(spark, "per-class")
    for t in (*RUN_THRESHOLDS, RUN_THRESHOLDS[-1]):
        pc = mt.per_class(mt.confusion(V.scores(spark, sf).withColumn("pred", mt.threshold("score", t))))
        rs.append_rows(pc.select("class", *[F.col("count").cast("double")], "TN", "FN", "TP", "FP",
                                 *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]), path, f"run_{t}", "csv")
    return rs.read_rows(spark, path, PER_CLASS_SCHEMA, "csv").select("run", "class", "count", "TN", "FN", "TP", "FP", "precision", "recall", "f1")
