"""Multi-label evaluation from long predictions (id, class, score, y):
thresholding, per-class confusion tables, micro/macro scores, k-fold
mean/std, log-loss, threshold sweeps (M2, M3, A15-A17, A21, W6).

Everything is a conditional sum grouped by class (or by fold and class):
map-side partial aggregation keeps the shuffle to one row per class per
task whatever the number of articles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.vocab import dense_index


def threshold(score, t: float = 0.5) -> Column:
    """M2: predicted label = score strictly above the threshold."""
    s = F.col(score) if isinstance(score, str) else score
    return (s > F.lit(t)).cast("int")


def _ratio(num, den) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def confusion(df: DataFrame, class_col: str = "class", y_col: str = "y", pred_col: str = "pred",
              by=()) -> DataFrame:
    """A15 counts: TN, FN, TP, FP and support per class (per ``by``)."""
    y, p = F.col(y_col), F.col(pred_col)
    return df.groupBy(*by, class_col).agg(
        F.sum(y).cast("double").alias("count"),
        F.sum(((1 - y) * (1 - p))).cast("long").alias("TN"),
        F.sum((y * (1 - p))).cast("long").alias("FN"),
        F.sum((y * p)).cast("long").alias("TP"),
        F.sum(((1 - y) * p)).cast("long").alias("FP"))


def per_class(conf: DataFrame) -> DataFrame:
    """Precision, recall, f1 per class; 0 when a denominator is 0."""
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    return (conf.withColumn("precision", _ratio(tp, tp + fp))
            .withColumn("recall", _ratio(tp, tp + fn))
            .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn)))


def micro_macro(conf: DataFrame, by=(), digits: int | None = 4) -> DataFrame:
    """macro = mean of per-class scores over all classes; micro = scores
    of the pooled TP/FP/FN.  Rounded like the reference's report."""
    pc = per_class(conf)
    tp, fp, fn = F.sum("TP"), F.sum("FP"), F.sum("FN")
    out = pc.groupBy(*by).agg(
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        _ratio(tp, tp + fp).alias("precision_micro"), _ratio(tp, tp + fn).alias("recall_micro"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_micro"))
    if digits is not None:
        for c in ["precision_macro", "recall_macro", "f1_macro", "precision_micro", "recall_micro", "f1_micro"]:
            out = out.withColumn(c, F.round(c, digits))
    return out


METRIC_COLS = ["precision_macro", "recall_macro", "f1_macro", "precision_micro", "recall_micro", "f1_micro"]


def kfold(df: DataFrame, id_col: str, k: int, class_col: str = "class", y_col: str = "y",
          pred_col: str = "pred") -> DataFrame:
    """A17 + W6: articles in id order, fold = position mod k (interleaved
    subsets); metrics per fold, then mean and sample standard deviation
    across folds, one row per metric."""
    ids = dense_index(df.select(id_col).distinct(), [id_col], "__pos").withColumn(
        "fold", (F.col("__pos") % k).cast("int")).drop("__pos")
    per_fold = micro_macro(confusion(df.join(ids, id_col), class_col, y_col, pred_col, by=["fold"]),
                           by=["fold"], digits=None)
    stacked = per_fold.select("fold", F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in METRIC_COLS])).alias("m"))
    return (stacked.groupBy(F.col("m.metric").alias("metric"))
            .agg(F.round(F.avg("m.value"), 6).alias("mean"), F.round(F.stddev_samp("m.value"), 6).alias("std")))


def log_loss(df: DataFrame, score_col: str = "score", y_col: str = "y", by=()) -> DataFrame:
    """Mean binary cross-entropy of stored scores, logs clamped at -100
    like the reference's loss."""
    p, y = F.col(score_col), F.col(y_col)
    ll = y * F.greatest(F.log(p), F.lit(-100.0)) + (1 - y) * F.greatest(F.log(1 - p), F.lit(-100.0))
    clean = F.when(p <= 0, F.lit(-100.0) * y + (1 - y) * F.lit(0.0)).when(
        p >= 1, (1 - y) * F.lit(-100.0)).otherwise(ll)
    return df.groupBy(*by).agg(F.round(-F.avg(clean), 6).alias("log_loss"))


def threshold_sweep(df: DataFrame, grid, score_col: str = "score", class_col: str = "class",
                    y_col: str = "y", by=(), subsets: Column | None = None) -> DataFrame:
    """M3: micro/macro metrics for every threshold of a grid, in one pass:
    rows are counted per class and number of thresholds that their score
    exceeds, and the confusion counts of every threshold are sums over that
    small table (classes x (grid + 1) rows).  With ``subsets``, an array of
    subset names made from the columns ``by``, the same pass gives the metrics
    of each (threshold, subset): rows are counted per ``by`` as well, and the
    counts, not the rows, are put into every subset they belong to."""
    cuts = sorted({float(t) for t in grid})
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: F.col(score_col) > t))
    cells = df.groupBy(*by, class_col, above.alias("__k")).agg(F.sum(y_col).cast("long").alias("__y"), F.count(F.lit(1)).alias("__n"))
    groups = ["threshold"]
    if subsets is not None:
        cells, groups = cells.withColumn("subset", F.explode(subsets)), ["threshold", "subset"]
    # a row is predicted at the j-th threshold when it exceeds more than j of them
    table = cells.select(*groups[1:], class_col, "__k", "__y", "__n", F.posexplode(F.array(*map(F.lit, cuts))).alias("__j", "threshold"))
    hit, y, n = F.col("__k") > F.col("__j"), F.col("__y"), F.col("__n")
    total = lambda cond, v: F.sum(F.when(cond, v).otherwise(F.lit(0))).cast("long")
    conf = table.groupBy(*groups, class_col).agg(
        F.sum(y).cast("double").alias("count"), total(~hit, n - y).alias("TN"), total(~hit, y).alias("FN"),
        total(hit, y).alias("TP"), total(hit, n - y).alias("FP"))
    return micro_macro(conf, by=groups)


def best_threshold(sweep: DataFrame, metric: str = "f1_micro") -> DataFrame:
    """The sweep's first strict maximum of a metric (ties: the smaller threshold)."""
    return sweep.orderBy(F.col(metric).desc(), "threshold").limit(1)
