"""Classifier queries (M1, M4, M6, M7) -- rows-only checks (model numerics
are not SQL-expressible); tests assert that confusion counts add up and that
the fit beats a constant score on held-out articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import labels as lb
from tessera.operators import metrics as mt
from tessera.operators import models as md
from tessera.operators import vectors as vx
from tessera.operators.splits import split_80_10_10
from tessera.operators.vocab import dense_index
from tessera.plans import views as V
from tessera.plans.catalog import register
from tessera.plans.q_splits import language_mixes
from tessera.plans.q_vectors import _dim

GRID = [(0.001, 10), (0.01, 10), (0.001, 25), (0.01, 25)]
FOLDS = 5


def article_features(spark, sf):
    """(id, lang, labels, features, split): labelled articles with tokens,
    their mean vector, and multi-hot labels over all classes."""
    def build():
        at = V.article_tokens(spark, sf).filter(F.size("cats") > 0)
        cl = lb.class_table(at, "cats")
        feats = vx.weighted_doc_vectors(at.select("id", "lang", "toks"), "id", "toks", V.lang_vectors(spark, sf),
                                        _dim(spark, sf), by=["lang"])
        data = at.select("id", "lang", cl.multihot("cats").alias("labels")).join(feats.withColumnRenamed("vec", "features"), "id")
        return data.join(split_80_10_10(data.select("id"), "id", seed=1), "id")
    return V._shared(spark, "article_features", sf, build)


def _parts(spark, sf):
    d = article_features(spark, sf)
    return d.filter(F.col("split") == "train"), d.filter(F.col("split") == "val")


@register("ml_ovr_logreg")
def ml_ovr_logreg(spark, sf):
    """M1: one logistic regression per class on the mean vectors of the
    training articles; scores of the validation articles in long form."""
    train, val = _parts(spark, sf)
    model = md.fit_one_vs_rest(train, "features", "labels")
    return md.predict_long({"all": model}, val, "id", "features", "labels").drop("model")


@register("ml_grid")
def ml_grid(spark, sf):
    """M4: regParam x maxIter grid on the train split, micro/macro scores on
    the validation split from one scan, one row per setting; the settings are
    fitted together, in the passes of the longest."""
    train, val = _parts(spark, sf)
    models = {f"{reg}/{it}": m for (reg, it), m in md.fit_grid(train, GRID, "features", "labels").items()}
    res = md.evaluate(md.predict_long(models, val, "id", "features", "labels"), by=["model"])
    setting = F.split("model", "/")
    return res.select(setting[0].cast("double").alias("reg_param"), setting[1].cast("int").alias("max_iter"), *mt.METRIC_COLS)


@register("ml_transfer_matrix")
def ml_transfer_matrix(spark, sf):
    """M6 + M7: a model for every language, pair and all languages, each
    evaluated on every language's validation articles and on all of them
    ("val"); mean and sample std of all six metrics over 5 interleaved
    folds.  Training on 'en' and evaluating on 'fr' is the frozen-transfer
    row; training on 'fr' is the trained-from-scratch row."""
    train, val = _parts(spark, sf)
    langs = [r[0] for r in article_features(spark, sf).select("lang").distinct().collect()]   # languages, not articles
    models = md.fit_models(train, language_mixes(langs), "features", "labels", "lang")
    each = val.unionByName(val.withColumn("lang", F.lit("val")))
    at = dense_index(each.select("lang", "id"), ["lang", "id"], "__i")
    start = at.groupBy("lang").agg(F.min("__i").alias("__0"))
    folds = at.join(start, "lang").select("lang", "id", ((F.col("__i") - F.col("__0")) % FOLDS).cast("int").alias("fold"))
    pred = md.predict_long(models, each.join(folds, ["lang", "id"]), "id", "features", "labels", keep=["lang", "fold"])
    by = ["model", "lang", "fold"]
    p = pred.withColumn("pred", mt.threshold("score", 0.5)).withColumnRenamed("class_idx", "class")
    per_fold = mt.micro_macro(mt.confusion(p, by=by), by=by, digits=None)
    stacked = per_fold.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"))
                                                       for c in mt.METRIC_COLS])).alias("m"))
    return (stacked.groupBy(F.col("model").alias("train_mix"), F.col("lang").alias("eval_lang"), F.col("m.metric").alias("metric"))
            .agg(F.round(F.avg("m.value"), 6).alias("mean"), F.round(F.stddev_samp("m.value"), 6).alias("std")))
