import math

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import metrics as mt
from tessera.operators import models as md


def _conf(spark, rows):
    return spark.createDataFrame(rows, "class string, TN long, FN long, TP long, FP long")


def test_threshold_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.51,)], "s double")
    assert [r[0] for r in df.select(mt.threshold("s", 0.5)).collect()] == [0, 1]


def test_per_class_golden_rows(spark):
    pc = {r["class"]: r for r in mt.per_class(_conf(spark, [("a", 9977, 15, 4, 0), ("b", 0, 14, 0, 0)])).collect()}
    assert pc["a"].precision == 1.0
    assert abs(pc["a"].recall - 0.2105263158) < 1e-9 and abs(pc["a"].f1 - 0.3478260870) < 1e-9
    assert pc["b"].precision == 0.0 and pc["b"].recall == 0.0 and pc["b"].f1 == 0.0


def test_micro_f1_golden_counts(spark):
    """Pooled counts of the published two-layer model -> micro F1 0.8140."""
    mm = mt.micro_macro(_conf(spark, [("all", 0, 3491, 13622, 2735)])).first()
    assert mm.f1_micro == 0.814


def test_kfold_interleaved_sample_std(spark):
    rows = []
    for i in range(5):
        rows.append((i, "c", 1, 1 if i % 2 == 0 else 0))
    df = spark.createDataFrame(rows, "id long, class string, y int, pred int")
    got = {r.metric: r for r in mt.kfold(df, "id", 2).collect()}
    # fold 0 = ids {0,2,4}: all right (f1 1); fold 1 = {1,3}: none predicted (f1 0)
    assert got["f1_micro"].mean == 0.5 and abs(got["f1_micro"].std - math.sqrt(0.5)) < 1e-6


def _rows(spark, n=400, d=5, seed=3):
    rnd = np.random.default_rng(seed)
    x = rnd.standard_normal((n, d))
    w = rnd.standard_normal((d, 3)) * 2
    y = (rnd.random((n, 3)) < 1 / (1 + np.exp(-(x @ w - 0.5)))).astype(int)
    lang = ["en" if i % 3 else "fr" for i in range(n)]
    df = spark.createDataFrame([(i, lang[i], x[i].tolist(), y[i].tolist()) for i in range(n)],
                               "id long, lang string, features array<double>, labels array<int>")
    return df, np.hstack([x, np.ones((n, 1))]), y, np.array(lang)


def _newton(x, y, reg):
    w = np.zeros((x.shape[1], y.shape[1]))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        for c in range(y.shape[1]):
            h = (x * (p[:, c] * (1 - p[:, c]))[:, None]).T @ x / len(x) + reg * np.eye(x.shape[1])
            w[:, c] -= np.linalg.solve(h, x.T @ (p[:, c] - y[:, c]) / len(x) + reg * w[:, c])
    return w


def test_models_of_all_mixes_equal_newton_fits(spark):
    df, x, y, lang = _rows(spark)
    got = md.fit_models(df, {"en": ["en"], "both": ["en", "fr"], "none": ["xx"]}, "features", "labels", "lang", 0.01, 120)
    assert set(got) == {"en", "both"}
    assert np.allclose(got["both"].weights, _newton(x, y, 0.01), atol=1e-3)
    assert np.allclose(got["en"].weights, _newton(x[lang == "en"], y[lang == "en"], 0.01), atol=1e-3)


def test_fit_beats_a_constant_on_held_out_rows(spark):
    df, _, _, _ = _rows(spark, 900)
    train, val = df.filter("id < 600"), df.filter("id >= 600")
    model = md.fit_one_vs_rest(train, "features", "labels")
    pred = md.predict_long({"all": model}, val, "id", "features", "labels")
    base = train.select(F.posexplode("labels").alias("class_idx", "y")).groupBy("class_idx").agg(F.avg("y").alias("score"))
    const = pred.drop("score").join(base, "class_idx")
    assert mt.log_loss(pred).first()[0] < 0.8 * mt.log_loss(const).first()[0]


def test_confusion_counts_add_up(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    pred = E.queries()["ml_ovr_logreg"](spark, sf)
    n = pred.select("id").distinct().count()
    conf = mt.confusion(pred.withColumn("pred", mt.threshold("score")).withColumnRenamed("class_idx", "class")).collect()
    assert n > 0 and all(r.TP + r.FP + r.FN + r.TN == n for r in conf)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["lang", "word", "df", "rank"]
