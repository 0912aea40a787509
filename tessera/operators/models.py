"""Multi-label classifier on frozen averaged vectors (M1, M4, M6, M7).

The reference's one-layer model on averaged vectors is one logistic
regression per class.  All classes, and all training mixes, are fitted
together: every iteration is one pass over the training rows in which each
partition sums its gradients (features x classes numbers for each model), a
grouped sum adds them up, and the driver takes the step, so the number of
passes does not grow with classes, mixes or settings of a grid; a model that
has settled leaves the passes.  Steps use the fixed curvature
bound X'X / 4 of the logistic loss, which never overshoots and needs no line
search; X'X is summed once.  What reaches the driver is the size of the
models, whatever the rows.

Scoring applies all models in one scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import metrics as mt
from tessera.session import materialize


@dataclass
class Model:
    """Weights of one model: a row for each feature and one for the constant,
    a column for each class."""
    weights: np.ndarray


def _arrays(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack(batch["features"].to_numpy()).astype(np.float64)
    y = np.stack(batch["labels"].to_numpy()).astype(np.float64)
    return np.hstack([x, np.ones((len(x), 1))]), y


def _sums(rows: DataFrame, make) -> dict:
    """{model: summed array}: ``make(x, y, group)`` yields (model, array) of a
    batch; arrays are added up inside each task and then by position."""
    def run(batches: Iterator[pd.DataFrame]):
        total: dict = {}
        for batch in batches:
            for group, part in batch.groupby("group"):
                for model, a in make(*_arrays(part), group):
                    total[model] = total[model] + a if model in total else a
        for model, a in total.items():
            yield pd.DataFrame({"model": [model], "v": [a.ravel().tolist()]})
    summed = (rows.select("group", "features", "labels").mapInPandas(run, "model string, v array<double>")
              .select("model", F.posexplode("v").alias("i", "x")).groupBy("model", "i").agg(F.sum("x").alias("x")))
    out: dict = {}
    for r in summed.collect():                       # models x weights numbers
        out.setdefault(r["model"], {})[r["i"]] = r["x"]
    return {m: np.array([v[i] for i in range(len(v))]) for m, v in out.items()}


@dataclass(frozen=True)
class Setting:
    """What one model learns from, and how: names of groups of rows, strength
    of the regularisation, most passes."""
    groups: tuple
    reg_param: float = 1e-3
    max_iter: int = 25


def fit_settings(rows: DataFrame, settings: dict[str, Setting], features_col: str, labels_col: str, group_col: str,
                 tol: float = 1e-5) -> dict[str, Model]:
    """{name: model} of all settings, fitted in one run of passes: a pass sums
    the gradients of every model that still moves.  A model leaves the passes
    when no weight moved by more than ``tol`` in its last step, or after its
    own ``max_iter``.  Settings without rows have no model.

    The rows (group, features, multi-hot labels) are written once below the
    checkpoint folder, so a lost executor costs a re-read."""
    rows = materialize(rows.select(F.col(group_col).cast("string").alias("group"), F.col(features_col).alias("features"),
                                   F.col(labels_col).alias("labels")), "fit")
    first = rows.select(F.size("features"), F.size("labels")).first()
    if first is None:
        return {}
    d, c = first[0] + 1, first[1]
    # a group's curvature, and its number of rows, serve every setting that holds it
    curve = _sums(rows, lambda x, y, g: [(g, np.append(x.T @ x, len(x)))])
    models, before, inverse = {}, {}, {}
    for name, s in settings.items():
        total = sum(curve[g] for g in set(s.groups) if g in curve)
        if isinstance(total, np.ndarray):
            n = total[-1]
            inverse[name] = n, np.linalg.inv(total[:-1].reshape(d, d) / (4 * n) + (s.reg_param + 1e-9) * np.eye(d))
            models[name] = before[name] = np.zeros((d, c))
    moving = [m for m in models if settings[m].max_iter > 0]
    t = 0
    while moving:
        # momentum: the gradient is taken ahead of the last step
        ahead = {m: models[m] + t / (t + 3) * (models[m] - before[m]) for m in moving}
        of: dict = {}
        for m in moving:
            for g in set(settings[m].groups):
                of.setdefault(g, []).append(m)

        def gradients(x, y, g, ahead=ahead, of=of):
            return [(m, x.T @ (1 / (1 + np.exp(-np.clip(x @ ahead[m], -30, 30))) - y)) for m in of.get(g, ())]
        # rows that no moving model learns from are not read
        sums = _sums(rows.filter(F.col("group").isin(*of)), gradients)
        t += 1
        still = []
        for m in moving:
            n, inv = inverse[m]
            new = ahead[m] - inv @ (sums[m].reshape(d, c) / n + settings[m].reg_param * ahead[m])
            step = float(np.abs(new - models[m]).max())
            before[m], models[m] = models[m], new
            if step > tol and t < settings[m].max_iter:
                still.append(m)
        moving = still
    return {m: Model(w) for m, w in models.items()}


def fit_models(rows: DataFrame, mixes: dict, features_col: str, labels_col: str, group_col: str,
               reg_param: float = 1e-3, max_iter: int = 25, tol: float = 1e-5) -> dict[str, Model]:
    """{mix: model}: ``mixes`` names the groups (e.g. languages) whose rows
    each model learns from; labels are multi-hot arrays."""
    return fit_settings(rows, {m: Setting(tuple(gs), reg_param, max_iter) for m, gs in mixes.items()},
                        features_col, labels_col, group_col, tol)


def fit_grid(train: DataFrame, grid, features_col: str, labels_col: str, tol: float = 1e-5) -> dict[tuple, Model]:
    """{(reg_param, max_iter): model} of a grid, all in the same passes over
    all rows; as many passes as the longest setting needs."""
    rows = train.select(F.lit("all").alias("__g"), features_col, labels_col)
    names = {f"{i}": s for i, s in enumerate(grid)}
    got = fit_settings(rows, {k: Setting(("all",), *s) for k, s in names.items()}, features_col, labels_col, "__g", tol)
    return {names[k]: m for k, m in got.items()}


def fit_one_vs_rest(train: DataFrame, features_col: str, labels_col: str, reg_param: float = 1e-3,
                    max_iter: int = 25, tol: float = 1e-5) -> Model | None:
    """One logistic regression per class on all rows; None without rows."""
    return fit_grid(train, [(reg_param, max_iter)], features_col, labels_col, tol).get((reg_param, max_iter))


def predict_long(models: dict[str, Model], df: DataFrame, id_col: str, features_col: str, labels_col: str,
                 keep=()) -> DataFrame:
    """Scores of every model in long form (model, id, *keep, class_idx, score,
    y), all models in one scan; models x classes rows for each article."""
    names = list(models)
    weights = [m.weights for m in models.values()]
    cols = [id_col, *keep]
    src = df.select(*cols, F.col(features_col).alias("features"), F.col(labels_col).alias("labels"))
    schema = ", ".join(["model string", *[f"{f.name} {f.dataType.simpleString()}" for f in src.select(*cols).schema],
                        "scores array<double>", "labels array<int>"])

    def run(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            if len(batch):
                x, _ = _arrays(batch)
                for name, w in zip(names, weights):
                    scores = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                    yield pd.concat([pd.DataFrame({"model": name}, index=batch.index), batch[cols],
                                     pd.DataFrame({"scores": list(scores), "labels": batch["labels"]}, index=batch.index)], axis=1)
    return (src.mapInPandas(run, schema)
            .select("model", *cols, F.posexplode(F.arrays_zip("scores", "labels")).alias("class_idx", "__z"))
            .select("model", *cols, "class_idx", F.col("__z.scores").alias("score"), F.col("__z.labels").cast("int").alias("y")))


def evaluate(pred: DataFrame, threshold: float = 0.5, by=()) -> DataFrame:
    """Micro/macro scores of long predictions (M2 + A16), per ``by``."""
    p = pred.withColumn("pred", mt.threshold("score", threshold)).withColumnRenamed("class_idx", "class")
    return mt.micro_macro(mt.confusion(p, by=by), by=by)
