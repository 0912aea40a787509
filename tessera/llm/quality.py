"""Document quality by hierarchical empirical Bayes.

Evidence: a logistic model over character-class shares, repetition and word
shape gives each whole text a probability of being good; its log odds less
those of the base rate are the document's own evidence.

Priors: documents of one site tend to be alike.  The probabilities are summed
per path and per host by grouped aggregation; how far hosts differ from the
corpus, and paths from their host, is estimated by the method of moments for
beta-binomial groups, which gives the strength with which a host is shrunk
towards the global rate and a path towards its host.  Sparse sites keep their
parents' rate.  A document's own probability is left out of its prior.

Score: the logistic of evidence plus the log odds of the path's rate.

Sums are folded before the shuffle, so a host with a third of all documents
costs one row from each task.  Features are computed in one pass over the
text for the sums and in another for the scores; texts never move unless the
table of paths is too large to broadcast, which Spark decides by its size.

Null and empty texts have zero features and are scored like any other; null
hosts or paths are the site ""; null ids are never training rows; repeated
rows count each; an empty table gives an empty table; columns of the input
that have the name of an output column are replaced.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_columns, materialize
from tessera.llm.labelled import fit_curve, held_out_fold, training_rows

OUTPUT = ("evidence", "host_rate", "path_rate", "score", "good")
_SYMBOLS = b"#$%&*+<=>@[\\]^_`{}~"


def _classes() -> np.ndarray:
    """Byte value -> character classes, one column each."""
    of = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32),
          "mark": b"!?", "stop": b".,;:", "bar": b"|", "symbol": _SYMBOLS, "other": range(128, 256)}
    out = np.zeros((256, len(of)))
    for j, chars in enumerate(of.values()):
        out[list(chars), j] = 1
    return out


_CLASSES = _classes()


def features(text: bytes | None) -> np.ndarray:
    """Shares of character classes, repetition of lines and words, word shape, length."""
    if not text:
        return np.zeros(_CLASSES.shape[1] + 7)
    n = len(text)
    share = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) @ _CLASSES / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    words = text.split()
    k = max(1, len(words))
    return np.concatenate((np.sqrt(share), (
        1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(words)) / k, np.log1p(n) / 10, np.log1p(len(lines)) / 5,
        len(b"".join(words)) / k / 20, np.sqrt(text.count(b"!!") / k), share[1] / (share[0] + share[1] + 1e-9))))


def _expanded(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, x * x])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((_expanded(x) - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def train(texts: list[str], labels: list[int], base_rate: float | None = None) -> Model:
    y = np.asarray(labels, dtype=np.float64)
    base = base_rate if base_rate is not None else y.mean() if len(y) else 0.5
    base = float(np.clip(base, 1e-3, 1 - 1e-3))
    width = 2 * (_CLASSES.shape[1] + 7)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(width), np.ones(width), np.r_[np.zeros(width), np.log(base / (1 - base))], base)
    x = _expanded(np.stack([features(t.encode("utf-8", "replace")) for t in texts]))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    balance = np.where(y == 1, base / (y == 1).sum(), (1 - base) / (y == 0).sum()) * len(y)
    return Model(mean, scale, fit_curve(np.clip((x - mean) / scale, -8, 8), y, balance, ridge=0.3), base)


def fit(docs: DataFrame, labels: DataFrame, good_docs: int = 2000, bad_docs: int = 2000) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    texts, y, rate = training_rows(docs, labels, "quality", good_docs, bad_docs)
    return train(texts, y, rate)


def with_probability(df: DataFrame, model: Model, text_col: str, out: str) -> DataFrame:
    """``df`` plus the classifier's probability of each whole text.  Only the
    text goes to the workers and only the number comes back."""
    blob = pickle.dumps(model)

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pickle.loads(blob)
        for texts in parts:
            x = [features(t.encode("utf-8", "replace") if t is not None else None) for t in texts]
            yield pd.Series(own.probability(np.stack(x)) if x else np.zeros(0))
    return df.withColumn(out, probability(F.col(text_col).cast("string")))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(spread: float, groups: float, variance: float, room: float) -> float:
    """Beta strength from the spread of group means: ``variance`` is that of
    one document, ``room`` the documents less those that fix the means."""
    if not room or room <= 0 or not variance:
        return 1e6
    rho = (spread - variance * groups) / (variance * room)
    return float(1 / np.clip(rho, 1e-6, 0.9) - 1)


def site_rates(rows: DataFrame) -> tuple[DataFrame, dict]:
    """Rows (host, path, p) -> one row for each path with the sums of its
    host, and the global rate and the two strengths."""
    # one row for each path, written once: the aggregates below would each score all texts again
    paths = materialize(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.count(F.lit(1)).alias("paths"),
                                      F.sum(F.col("n") * F.col("n")).alias("nn"))
    t = hosts.agg(F.sum("hn"), F.sum("hs"), F.count(F.lit(1)), F.sum(F.col("hn") * F.col("hn"))).first()
    n = t[0] or 0
    rate = t[1] / n if n else 0.5
    between = hosts.agg(F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn") - rate, 2))).first()[0] or 0.0
    sites = paths.join(hosts, "host")
    m = F.col("hs") / F.col("hn")
    within = sites.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - m, 2)), F.avg(m * (1 - m))).first()
    room = hosts.agg(F.sum(F.col("hn") - F.col("nn") / F.col("hn") - (F.col("paths") - 1)), F.sum(F.col("paths") - 1)).first()
    variance = rate * (1 - rate)
    strengths = {"rate": rate,
                 "host": _strength(between, t[2] - 1, variance, n - (t[3] / n if n else 0) - (t[2] - 1)),
                 "path": _strength(within[0] or 0.0, room[1] or 0, within[1] or variance, room[0])}
    return sites.select("host", "path", "n", "s", "hn", "hs"), strengths


def classify(df: DataFrame, model: Model, text_col: str = "text", host: Column | None = None,
             path: Column | None = None) -> DataFrame:
    """``df`` plus evidence, host_rate, path_rate, score and good (score >=
    0.5).  By default the host is ``source`` up to a slash and the path is
    ``source`` with ``lang``."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if host is None else None
    host = F.split_part(source, F.lit("/"), F.lit(1)) if host is None else F.coalesce(host.cast("string"), F.lit(""))
    path = (F.concat_ws("/", source, F.coalesce(F.col("lang").cast("string"), F.lit(""))) if path is None
            else F.coalesce(path.cast("string"), F.lit("")))
    base = drop_columns(df, *OUTPUT)
    inner = ("__host", "__path")
    keyed = base.select("*", host.alias(inner[0]), path.alias(inner[1]))
    narrow = with_probability(keyed.select(F.col(inner[0]).alias("host"), F.col(inner[1]).alias("path"),
                                           F.col(text_col).alias("text")), model, "text", "p")
    sites, g = site_rates(narrow.select("host", "path", "p"))
    sites = sites.select(F.col("host").alias(inner[0]), F.col("path").alias(inner[1]), *[F.col(c).alias(f"__{c}") for c in ("n", "s", "hn", "hs")])
    p = F.col("__p")
    host_rate = (g["host"] * g["rate"] + F.col("__hs") - p) / (g["host"] + F.col("__hn") - 1)
    scored = with_probability(keyed, model, text_col, "__p").join(sites, [inner[0], inner[1]])
    scored = scored.withColumns({"evidence": _logit(p) - float(np.log(model.base / (1 - model.base))), "host_rate": host_rate})
    scored = scored.withColumn("path_rate", (g["path"] * F.col("host_rate") + F.col("__s") - p) / (g["path"] + F.col("__n") - 1))
    scored = scored.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_rate"))))))
    return scored.withColumn("good", F.col("score") >= 0.5).select(*base.columns, *OUTPUT)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, and the columns of ``classify``."""
    rows = docs.select("doc_id", "text", "source", "lang")
    out = classify(rows, fit(docs, labels))
    return out.select("doc_id", held_out_fold(F.col("doc_id")).alias("held_out"), *OUTPUT)
