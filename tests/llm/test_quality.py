"""Quality scores against plain Python, and held-out accuracy."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import quality as q
from tessera.llm.queries import LLM_QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in LLM_QUERIES["op4_quality"](spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(int(rows[r.doc_id].good), r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert np.mean([p == t for p, t in held]) >= 0.95


def site_rows(spark):
    rnd = np.random.default_rng(1)
    rows = []
    for i in range(400):
        host = "big" if i % 3 == 0 else f"h{i % 17}"
        bad = rnd.random() < (0.8 if host in ("h1", "h2") else 0.1)
        rows.append((i, "###*** $$$ @@" if bad else "the quiet river runs past the mill", host, "en" if i % 2 else "fr"))
    rows += [(None, None, None, None), (900, "", "lone", "en"), (900, "", "lone", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), rows


def model():
    texts = ["the quiet river runs past the mill", "###*** $$$ @@ 12"] * 10
    return q.train(texts, [1, 0] * 10, 0.8)


def test_rates_equal_their_formulas(spark):
    df, rows = site_rows(spark)
    m = model()
    p = {i: float(m.probability(q.features((t or "").encode())[None])[0]) for i, t, _, _ in rows}
    host, path, nn = defaultdict(list), defaultdict(list), defaultdict(float)
    for i, t, s, lang in rows:
        host[s or ""].append(p[i])
        path[(s or "", f"{s or ''}/{lang or ''}")].append(p[i])
    n, total = len(rows), sum(map(sum, host.values()))
    mu = total / n
    H = len(host)

    def strength(spread, groups, var, room):
        return 1 / min(max((spread - var * groups) / (var * room), 1e-6), 0.9) - 1
    kh = strength(sum(len(v) * (np.mean(v) - mu) ** 2 for v in host.values()), H - 1, mu * (1 - mu),
                  n - sum(len(v) ** 2 for v in host.values()) / n - (H - 1))
    for (h, _), v in path.items():
        nn[h] += len(v) ** 2
    P = {h: sum(1 for k in path if k[0] == h) for h in host}
    kp = strength(sum(len(v) * (np.mean(v) - np.mean(host[h])) ** 2 for (h, _), v in path.items()),
                  sum(P[h] - 1 for h in host), np.mean([np.mean(host[h]) * (1 - np.mean(host[h])) for h, _ in path]),
                  sum(len(v) - nn[h] / len(v) - (P[h] - 1) for h, v in host.items()))
    got = {r.doc_id: r for r in q.classify(df, m).collect()}
    logit = lambda x: math.log(x / (1 - x))
    for i, t, s, lang in rows:
        h, own = s or "", p[i]
        v = path[(h, f"{h}/{lang or ''}")]
        th = (kh * mu + sum(host[h]) - own) / (kh + len(host[h]) - 1)
        tp = (kp * th + sum(v) - own) / (kp + len(v) - 1)
        assert got[i].host_rate == pytest.approx(th, rel=1e-6) and got[i].path_rate == pytest.approx(tp, rel=1e-6)
        clip = min(max(own, 1e-6), 1 - 1e-6)
        assert got[i].evidence == pytest.approx(logit(clip) - logit(0.8), rel=1e-6)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(got[i].evidence + logit(min(max(tp, 1e-6), 1 - 1e-6))))), rel=1e-6)
    assert got[1].host_rate < got[3].host_rate        # a bad site pulls its documents down


def test_clashing_columns_no_labels_and_empty_tables(spark):
    df, _ = site_rows(spark)
    from pyspark.sql import functions as F
    clash = df.withColumn("score", F.lit("x")).withColumn("n", F.lit(1)).withColumn("p", F.lit(2)).withColumn("host", F.lit(3))
    out = q.classify(clash, model())
    assert out.count() == 403 and out.schema["score"].dataType.simpleString() == "double" and "host" in out.columns
    assert q.classify(df.limit(0), model()).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert all(abs(r.evidence) < 1e-9 for r in q.quality_scores(df, labels).collect())
