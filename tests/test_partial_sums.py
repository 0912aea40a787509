"""Work that tasks do before the exchange: vector sums, dense ids, part files, grids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models as md
from tessera.operators import vectors as vx
from tessera.operators import vocab as vb
from tessera.sources import readers as rd


def _articles(seed, n=60):
    rnd = random.Random(seed)
    vectors = {f"w{i}": [rnd.randint(-9, 9) / 4 for _ in range(3)] for i in range(20)}
    arts = {i: [f"w{rnd.randint(0, 25)}" for _ in range(rnd.randint(0, 40))] for i in range(n)}
    arts[n] = [f"w{i % 26}" for i in range(5_000)]
    return vectors, arts


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_document_vectors_equal_plain_sums(spark, batch):
    vectors, arts = _articles(4)
    v = spark.createDataFrame(list(vectors.items()), "word string, vec array<float>").repartition(5)
    a = spark.createDataFrame(list(arts.items()), "id long, toks array<string>").repartition(7)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    spark.conf.set(size, batch)
    try:
        got = {r.id: r.vec for r in vx.weighted_doc_vectors(a, "id", "toks", v, 3).collect()}
    finally:
        spark.conf.set(size, old)
    assert set(got) == {i for i, t in arts.items() if t}
    for i, vec in got.items():
        want = np.sum([vectors.get(w, [0, 0, 0]) for w in arts[i]], axis=0) / len(arts[i])
        assert np.allclose(vec, want, atol=1e-6), i


def test_a_task_sends_each_key_once_and_null_keys_are_one(spark):
    rows = [(i % 3 if i % 4 else None, [i, -i], 2) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v array<bigint>, f long").repartition(4)
    parts = vx._partial_sums(df, "k", "v", "f").select(F.spark_partition_id().alias("p"), "k", "__p").collect()
    assert len({(r.p, r.k) for r in parts}) == len(parts)
    got = {r.k: r["__s"] for r in vx._sum_partials(df, "k", "v", "f").collect()}
    want = {k: [2 * sum(v[0] for x, v, _ in rows if x == k), 2 * sum(v[1] for x, v, _ in rows if x == k)] for k in (0, 1, 2, None)}
    assert got == want
    assert vx._sum_partials(df.limit(0), "k", "v", "f").count() == 0


@pytest.mark.parametrize("partitions", [8, 200])
def test_dense_ids_do_not_depend_on_the_number_of_ranges(spark, partitions):
    df = spark.range(3_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("k"))
    words = sorted(r.k for r in df.collect())
    size = "spark.sql.shuffle.partitions"
    old = spark.conf.get(size)
    spark.conf.set(size, str(partitions))
    try:
        for kw in ({}, {"rows_per_task": 100}, {"num_partitions": partitions}):
            assert {r.k: r.idx for r in vb.dense_index(df, ["k"], "idx", **kw).collect()} == {w: i for i, w in enumerate(words)}
    finally:
        spark.conf.set(size, old)
    assert vb.dense_index(df.limit(0), ["k"], "idx").count() == 0


def test_vectors_are_written_by_several_tasks_and_read_as_one_file(spark, tmp_path):
    df = spark.range(2_000).select(F.format_string("w%05d", "id").alias("word"),
                                   F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("vec")).repartition(6)
    aqe = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(aqe)
    spark.conf.set(aqe, "false")
    try:
        rd.write_word_vectors(df, str(tmp_path / "v"))
    finally:
        spark.conf.set(aqe, old)
    files = sorted((tmp_path / "v").glob("part-*"))
    assert len(files) > 2
    lines = "".join(f.read_text() for f in files).splitlines()
    assert lines[0] == "2000 2" and lines[1:] == [f"w{i:05d} {float(i)} 0.5" for i in range(2_000)]
    for header in (True, False):
        back = rd.read_word_vectors(spark, str(tmp_path / "v"), header)
        assert back.count() == 2_000 and back.filter("word = 'w01999'").first().vec == [1999.0, 0.5]


def test_grid_is_fitted_in_the_passes_of_its_longest_setting(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    x = rnd.standard_normal((300, 4))
    y = (rnd.random((300, 2)) < 1 / (1 + np.exp(-(x @ rnd.standard_normal((4, 2)))))).astype(int)
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "features array<double>, labels array<int>")
    passes, real = [], md._sums
    monkeypatch.setattr(md, "_sums", lambda rows, make: passes.append(1) or real(rows, make))
    grid = [(0.01, 3), (0.1, 200), (0.01, 200)]
    got = md.fit_grid(df, grid, "features", "labels", tol=1e-6)
    assert list(got) == grid and len(passes) < 100                     # settled long before 200
    xs = np.hstack([x, np.ones((300, 1))])
    for reg, it in grid[1:]:
        w = got[reg, it].weights
        grad = xs.T @ (1 / (1 + np.exp(-xs @ w)) - y) / 300 + reg * w
        assert np.abs(grad).max() < 1e-5
    alone = md.fit_one_vs_rest(df, "features", "labels", 0.01, 3, tol=1e-6)
    assert np.allclose(alone.weights, got[0.01, 3].weights) and not np.allclose(alone.weights, got[0.01, 200].weights)
    assert md.fit_grid(df.limit(0), grid, "features", "labels") == {}
