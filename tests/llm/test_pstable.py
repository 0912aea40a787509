"""p-stable classes and link counts against brute force."""

import numpy as np
import pytest

from tessera.llm import pstable
from test_minhash import components_of


def brute(rows):
    units = [(i, pstable.unit_vector(v)) for i, v in rows]
    links = []
    counts = {i: 0 for i, _ in rows}
    for x, (i, u) in enumerate(units):
        for j, w in units[:x]:
            if u is not None and w is not None and len(u) == len(w) and float(u @ w) >= 0.9:
                links.append((i, j))
                counts[i] += 1
                counts[j] += 1
    return counts, components_of([i for i, _ in rows], links)


def vectors(n=300, dim=16, seed=4):
    rnd = np.random.default_rng(seed)
    base = rnd.standard_normal((12, dim))
    rows = []
    for i in range(n):
        v = base[i % 12] + rnd.standard_normal(dim) * rnd.choice([0.0, 0.1, 0.25]) if i % 2 else rnd.standard_normal(dim)
        rows.append((i, [float(x) for x in (v * rnd.choice([1.0, 2.0])).astype(np.float32)]))
    return rows + [(n, None), (n + 1, [0.0] * dim), (n + 2, [1.0, None] + [0.0] * (dim - 2)), (n + 3, [float("nan")] * dim),
                   (n + 4, []), (n + 5, rows[1][1]), (n + 6, rows[1][1]), (n + 7, [float("inf")] * dim), (n + 8, rows[1][1][:5])]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_counts_and_classes_against_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(pstable, "BUCKET_BLOCK", 3)
        monkeypatch.setattr(pstable, "PAIR_BLOCK", 4)
    rows = vectors()
    df = spark.createDataFrame([(i, v, i, "k") for i, v in rows], "vec_id long, embedding array<float>, label int, key string")
    got = {r.vec_id: r for r in pstable.near_vectors(df).collect()}
    counts, comp = brute(rows)
    assert set(got) == set(counts)
    found, there = sum(r.n_links for r in got.values()), sum(counts.values())
    assert there > 1000 and 0.97 * there <= found <= there
    assert all(got[i].n_links <= counts[i] for i in counts)
    assert np.mean([got[i].component_id == comp[i] for i in counts]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_null_ids_repeats_and_empty_tables(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(None, v), (5, v), (5, v), (9, v)], "vec_id long, embedding array<double>")
    rows = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in pstable.near_vectors(df).collect()))
    assert rows == [(0, 0, None, True), (5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False)]
    assert pstable.near_vectors(df.limit(0)).count() == 0


def test_eight_bit_filter_never_drops_a_link():
    rnd = np.random.default_rng(2)
    for dim in (2, 64, 300):
        u = [pstable.unit_vector(x) for x in rnd.standard_normal((200, dim)) * rnd.exponential(1, (200, dim)) ** 3]
        u += [pstable.unit_vector(x + rnd.standard_normal(dim) * 0.05) for x in u]
        block = pstable.EightBit([pstable.eight_bit(x) for x in u], 0.9)
        exact = np.stack(u) @ np.stack(u).T >= 0.9
        for i in range(len(u)):
            assert block.linked(i, np.arange(len(u)))[exact[i]].all()
