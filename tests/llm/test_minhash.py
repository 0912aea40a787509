"""MinHash classes and the block linker against brute force."""

import random
import re
from functools import partial

import numpy as np
import pytest

from tessera.llm import components, minhash
from tessera.llm.queries import LLM_QUERIES

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    where = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    links = []
    for k, (i, s) in enumerate(sets):
        near = {j for x in s for j in where[x] if j < k}
        for j in near:
            both = len(s & sets[j][1])
            if 100 * both >= 75 * (len(s) + len(sets[j][1]) - both):
                links.append((i, sets[j][0]))
    return {i: len(s) for i, s in sets}, components_of([i for i, _ in rows], links)


def corpus(seed=3, n=160):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["Éa", "éA", "ÀB"]
    rows, base = [], []
    for i in range(n):
        kind = rnd.random()
        if base and kind < 0.5:
            w = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        else:
            w = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 5, 30, 80, 120]))]
        base.append(w)
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(x.upper() if rnd.random() < 0.1 and x.isascii() else x for x in w)))
    return rows + [(n, ""), (n + 1, None), (n + 2, " \n "), (n + 3, rows[5][1]), (n + 4, "x " * 30_000)]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_classes_equal_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:                       # every group of several rows then spans several blocks
        monkeypatch.setattr(minhash, "SIGNATURE_BLOCK", 3)
        monkeypatch.setattr(minhash, "SET_BLOCK", 2)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, sig string, component string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    sizes, comp = brute(rows)
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert {i: r.component_id for i, r in got.items()} == comp
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_query_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in LLM_QUERIES["op7_minhash"](spark, sf).collect()}
    sizes, comp = brute(rows)
    assert got == {i: (sizes[i], comp[i]) for i, _ in rows}


def test_null_ids_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "q r"), (None, None)],
                               "doc_id long, text string")
    rows = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()]
    assert sorted(rows, key=str) == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (None, None, True), (None, None, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_link_blocks_loses_no_link_in_large_groups(spark):
    rnd = np.random.default_rng(0)
    sets = {}
    for i in range(400):
        g = int(rnd.integers(0, 3))
        core = set(range(g * 1000, g * 1000 + 40)) if i % 3 else set(rnd.integers(0, 10 ** 6, 40).tolist())
        drop = set(rnd.choice(sorted(core), int(rnd.integers(0, 7)), replace=False).tolist())
        sets[i] = np.unique(np.array(sorted(core - drop) + rnd.integers(10 ** 7, 10 ** 8, 2).tolist(), dtype=np.uint64))
    df = spark.createDataFrame([(0, i, s.tobytes()) for i, s in sets.items()], "g long, id long, p binary")
    edges = components.link_blocks(components.deal(df, 16), partial(components.Sets, percent=75), 16)
    got = {r.id: r.component for r in components.connected_components(edges).collect()}
    links = [(i, j) for i in sets for j in sets if i < j
             and 100 * (b := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - b)]
    want = components_of(sets, links)
    assert {i: got.get(i, i) for i in sets} == want
    assert all(want[a] == want[b] for a, b in ((r.a, r.b) for r in edges.collect()))


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1500)] + [(None, 3), (7, 7)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r.id: r.component for r in components.connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1500)}}
    assert components.connected_components(df.limit(0)).count() == 0


def test_estimate_is_corrected_for_chance():
    rnd = np.random.default_rng(1)
    for j in (0.2, 0.75, 0.9):
        n = 4000
        both = int(2 * n * j / (1 + j))
        items = rnd.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = np.unique(items[:n]), np.unique(np.concatenate((items[:both], items[n:2 * n - both])))
        s = [np.frombuffer(minhash.signature(minhash.minima(x)), dtype=np.uint64) for x in (a, b)]
        equal = 1 - components.differing_lanes(s[0], s[1]) / minhash.MINIMA
        assert abs((equal - 1 / 16) / (15 / 16) - j) < 0.15


@pytest.mark.parametrize("order", [1, -1])
def test_repeated_ids_with_other_and_empty_texts(spark, order):
    base = [f"w{k}" for k in range(60)]
    far = " ".join(f"z{k}" for k in range(50))
    rows = [(1, " ".join(base)), (1, None), (2, " ".join(base[:-1] + ["x"])), (1, " "), (5, far), (5, ""), (6, far + " y"), (7, " ".join(base[2:]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows[::order], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(
        [(1, 56, 1), (1, 0, 1), (2, 56, 1), (1, 0, 1), (5, 46, 5), (5, 0, 5), (6, 47, 5), (7, 54, 1)])
