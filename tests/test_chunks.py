"""What travels when articles are looked up, summed, ranked and padded: distinct words of a chunk, not a row per token."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import lookup as lu
from tessera.operators import stats as st
from tessera.operators import vectors as vx
from tessera.operators import vocab as vb


@pytest.fixture
def articles(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["en", "fr"]), [f"w{int(rnd.expovariate(0.2))}" for _ in range(rnd.randint(0, 60))]) for i in range(300)]
    return rows, spark.createDataFrame(rows, "id long, lang string, toks array<string>").repartition(5)


def test_lookup_sends_a_chunks_words_once(spark, articles, monkeypatch):
    rows, df = articles
    monkeypatch.setattr(lu, "CHUNK", 500)
    sent, real = [], lu.chunk_words
    monkeypatch.setattr(lu, "chunk_words", lambda *a: sent.append(real(*a)) or sent[-1])
    table = spark.createDataFrame([(g, f"w{k}", 100 * len(g) * (g == "fr") + k) for g in ("en", "fr") for k in range(0, 40, 2)],
                                  "lang string, word string, v long")
    found = lu.lookup_tokens(df, "id", "toks", table, F.col("v"), ["lang"], extra=["lang"])
    number = {(r.lang, r.word): r.v for r in table.collect()}
    assert {r.id: [tuple(s) for s in r["__s"]] for r in found.collect()} == {
        i: [(p, t, number.get((g, t))) for p, t in enumerate(toks)] for i, g, toks in rows}
    words = sent[0].collect()
    assert len(words) == len(set(words)) and len({w["__chunk"] for w in words}) > 8
    assert len(words) < sum(len(t) for _, _, t in rows) / 2


def test_rows_of_one_article_make_one_list(spark):
    rows = [(1, ["b", "a"]), (1, ["a", "c", None]), (None, ["a"]), (None, ["z"]), (2, []), (2, None), (3, ["z"])]
    df = spark.createDataFrame(rows, "id long, toks array<string>")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "word string, v long")
    got = {r.id: [tuple(s) for s in r["__s"]] for r in lu.lookup_tokens(df, "id", "toks", table, F.col("v")).collect()}
    assert got == {1: [(0, "a", 1), (0, "b", 2), (1, "a", 1), (1, "c", None), (2, None, None)],
                   None: [(0, "a", 1), (0, "z", None)], 2: [], 3: [(0, "z", None)]}


def test_decode_in_chunks(spark, articles, monkeypatch):
    rows, df = articles
    monkeypatch.setattr(lu, "CHUNK", 500)
    voc = vb.vocab_per_group(df, "lang", "toks")
    enc = vb.encode_ids(df, voc, "id", "toks", "ids", by=["lang"], unique_words=True)
    got = {r.id: r.text for r in vb.decode_ids(enc, voc, "id", "ids", by=["lang"]).collect()}
    assert got == {i: " ".join(t) for i, _, t in rows}


def test_vectors_are_added_up_before_they_travel(spark, articles, monkeypatch):
    rows, df = articles
    sent, real = [], vx._sum_partials
    monkeypatch.setattr(vx, "_sum_partials", lambda d, *a: sent.append(d.count()) or real(d, *a))
    monkeypatch.setattr(vx, "PAIRS", 7)
    vec = {f"w{k}": [k / 4, -1.0] for k in range(0, 30, 3)}
    v = spark.createDataFrame([*vec.items(), ("w3", [1.0, 1.0]), ("w1", None)], "word string, vec array<float>")       # a word twice adds up
    got = {r.id: r.vec for r in vx.weighted_doc_vectors(df, "id", "toks", v, 2, by=["lang"]).collect()}
    vec["w3"] = [vec["w3"][0] + 1, 0.0]
    for i, _, toks in rows:
        if toks:
            want = [sum(vec.get(t, [0, 0])[k] for t in toks) / len(toks) for k in (0, 1)]
            assert got[i] == pytest.approx(want, abs=1e-6)
    assert sent[0] <= len(rows)


def test_ranked_terms_stay_in_their_chunk(spark, articles):
    rows, df = articles
    w = df.withColumn("w", F.transform("toks", lambda x, i: (F.size("toks") - i).cast("double")))
    for top in (st.word_weight_top(w, "id", "w", "toks", 3), st.tfidf_top(df, "id", "toks", 3)):
        assert "hashpartitioning(id" not in top._jdf.queryExecution().executedPlan().toString()
    weights = {}
    for i, _, toks in rows:
        places = {t: [len(toks) - p for p, x in enumerate(toks) if x == t] for t in toks}
        weights[i] = sorted(places, key=lambda t: (-sum(places[t]) / len(places[t]), t))[:3]
    got = {}
    for r in st.word_weight_top(w, "id", "w", "toks", 3).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.word)
    assert got == {i: t for i, t in weights.items() if t}


def test_padding_sorts_no_lists(spark, monkeypatch):
    seen, real = [], vb.dense_index
    monkeypatch.setattr(vb, "dense_index", lambda d, *a, **b: seen.append(d.columns) or real(d, *a, **b))
    rows = [(i, list(range(i % 5))) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, ids array<bigint>").repartition(3)
    got = {r.id: (r.batch, r.position, r.ids) for r in vb.pad_batches(df, "id", ["ids"], 4).collect()}
    most = [max(len(rows[i][1]) for i in range(b * 4, b * 4 + 4)) for b in range(5)]
    assert got == {i: (i // 4, i, ids + [0] * (most[i // 4] - len(ids))) for i, ids in rows}
    assert all("ids" not in c for c in seen)
