"""Skewed inputs: one hot key / word / group holding a third of the rows
must give the same answer as brute force."""

from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import rows as rw
from tessera.operators import vocab as vb
from tessera.operators.text_ops import drop_rare_words


def _docs():
    docs = []
    for i in range(60):
        toks = ["hot"] * 20 + [f"w{i % 7}", f"w{i % 11}", "hot"] + ([f"r{i}"] if i % 5 == 0 else [])
        docs.append((i, toks))
    return docs


def test_encode_with_hot_word(spark):
    docs = _docs()
    df = spark.createDataFrame(docs, "id long, toks array<string>")
    voc = vb.build_vocab(df, "toks", prefix=(vb.PAD, vb.UNK))
    ids = {r.word: r.idx for r in voc.collect()}
    got = {r.id: r.ids for r in vb.encode_ids(df, voc, "id", "toks", "ids").collect()}
    assert got == {i: [ids[t] for t in toks] for i, toks in docs}


def test_rare_words_with_hot_word(spark):
    docs = _docs()
    counts = Counter(t for _, toks in docs for t in toks)
    df = spark.createDataFrame(docs, "id long, toks array<string>")
    got = {r.id: r.toks for r in drop_rare_words(df, "id", "toks", min_count=6).collect()}
    assert got == {i: [t for t in toks if counts[t] >= 6] for i, toks in docs}


def test_alignment_with_hot_key(spark):
    rows = [(1, "en")] * 300 + [(1, "ru")] * 5 + [(k, "en") for k in range(2, 200)] + [(k, "ru") for k in range(100, 400)]
    df = spark.createDataFrame(rows, "key long, part string")
    got = Counter((r.key, r.part) for r in rw.align(df, "key", "part").collect())
    keys = {k for k, _ in rows if (k, "en") in set(rows) and (k, "ru") in set(rows)}
    assert got == Counter(r for r in rows if r[0] in keys)
