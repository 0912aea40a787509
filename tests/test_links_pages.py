"""Bracket matching, paged link lists, frequent words and split points against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import links as lk
from tessera.operators import lookup as lu
from tessera.operators import splits as sp
from tessera.operators import vocab as vb


def links_of(text):
    """Links of a text by a stack, character by character."""
    if text is None:
        return None
    events, i = {}, 0
    while i < len(text):
        if text[i] == "[":
            n = len(text) - i - len(text[i:].lstrip("["))
            for k in range(n % 2, n - 1, 2):
                events[i + k] = "open"
            i += n
        elif text.startswith("]]", i):
            events[i] = "close"
            i += 2
        else:
            i += 1
    stack, found = [], []
    for at in sorted(events):
        if events[at] == "open":
            stack.append(at)
        elif stack:
            found.append((stack.pop(), at + 2))
    return [text[s:e] for s, e in sorted(found)]


def test_links_of_any_depth_equal_a_stack(spark):
    rnd = random.Random(4)
    parts = ["[[", "]]", "[", "]", "a", "b|c", "\n", " é\U0001f600", lk.CUT, "File:x.png|"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    texts += [None, "", "[[a]]", "[[[[a]] b]]", "[[[x]]]", "[[" * 60 + "deep" + "]]" * 60, "[[File:a|thumb|of {{x}} [[b|c [[d]] e]] [f] ]] end ]] [[open"]
    texts += [" ".join(f"[[t{k}|x [[u{k}]]]]" for k in range(700))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.l for r in df.select("id", lk.extract_links("t").alias("l")).collect()}
    assert got == {i: links_of(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("page", [4096, 3])
def test_paged_lists_of_a_hub(spark, page):
    rnd = random.Random(1)
    lists = {("in", q): [rnd.randrange(50) for _ in range(2000 if q == 1 else rnd.randrange(9))] for q in range(40)}
    lists |= {("out", q): [rnd.randrange(50) for _ in range(rnd.randrange(9))] for q in range(40)}
    rows = {s: spark.createDataFrame([(q, p, x) for (t, q), v in lists.items() if t == s for p, x in enumerate(v)], "qid long, pos int, pid long").repartition(5)
            for s in ("in", "out")}
    out = spark.createDataFrame([(q, [str(x) for x in lists["out", q]]) for q in range(40)], "qid long, l array<string>")
    assert sorted(lk.list_pages(out, "out", "l", page=page).collect()) == sorted(lk.link_pages(rows["out"], "out", page=page).collect())
    pages = lk.link_pages(rows["in"], "in", page=page).unionByName(lk.list_pages(out, "out", "l", page=page))
    assert pages.agg(F.max(F.size("ids"))).first()[0] <= page
    kept = lk.with_both_sides(pages)
    vocab = vb.build_vocab(kept, "ids", prefix=(vb.PAD, vb.UNK))
    number = {r.word: r.idx for r in vocab.collect()}
    got = {r.qid: (r.in_ids, r.out_ids) for r in lk.whole_lists(lk.encode_pages(kept, vocab)).collect()}
    assert got == {q: tuple([number[str(x)] for x in lists[s, q]] for s in ("in", "out")) for q in range(40) if lists["in", q] and lists["out", q]}


def test_frequent_words_are_few_and_values_whole(spark, monkeypatch):
    docs = [(i, ["hot"] * 30 + [f"w{i % 13}", None, f"rare{i}", "x" * 70] * (i % 3)) for i in range(200)] + [(900, []), (901, None)]
    df = spark.createDataFrame(docs, "id long, toks array<string>")
    table = spark.createDataFrame([("hot", 1), ("x" * 70, 2)] + [(f"w{k}", 10 + k) for k in range(0, 13, 2)], "word string, v long")
    value = {r.word: r.v for r in table.collect()}
    for share in (1, 3, 20, 100_000):
        few = lu.word_occurrences(df, "toks", share=share)
        assert few.count() <= share and few.filter("word = 'hot'").count() == 1 - (share == 1)
        got = {r.id: [(s.pos if "pos" in s else s[0], s.word, s.value) for s in r["__s"]] for r in
               lu.lookup_tokens(df, "id", "toks", table, F.col("v"), frequent=few).collect()}
        assert got == {i: [(p, t, value.get(t)) for p, t in enumerate(toks or [])] for i, toks in docs}


def test_hot_word_stays_in_its_tasks(spark):
    """A word with a third of all occurrences goes through no exchange by word."""
    df = spark.createDataFrame([(i, ["hot", f"a{i}", f"b{i}"]) for i in range(3000)], "id long, toks array<string>").repartition(8)
    few = lu.word_occurrences(df, "toks", share=100)
    pos = df.select("id", F.explode("toks").alias("w"))
    near, far = lu.with_values(pos, pos.select(F.col("w").alias("word")).distinct(), None, (), "w", "word", frequent=few)
    assert near.count() == 3000 and far.filter("w = 'hot'").count() == 0 and far.count() == 6000
    tasks = far.repartition(8, "w").groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = sorted(r["count"] for r in tasks)
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("digits,few", [(4, 4096), (1, 2), (2, 1)])
def test_cut_points_equal_sorting(spark, monkeypatch, digits, few):
    monkeypatch.setattr(sp, "DIGITS", digits)
    monkeypatch.setattr(sp, "FEW", few)
    for n in (0, 1, 2, 777):
        df = spark.range(n).withColumn("id", F.col("id") * 3)
        order = sorted(hashlib.md5(f"9:{3 * i}".encode()).hexdigest() for i in range(n))
        places = [-1, 0, 1, n // 3, n // 3, n - 1, n, n + 5]
        want = [order[min(k, n) - 1] if min(k, n) > 0 else None for k in places]
        assert sp.cut_points(df, sp.seeded_key("id", 9), lambda m: places) == want


def test_split_keeps_repeated_ids_together_without_exchange(spark):
    df = spark.createDataFrame([(i % 50,) for i in range(500)] + [(None,)], "id long")
    out = sp.split_80_10_10(df, "id", seed=2)
    assert out.count() == 501 and out.filter("id is not null").groupBy("id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert out.filter("split = 'train'").count() == 400 and out.filter("id is null").first().split == "test"
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
