"""Template decontamination against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam as dc
from tessera.llm.queries import LLM_QUERIES


def words_of(text):
    t = (text or "").translate({ord(c): " " for c in dc._DROPPED})
    t = t.translate({ord(c): dc.END for c in dc._ENDS})
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w.replace(dc.END, "")]


def template_of(words):
    out = []
    for i, w in enumerate(words):
        bare = w.replace(dc.END, "")
        low, before = bare.lower(), words[i - 1] if i else dc.END
        if "0" <= low[:1] <= "9" or low in dc.NUMBER_WORDS:
            out.append(dc.NUMBER)
        elif low in dc.UNITS and (low not in dc.AFTER_NUMBER or "0" <= before[:1] <= "9"):
            out.append(dc.UNIT)
        elif bare[:1] != low[:1] and len(bare) > 1 and bare[1:] == low[1:] and dc.END not in before:
            out.append(dc.NAME)
        else:
            out.append(low)
    return out


def brute(docs, items):
    slots = {dc.NUMBER, dc.UNIT, dc.NAME}
    where, total = {}, {}
    for b, text in items:
        w = words_of(text)
        t = template_of(w)
        n = min(len(t), dc.WINDOW)
        for p in range(len(t) - n + 1) if n else ():
            if sum(x not in slots for x in t[p:p + n]) >= min(n, dc.LEAST_LITERALS):
                where.setdefault(tuple(t[p:p + n]), []).append((b, p, w))
                total[b] = total.get(b, 0) + 1
    found = {}
    for d, text in docs:
        w = words_of(text)
        t = template_of(w)
        lines = {}
        for n in range(1, dc.WINDOW + 1):
            for p in range(len(t) - n + 1):
                for b, q, bw in where.get(tuple(t[p:p + n]), ()):
                    values, places = lines.setdefault((b, p - q), ({}, set()))
                    places.add(q)
                    for j in range(n):
                        if t[p + j] in slots:
                            values.setdefault(bw[q + j].replace(dc.END, "").lower(), set()).add(w[p + j].replace(dc.END, "").lower())
        by = {}
        for (b, _), (values, places) in lines.items():
            if all(len(v) == 1 for v in values.values()):
                by.setdefault(b, set()).update(places)
        found[d] = {b: len(p) / total[b] for b, p in by.items() if 2 * len(p) >= total[b] or len(p) >= dc.ENOUGH_WINDOWS}
    return found


ITEMS = [
    (1, "A train leaves Boston at 9 and travels 120 km in 3 hours. How far does the train from Boston get in 6 hours?"),
    (2, "short item only five words"),
    (3, "The quick brown fox jumps over the lazy dog near the river bank while seven geese look on in silence."),
    (4, "12 34 56 78 90 11 22 33"), (5, ""), (6, None),
    (7, "The quick brown fox jumps over the lazy dog near the river bank while seven geese look on in silence."),
]
DOCS = [
    (1, "Filler text. A train leaves Denver at 7 and travels 300 km in 5 hours. How far does the train from Denver get in 8 hours? More."),
    (2, "Filler text. A train leaves Denver at 7 and travels 300 km in 5 hours. How far does the train from Austin get in 8 hours? More."),
    (3, "we said: short item only five words, yes"), (4, "a quick brown cat"), (5, ""), (6, None),
    (7, "intro THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG near the river bank outro"),
    (8, "99 98 97 96 95 94 93 92"), (9, "x " * 20_000 + ITEMS[2][1]), (10, "the quick brown fox jumps over the lazy dog"),
]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_findings_equal_plain_python(spark, limit):
    rnd = random.Random(2)
    pool = " ".join(t for _, t in ITEMS if t).split()
    docs = DOCS + [(100 + i, " ".join(rnd.choice(pool) for _ in range(30)) + " " + " ".join(
        ITEMS[rnd.choice([0, 2])][1].split()[rnd.randint(0, 6):rnd.randint(9, 22)])) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit("x")).withColumn("pos", F.lit(1))
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in dc.contamination(d, b, literal_limit=limit).collect()}
    want = brute(docs, ITEMS)
    assert set(got) == set(want)
    for i, items in want.items():
        assert (got[i].contaminated, list(got[i].item_ids)) == (bool(items), sorted(items)), i
        assert got[i].coverage == pytest.approx(max(items.values(), default=0.0))
    assert got[1].contaminated and not got[2].contaminated and got[3].item_ids == [2] and got[7].item_ids == [3, 7]


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    table = lambda n: [tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select("doc_id" if n == "documents" else "item_id", "text").collect()]
    want = brute(table("documents"), table("benchmark"))
    got = {r.doc_id: list(r.item_ids) for r in LLM_QUERIES["op6_decontamination"](spark, sf).collect()}
    assert got == {i: sorted(x) for i, x in want.items()} and any(got.values())


def test_filter_keeps_columns_nulls_and_empty_tables(spark):
    d = spark.createDataFrame([(None, ITEMS[2][1], "a"), (1, ITEMS[2][1], "b"), (2, "clean", "c"), (2, "clean", "c")],
                              "doc_id long, text string, item_id string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = dc.clean_documents(d, b)
    assert out.columns == d.columns and sorted(str(r.doc_id) for r in out.collect()) == ["2", "2", "None"]
    assert dc.contamination(d.limit(0), b).count() == 0
    assert not any(r.contaminated for r in dc.contamination(d, b.limit(0)).collect())
