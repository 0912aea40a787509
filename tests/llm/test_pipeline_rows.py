"""Rows that their id does not tell apart go through the pipeline's stages like others."""

import random

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_null_and_repeated_ids_are_decided_by_row(spark):
    rnd = random.Random(5)
    prose = lambda n: " ".join(f"w{rnd.randrange(10_000)}" for _ in range(n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("item_id = 0").first().text
    a, b, c, d = (prose(80) for _ in range(4))
    rows = [(3, a), (None, a + " tail"), (None, a), (None, b), (None, b + " end"), (5, c), (5, a + " more"), (7, d),
            (None, prose(10) + " " + item), (8, prose(10)), (8, prose(12) + " " + item)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = cp.near_duplicate_stage(spark, df, SF)
    assert kept.columns == ["doc_id", "text"]
    got = {(r.doc_id, r.text) for r in kept.collect()}
    assert (got & {(3, a), (5, c), (7, d)}) == {(3, a), (5, c), (7, d)} and kept.count() == 7
    assert not got & {(None, a), (None, a + " tail"), (5, a + " more")} and len(got & {(None, b), (None, b + " end")}) == 1
    clean = {(r.doc_id, r.text) for r in cp.decontamination_stage(spark, df, SF).collect()}
    assert clean == {r for r in rows if item not in r[1]}
