"""The string kernel against its definition, and held-out accuracy."""

import zlib
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import toxicity as tx
from tessera.llm.queries import LLM_QUERIES


def plain_kernel(s, t):
    def features(x):
        out = {}
        for at in combinations(range(len(x)), tx.SUBSEQUENCE):
            k = "".join(x[i] for i in at)
            out[k] = out.get(k, 0) + tx.DECAY ** (at[-1] - at[0] + 1)
        return out
    a, b = features(s), features(t)
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_kernel_equals_its_definition():
    marks = ["idiot", "clown", "thing", "éeau"]
    units = ["idiot", "id-iot", "xidiotx", "clowning", "thing", "nothing", "abc", "éeauté", "zzz", "ab", "中文字", "a" * 24]
    got = tx.Marks(marks).similarity(units)
    for i, u in enumerate(units):
        for j, m in enumerate(marks):
            own = plain_kernel(u, u) * plain_kernel(m, m)
            want = (plain_kernel(u, m) / own ** 0.5) ** tx.SHARPEN if own else 0
            assert got[i, j] == pytest.approx(want, abs=1e-4), (u, m)


def test_units_join_spaced_letters_and_drop_signs():
    units = [w for u in tx.units_of("You I D I O T, a b id-iot!") for w in tx.windows(u)]
    assert "idiot" in units and units.count("idiot") == 2
    long = "x" * 100 + "idiot" + "y" * 100
    assert "".join(dict.fromkeys("".join(tx.windows(long)))) == "xidoty" and any("idiot" in w for w in tx.windows(long))


def test_held_out_accuracy_and_no_leak(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in LLM_QUERIES["op3_toxicity"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(rows) == docs and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert np.mean([p == t for p, t in held]) >= 0.95


def train_rows():
    rnd = np.random.default_rng(8)
    words = ["".join(rnd.choice(list("aeglnrstwh"), rnd.integers(3, 8))) for _ in range(300)]
    prose = lambda: " ".join(rnd.choice(words, 25)) + ". " + " ".join(rnd.choice(words, 25)) + "."
    return [prose() for _ in range(80)] + [prose() + " you are an idiot " + prose() for _ in range(40)], [0] * 80 + [1] * 40


def test_gapped_insults_score_above_clean_texts():
    scorer = tx.Scorer(tx.train(*train_rows()))
    clean, plain, signs, spaced, inserted = scorer.documents(
        ["where the green garden was", "gentle idiot", "gentle i.d-i*ot", "gentle i d i o t", "gentle idioxt"])
    assert plain >= 0.5 and signs >= 0.5 and spaced >= 0.5 and clean < 0.5 and inserted > 3 * clean


def test_nulls_empty_texts_and_one_sided_labels(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (None, "x", 0.0), (2, "", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    out = tx.score(docs, tx.fit(docs, labels)).collect()
    assert len(out) == 4 and all(0 <= r.score < 0.5 for r in out)
    assert tx.score(docs.limit(0), tx.fit(docs, labels)).count() == 0
    none = tx.score(docs, tx.fit(docs, labels.limit(0))).collect()
    assert len({r.score for r in none}) == 1


def test_more_insults_never_lower_a_score():
    model = tx.train(*train_rows())
    assert min(model.curve[:2]) >= 0
    scorer, text, last = tx.Scorer(model), "gentle green words", 0.0
    for more in ["", " idiot", " id-iot", " idixot", " green", " idiot and idiots"]:
        text += more
        now = scorer.documents([text])[0]
        assert now >= last
        last = now
    long = "gentle words " * 100_000
    assert scorer.documents([long + "idiot"])[0] >= 0.5 > scorer.documents([long])[0]


def test_held_out_fold_by_language(spark):
    """English recall and precision, overall accuracy and ranking at sf0.1."""
    sf = "/root/testdata/sf0.1"
    rows = LLM_QUERIES["op3_toxicity"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id") \
        .join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("toxic in (0, 1)").collect()
    hit = np.array([r.predicted for r in rows])
    y = np.array([r.toxic for r in rows])
    english = np.array([r.lang == "en" for r in rows])
    assert (hit == y).mean() >= 0.95
    assert hit[english & (y == 1)].mean() >= 0.88 and y[english & (hit == 1)].mean() >= 0.95
    score = np.array([r.score for r in rows])
    above = (score[y == 1][:, None] > score[y == 0][None, :]).mean() + 0.5 * (score[y == 1][:, None] == score[y == 0][None, :]).mean()
    assert above >= 0.92


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", True, 7, 0.5)], "doc_id long, text string, held_out boolean, predicted int, score double")
    out = tx.score(docs, tx.train(*train_rows())).first()
    assert out.predicted == 0 and 0 <= out.score < 0.5
