"""The pipeline's stages against plain Python, each on its own input."""

import hashlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tessera.llm import pii, quality
from tessera.llm.queries import SURROGATE_KEY, tokenizer_path
from test_decontam import brute as leaks
from test_minhash import brute as classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """The input of every stage, and the last stage's output."""
    docs = cp.read_table(spark, SF, "documents")
    out = [docs]
    for name, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_names_and_columns(tables):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "bpe"] and cp.ORACLE_SQL is None
    assert all(t.columns == tables[0].columns for t in tables[:-1])


def test_quality_stage_keeps_what_the_classifier_takes_for_good(spark, tables):
    model = quality.fit(tables[0], cp.read_table(spark, SF, "labels"))
    good = {r.doc_id for r in quality.classify(tables[0], model).filter("good").collect()}
    assert set(texts(tables[1])) == good and texts(tables[1]).items() <= texts(tables[0]).items()
    bad = {r.doc_id for r in cp.read_table(spark, SF, "labels").filter("quality = 0").collect()}
    assert len(bad & good) <= 0.1 * len(bad)


def test_one_document_of_each_class_stays(tables):
    before = texts(tables[1])
    _, comp = classes(sorted(before.items()))
    assert set(texts(tables[2])) == {i for i, c in comp.items() if i == c}


def test_contaminated_documents_go(spark, tables):
    items = [(r.item_id, r.text) for r in cp.read_table(spark, SF, "benchmark").collect()]
    before = texts(tables[2])
    found = leaks(sorted(before.items()), items)
    assert set(texts(tables[3])) == {i for i in before if not found[i]}


def test_surrogates_and_token_ids(tables):
    want = {r.doc_id: r.text for r in pii.pseudonymise(tables[3], SURROGATE_KEY).collect()}
    assert texts(tables[4]) == want
    assert all(r.n_chars == len(r.text) for r in tables[4].collect())
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in tables[5].collect()}
    assert set(rows) == set(want)
    for i, t in want.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert list(rows[i].ids) == ids and rows[i].n_tokens == len(ids)
        assert rows[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_the_last_stage(spark, tables):
    assert sorted(r.doc_id for r in cp.run(spark, SF).select("doc_id").collect()) == sorted(r.doc_id for r in tables[5].collect())


def test_null_ids_repeats_and_empty_tables(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(None, text, None, None, None), (3, text, "en", "s", 5), (3, text, "en", "s", 5), (None, "alone here", "en", "s", 1),
                                (None, "alone here", "en", "s", 1), (9, None, "en", "s", 1)],
                               "doc_id long, text string, lang string, source string, n_chars long").withColumn("ids", F.lit("x"))
    out = cp.near_duplicate_stage(spark, df, SF)
    assert sorted((r.doc_id or 0, r.text) for r in out.collect() if r.text) == [(0, "alone here"), (3, text)]
    for _, stage in cp.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0
        stage(spark, df, SF).collect()
