"""Readers and languages with default arguments: nothing falls back to English."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import links, stats, vocab
from tessera.operators.text_ops import section_text
from tessera.plans import views
from tessera.sources import readers as rd
from tessera.streaming.stream import normalise_stream


def articles(tmp_path, *texts):
    p = tmp_path / "a.json"
    p.write_text("\n".join(json.dumps({"qid": str(i), "entitle": "t", "wikitext": t, "mid_level_categories": []}) for i, t in enumerate(texts)))
    return str(p)


def test_russian_and_hindi_articles(spark, tmp_path):
    path = articles(tmp_path, "Привет мир 2 кошки")
    assert rd.read_articles(spark, path, lang="ru", stop_lists={"ru": []}).first().tokens == ["привет", "мир", "два", "кошки"]
    assert rd.read_articles(spark, path, lang="ru").first().tokens == [w for w in ("привет", "мир", "два", "кошки") if w not in tx.stopwords_for("ru")]
    path = articles(tmp_path, "नदी और पहाड़ २ abc")
    assert rd.read_articles(spark, path, lang="hi").first().tokens == ["नदी", "और", "पहाड़", "दो"]
    assert rd.read_articles(spark, path, lang="hi", stop_lists={"hi": ["और"]}).first().tokens == ["नदी", "पहाड़", "दो"]
    with pytest.raises(ValueError, match="xx"):
        rd.read_articles(spark, path, lang="xx")


def test_unknown_languages_fail_the_job(spark):
    df = spark.createDataFrame([("hola", "pt"), ("x", None)], "text string, lang string")
    for row in ("pt", None):
        with pytest.raises(PySparkException, match="no profile for language"):
            tx.normalise(df.filter(F.col("lang").eqNullSafe(F.lit(row))), "text", "lang", "toks").collect()


def test_stream_in_several_languages(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"id": 1, "lang": "ru", "text": "Два кота"}\n{"id": 2, "lang": "hi", "text": "नदी और"}\n')
    out = normalise_stream(spark, str(src), "id long, lang string, text string", str(tmp_path / "out"), str(tmp_path / "ck"),
                           stop_lists={"hi": ["और"]})
    assert {r.id: r.toks for r in out.collect()} == {1: ["кота"], 2: ["नदी"]} or {r.id: r.toks for r in out.collect()} == {
        1: ["два", "кота"], 2: ["नदी"]}


def test_digits_strip_all_white_space(spark):
    df = spark.createDataFrame([(" \n 23 boys\t　", "en")], "t string, lang string")
    assert df.select(tx.digits_to_words("t", "lang").alias("d")).first().d == " two three boys"


def test_word_vectors_round_trip_in_one_file(spark, tmp_path):
    df = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [3.0, -4.5])], "word string, vec array<float>")
    path = str(tmp_path / "v")
    rd.write_word_vectors(df, path)
    files = list((tmp_path / "v").glob("part-*"))
    assert len(files) == 1 and files[0].read_text().splitlines() == ["2 2", "a 3.0 -4.5", "b 1.0 2.0"]
    for header in (True, False):
        assert {r.word: r.vec for r in rd.read_word_vectors(spark, path, header).collect()} == {"a": [3.0, -4.5], "b": [1.0, 2.0]}


def test_vectors_without_header_survive_broken_lines(spark, tmp_path):
    p = tmp_path / "v.txt"
    p.write_text("4 2\na 1 2\nbroken word here 1 2\nb 3 x\nc 5 6\n")
    assert {r.word: r.vec for r in rd.read_word_vectors(spark, str(p), has_header=False).collect()} == {"a": [1.0, 2.0], "c": [5.0, 6.0]}


def test_title_map_strips_lines_and_takes_the_last(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("Paris\t7  \n  paris\t8 \nbad line\n\nRome\t1\t2\n")
    assert {r.title: r.page_id for r in rd.read_title_map(spark, str(p)).collect()} == {"paris": "8"}


def test_nested_links_and_headings(spark):
    text = "x [[File:a.png|see [[Paris]] and [[Rome|R]]]] y [[Oslo]]\n== A = B ==\n=== Deep === <!-- note -->\nno == heading"
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(links.extract_links("t").alias("l"), section_text(F.col("t"), html=False).alias("h")).first()
    assert row.l == ["[[File:a.png|see [[Paris]] and [[Rome|R]]]]", "[[Paris]]", "[[Rome|R]]", "[[Oslo]]"]
    assert row.h.split() == ["A", "=", "B", "Deep"]


def test_lookups_use_two_exchanges_of_the_corpus(spark):
    df = spark.createDataFrame([(1, "en", ["a", "b", "a"]), (2, "fr", []), (3, "fr", None)], "id long, lang string, toks array<string>")
    voc = spark.createDataFrame([("en", "a", 5), ("en", "b", 6), ("fr", "a", 7)], "lang string, word string, idx long")
    few = spark.createDataFrame([("en", "a")], "lang string, word string")
    encode = lambda: vocab.encode_ids(df, voc, "id", "toks", by=["lang"], unique_words=True, frequent=few)
    assert {r.id: r.ids for r in encode().collect()} == {1: [5, 6, 5], 2: [], 3: []}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = encode()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # rare occurrences, vocabulary, articles; the frequent words and the vocabulary for their broadcast table
    assert plan.count("Exchange hashpartitioning") == 5
    cov = {r.id: (r.coverage, r.missing, r.total) for r in stats.article_coverage(df, voc.filter("word = 'a'"), by=["lang"]).collect()}
    assert cov[1][1:] == (["b"], 3) and round(cov[1][0], 4) == 66.6667 and cov[2] == (100.0, [], 0)


def test_multilingual_order_must_name_every_language(spark):
    df = spark.createDataFrame([("en", ["a"]), ("fr", ["b"])], "lang string, toks array<string>")
    got = {(r.lang, r.word): r.idx for r in vocab.multilingual_vocab(df, "lang", ["fr", "en"]).collect()}
    assert got[("fr", "b")] == 2 and got[("en", "a")] == 3
    assert {r.word: r.idx for r in vocab.multilingual_vocab(df, "lang").collect()}["a"] == 2
    with pytest.raises(PySparkException, match="without a place"):
        vocab.multilingual_vocab(df, "lang", ["en"]).collect()


def test_shared_tables_follow_their_files(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    for text in ("first words", "second words"):
        spark.createDataFrame([(1, text, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long") \
            .write.mode("overwrite").parquet(path)
        assert views.tokens(spark, str(tmp_path)).first().toks == text.split()
