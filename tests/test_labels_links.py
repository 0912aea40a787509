from pyspark.sql import functions as F

from tessera.operators import labels as lb
from tessera.operators import links as lk
from tessera.operators import stats as st
from tessera.operators import vectors as vx


def test_multihot_and_rename(spark):
    df = spark.createDataFrame([(["A", "X"], ["Culture.People", "STEM.Space"])], "c array<string>, r array<string>")
    cl = lb.ClassList(["B", "A"])
    r = df.select(cl.multihot("c").alias("m"),
                  lb.rename_classes("r", {"Culture.People": "Culture.Language and literature"}).alias("n")).first()
    assert r.m == [0, 1]
    assert r.n == ["Culture.Language and literature", "STEM.Space"]


def test_link_clean_and_map(spark):
    df = spark.createDataFrame([(1, ["[[New York|NY]]", "[[File:a.png]]", "[[Paris]]"])], "id long, raw array<string>")
    assert df.select(lk.clean_links("raw")).first()[0] == ["new_York", "paris"]
    titles = spark.createDataFrame([(1, ["paris", "nowhere"])], "id long, t array<string>")
    m = spark.createDataFrame([("paris", "7")], "title string, page_id string")
    assert lk.map_titles(titles, "id", "t", m, "out").first()["out"] == ["7", ""]


def test_title_map_last_wins(spark, tmp_path):
    p = tmp_path / "tm.txt"
    p.write_text("Paris\t7\nparis\t8\nbad line\n")
    from tessera.sources.readers import read_title_map
    assert [(r.title, r.page_id) for r in read_title_map(spark, str(p)).collect()] == [("paris", "8")]


def test_namespaces(spark):
    inl = spark.createDataFrame([(1, 0, 5, 0), (1, 1, 6, 1), (1, 2, 7, 0), (1, 3, 8, 446)],
                                "qid long, pos int, pid long, ns int")
    got = {r.column: r.pids for r in lk.links_by_namespace(inl).collect()}
    assert got == {"subject_article": [5, 7], "talk_article": [6]}
    assert lk.first_seen_namespaces(inl).first()["namespaces"] == [0, 1]


def test_mean_vector_counts_oov(spark):
    df = spark.createDataFrame([(1, ["a", "a", "oov"])], "id long, toks array<string>")
    vec = spark.createDataFrame([("a", [3.0, 0.0])], "word string, vec array<float>")
    assert vx.weighted_doc_vectors(df, "id", "toks", vec, 2).first()["vec"] == [2.0, 0.0]


def test_idf_values(spark):
    d = spark.createDataFrame([("x", "w", 1)] + [("x", f"v{i}", 9) for i in range(7)], "lang string, word string, df long")
    r = st.idf(d, ["lang"]).filter("word = 'w'").first()
    assert round(r.idf, 6) == 1.386294 and r.idf_trunc == 1
    d2 = spark.createDataFrame([("x", "w", 3), ("x", "v", 3)], "lang string, word string, df long")
    r2 = st.idf(d2, ["lang"]).filter("word = 'w'").first()
    assert round(r2.idf, 6) == -0.693147 and r2.idf_trunc == 0


def test_article_coverage(spark):
    df = spark.createDataFrame([(1, ["a", "a", "x"]), (2, [])], "id long, toks array<string>")
    vec = spark.createDataFrame([("a", [1.0])], "word string, vec array<float>")
    got = {r.id: r for r in st.article_coverage(df, vec).collect()}
    assert round(got[1].coverage, 6) == 66.666667 and got[1].missing == ["x"] and got[1].total == 3
    assert got[2].coverage == 100.0
