"""Plan checks: filters and column pruning reach the Parquet scan, and the
text normaliser stays a shuffle-free projection."""

import contextlib
import io

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_point_lookup_pushes_filter(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["src_point_lookup"](spark, SF))
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan


def test_language_filter_reaches_token_scan(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["sink_split_parquet"](spark, SF).filter("size(toks) > 0"))
    assert "PartitionFilters" in plan and "lang" in plan
    assert "ReadSchema: struct<id:bigint,toks:array<string>>" in plan


def test_normalise_has_no_exchange(spark):
    from pyspark.sql import functions as F
    from tessera.functions.text import normalise
    from tessera.session import read_table
    d = read_table(spark, SF, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    plan = _plan(normalise(d, "text", "lang", "toks", keep_cols=["id"]))
    assert "Exchange" not in plan and "PythonUDF" not in plan and "BatchEvalPython" not in plan
