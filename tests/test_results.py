"""Result tables with a manifest: a run counts once, unfinished jobs never."""

import pytest

from tessera.sources import results as rs

SCHEMA = "name string, f1 double"


def _rows(spark, path, fmt):
    return sorted(((r.run, r.name, r.f1) for r in rs.read_rows(spark, path, SCHEMA, fmt).collect()), key=str)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_runs_append_and_repeats_do_not_count(spark, tmp_path, fmt):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", 0.5), ('b, "q"\\', None), ("", 0.25), (None, 1.0)], SCHEMA)
    assert rs.committed(spark, path).count() == 0
    assert rs.append_rows(one, path, "x/1", fmt) and rs.append_rows(one.limit(0), path, "none", fmt)
    assert not rs.append_rows(one, path, "x/1", fmt)
    assert rs.append_rows(spark.createDataFrame([("c", 0.75)], SCHEMA), path, "2", fmt)
    want = [("x/1", "a", 0.5), ("x/1", 'b, "q"\\', None), ("x/1", "", 0.25), ("x/1", None, 1.0), ("2", "c", 0.75)]
    assert _rows(spark, path, fmt) == sorted(want, key=str)
    assert {r.run for r in rs.committed(spark, path).collect()} == {"x/1", "2", "none"}
    with pytest.raises(ValueError):
        rs.append_rows(one, path, None, fmt)


def test_rows_of_a_dead_job_and_of_a_second_attempt_do_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", 0.5)], SCHEMA)
    rs.append_rows(one, path, "r")
    first = rs.committed(spark, path).first().part
    one.write.parquet(f"{path}/rows/part=00000000000000000001-dead")          # no line in the manifest
    late = "99999999999999999999-late"                                        # an attempt that ran at the same time
    one.write.parquet(f"{path}/rows/part={late}")
    spark.createDataFrame([("r", late)], "run string, part string").write.mode("append").json(f"{path}/manifest")
    assert _rows(spark, path, "parquet") == [("r", "a", 0.5)]
    assert rs.committed(spark, path).first().part == first
