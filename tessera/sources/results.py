"""Result tables that grow by runs (S12, U8): metric rows, per-class tables,
coverage reports.

A run's rows are written as a part of their own; a line in the manifest,
written after the part is complete, makes it count.  A run counts once
however often its job runs: a committed run is not written again, rows of a
job that died have no line, and of attempts at the same time the one started
first counts.  Runs only add files, so readers and other runs are not
disturbed.

Layout: ``rows/part=<start>-<id>/`` and ``manifest/`` (JSON lines of run and
part).  An empty run counts as a run without rows; run names may hold any
characters, null is refused.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV = {"header": "true", "nullValue": "\\N", "escape": "\""}      # a text that is just \N is read as null


def _options(fmt: str) -> dict:
    return CSV if fmt == "csv" else {}


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(run, part) of the runs that count; no rows for a table not begun."""
    schema = "run string, part string"
    try:
        lines = spark.read.schema(schema).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return lines.groupBy("run").agg(F.min("part").alias("part"))


def append_rows(df: DataFrame, path: str, run: str, fmt: str = "parquet") -> bool:
    """Append the rows of a run; False, and nothing written, when the run is
    in the table already."""
    if run is None:
        raise ValueError("a run needs a name")
    spark = df.sparkSession
    if not committed(spark, path).filter(F.col("run") == run).isEmpty():
        return False
    part = f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
    df.write.format(fmt).options(**_options(fmt)).save(f"{path}/rows/part={part}")
    spark.createDataFrame([(run, part)], "run string, part string").write.mode("append").json(f"{path}/manifest")
    return True


def read_rows(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """The rows of all committed runs, with the column ``run``; ``schema``
    names the columns in the order written."""
    rows = spark.read.schema(f"{schema}, part string").format(fmt).options(**_options(fmt)).load(f"{path}/rows")
    return rows.join(committed(spark, path), "part").drop("part")
