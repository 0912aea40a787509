"""Incremental normalisation with Structured Streaming.

The reference has no streaming; its text, label and link-cleaning steps
are stateless column transforms, so the same ``DataFrame -> DataFrame``
operators run unchanged on a streaming frame.  ``normalise_stream`` is the
file-source form: new JSON-lines files are normalised once each
(``availableNow``) into Parquet, with progress kept in a checkpoint folder
so a restarted job resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.text import normalise


def normalise_stream(spark: SparkSession, src: str, schema: str, out: str, checkpoint: str,
                     text_col: str = "text", lang_col: str = "lang", id_col: str = "id",
                     stop_lists: dict | None = None) -> DataFrame:
    stream = spark.readStream.schema(schema).json(src)
    toks = normalise(stream, text_col, lang_col, "toks", keep_cols=[id_col, lang_col], stop_lists=stop_lists)
    q = (toks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)
