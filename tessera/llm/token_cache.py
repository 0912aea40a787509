"""Token counts behind a digest cache.

A text is known by the SHA-256 of its normalised content and the digest of
the tokenizer file that counted it.  Texts whose digests are stored take the
stored count; of the others each distinct text is encoded once and its count
appended to the cache, so a corpus that is counted again, or grows, costs
only what is new.  Normalising is the part of the tokenizer's own that keeps
counts: nulls become the empty text, and everything else stays byte for byte.

The cache is a Parquet folder with a sub-folder for each tokenizer version
and fits any storage Spark writes to.  Texts move once, to meet their copies;
copies inside a task are folded before the shuffle, so a text that a third
of the rows hold arrives once from each task.  Everything after that carries
32-byte digests; the final join on them is left to adaptive skew splitting.

Null texts count like empty ones (no tokens); null or repeated ids keep their
rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import tokenizer
from tessera.llm.common import slices, text_or_empty
from tessera.session import scratch_path

CACHE_SCHEMA = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def cached_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Stored (digest, n_tokens) of one version; empty before the first use."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))   # two writers may add the same text


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(digest, text) -> (digest, n_tokens), one encoding for each row."""
    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for part in slices(batch):
                counts = [bpe.count(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(counts, pa.int64())],
                                                 ["digest", "n_tokens"])
    return texts.select("digest", "text").mapInArrow(run, CACHE_SCHEMA)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 cache_dir: str | None = None, limit: int = 1024) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit.

    ``cache_dir`` is the cache to read and append to; without one a fresh
    cache is made below the shared checkpoint folder."""
    spark = df.sparkSession
    folder = f"{(cache_dir or scratch_path(spark, 'token-cache')).rstrip('/')}/{tokenizer_version(path)}"
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    digest = F.unhex(F.sha2(F.col("text"), 256))
    known = cached_counts(spark, folder)
    misses = rows.select(digest.alias("digest"), "text").join(known, "digest", "left_anti").dropDuplicates(["digest"])
    encode_counts(misses, path).write.mode("append").parquet(folder)
    counts = cached_counts(spark, folder)
    narrow = rows.select("doc_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    return (narrow.join(counts, "digest", "left")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
