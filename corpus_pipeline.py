"""The corpus pipeline: documents to token ids.

Stages: quality filter, near-duplicate removal, benchmark decontamination,
surrogates for personal data, BPE encoding and decoding.  Each stage takes
all that the one before kept, written as Parquet in the shared checkpoint
folder and read again; all but the last return the columns of documents.

A row with a null id goes through every stage like any other; of rows that
repeat an id and a text one stays, and documents that share an id but not a
text stay apart: where ids do not tell rows apart, near duplicates and
decontamination decide by a key of id and text.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, minhash, pii, quality
from tessera.llm.common import materialize, read_table
from tessera.llm.queries import SURROGATE_KEY, digests, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).filter("good").select(*docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` plus __row, a number for each id and text, in the order of the
    ids and null ids last: the id itself where it tells all rows apart, else
    numbers written once.  Rows that repeat an id and a text share theirs."""
    repeated = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if repeated.isEmpty():
        return docs.withColumn("__row", F.col("doc_id").cast("long"))
    digest = F.sha2(F.col("text").cast("string"), 256)
    rows = docs.select("doc_id", digest.alias("__d")).distinct().orderBy(F.col("doc_id").asc_nulls_last(), F.col("__d").asc_nulls_last())
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "row-keys").withColumnRenamed("doc_id", "__id")
    own = docs.withColumn("__d", digest)
    same = own["doc_id"].eqNullSafe(rows["__id"]) & own["__d"].eqNullSafe(rows["__d"])
    return materialize(own.join(rows, same).select(*[own[c] for c in docs.columns], "__row"), "keyed")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    rows = keyed(docs)
    classes = materialize(minhash.near_duplicates(rows, "__row"), "classes")
    gone = materialize(classes.filter("not kept").select(F.col("doc_id").alias("__row")).distinct(), "gone")
    kept = rows.join(gone, "__row", "left_anti")
    twice = materialize(classes.filter("kept").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__row")), "twice")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    alike = kept.join(twice, "__row", "left_semi").dropDuplicates(["__row"])
    return kept.join(twice, "__row", "left_anti").unionByName(alike).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    clean = decontam.clean_documents(keyed(docs), read_table(spark, sf_dir, "benchmark"), id_col="__row", both=True)
    return clean.select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, n_chars kept true."""
    out = pii.pseudonymise(docs, SURROGATE_KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to."""
    path = tokenizer_path("word_bpe_49k.json")
    coded = bpe.encode_and_decode(docs.select("doc_id", "text"), path)
    return coded.select("doc_id", "ids", *digests())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: Trained scores, similarity classes and keyed surrogates are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES: dict[str, str] = {}
