"""Vocabularies, dense ids, token-id encoding, padding (A1, A1', W1, W2, J3,
T13, T17, W7).

Dense ids never go through a single-partition window: rows are range
partitioned and sorted, per-partition counts (one row per partition, a
proven bound) give running offsets, and each row adds its position inside
its partition.  The ranged table is checkpointed to the shared checkpoint
folder (as Parquet) so the counts and the rows come from one
materialisation.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lookup import lookup_tokens
from tessera.session import ensure_checkpoint_dir, materialize

PAD, UNK = "<pad>", "<unk>"
ROWS_PER_TASK = 250_000


def dense_index(df: DataFrame, order_cols, idx_col: str = "idx", offset=0,
                num_partitions: int | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``idx_col`` = offset + 0-based rank of each row in ``order_cols``
    order (rows must be distinct in that order for a deterministic result).
    ``offset`` may be an int or a column (e.g. a per-language block offset
    carried in the rows).

    The rows are written once, so their number is known before they are dealt
    out (a count of Parquet footers) and the sample for the split points does
    not compute them again; the number of ranges follows from the rows, not
    from a session setting.  Ids are the same for any number of ranges."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    cols = [F.col(c) for c in order_cols]
    if num_partitions is None:
        df = materialize(df, "dense-in")
        num_partitions = max(1, math.ceil(df.count() / rows_per_task))
    ranged = (df.repartitionByRange(num_partitions, *cols).sortWithinPartitions(*cols)
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__mid", F.monotonically_increasing_id()))
    ranged = materialize(ranged, "dense")
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    off = offset if not isinstance(offset, (int,)) else F.lit(offset)
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return (ranged.join(F.broadcast(offs), "__pid")
            .withColumn(idx_col, (off + F.col("__off") + local).cast("long"))
            .drop("__pid", "__mid", "__off"))


def distinct_words(df: DataFrame, toks_col: str = "toks", word_col: str = "word") -> DataFrame:
    """A1 core: distinct tokens (map-side partial distinct absorbs hot words)."""
    return df.select(F.explode(toks_col).alias(word_col)).distinct()


def build_vocab(df: DataFrame, toks_col: str = "toks", prefix=(), word_col: str = "word",
                idx_col: str = "idx") -> DataFrame:
    """A1 + W1: sorted distinct vocabulary with dense ids; ``prefix`` tokens
    (e.g. ``<pad>``, ``<unk>``) take ids 0..len(prefix)-1."""
    words = distinct_words(df, toks_col, word_col)
    indexed = dense_index(words, [word_col], idx_col, offset=len(prefix))
    if prefix:
        spark = df.sparkSession
        pre = spark.createDataFrame([(w, i) for i, w in enumerate(prefix)],
                                    f"{word_col} string, {idx_col} long")
        indexed = pre.unionByName(indexed)
    return indexed


def word_lookup(vocab: DataFrame, word_col: str = "word", idx_col: str = "idx") -> DataFrame:
    """word -> id with the last index winning on duplicate words (Q10)."""
    return vocab.groupBy(word_col).agg(F.max(idx_col).alias(idx_col))


def encode_ids(df: DataFrame, vocab: DataFrame, id_col: str, toks_col: str, out_col: str = "ids",
               unk_id: int | None = 1, max_tokens: int | None = None,
               word_col: str = "word", idx_col: str = "idx", unique_words: bool = False, by=(),
               frequent: DataFrame | None = None) -> DataFrame:
    """J3 (+T13): replace every token by its id; unknown tokens get
    ``unk_id`` (``None``: an unknown token raises, as a plain dict lookup
    does).  ``by`` names the columns (e.g. the language) that choose among
    several vocabularies and are kept.  ``unique_words`` skips the
    last-index-wins aggregate when each vocabulary holds a word once;
    ``frequent`` as in ``lookup_tokens``."""
    by = list(by)
    src = df if max_tokens is None else df.withColumn(toks_col, F.slice(toks_col, 1, max_tokens))
    look = vocab if unique_words else vocab.groupBy(*by, word_col).agg(F.max(idx_col).alias(idx_col))
    found = lookup_tokens(src, id_col, toks_col, look, F.col(idx_col).cast("long"), by, word_col, by, frequent, unk_id is None)

    def one(s):
        missing = (F.raise_error(F.concat(F.lit("token not in vocabulary: "), s["word"])).cast("long") if unk_id is None
                   else F.lit(unk_id).cast("long"))
        return F.coalesce(s["value"], missing)
    return found.select(id_col, *by, F.transform("__s", one).alias(out_col))


def decode_ids(df: DataFrame, vocab: DataFrame, id_col: str, ids_col: str, out_col: str = "text",
               pad_id: int = 0, word_col: str = "word", idx_col: str = "idx", by=()) -> DataFrame:
    """Ids -> space-joined words, pad ids skipped; ``by`` as in
    ``encode_ids`` (the vocabulary then has every reserved id in each group)."""
    by = list(by)
    src = df.select(id_col, *by, F.filter(ids_col, lambda i: i != pad_id).alias("__k"))
    names = vocab.select(*by, F.col(idx_col).alias("__i"), F.col(word_col).alias("__name"))
    found = lookup_tokens(src, id_col, "__k", names, F.col("__name"), by, "__i", by, words=False)
    return found.select(id_col, *by, F.array_join(F.transform("__s", lambda s: s["value"]), " ").alias(out_col))


def pad_batches(df: DataFrame, order_col: str, ids_cols, batch_size: int, pad_id: int = 0) -> DataFrame:
    """batch = position // batch_size in ``order_col`` order; each list
    column is padded independently to the longest list of its batch.  The
    batch maximum is a grouped aggregate joined back on the batch number
    (no window over one partition).  Only order and lengths are sorted; the
    lists are written once and meet their batch in one exchange."""
    ids_cols = [ids_cols] if isinstance(ids_cols, str) else list(ids_cols)
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "pad-in")
    sizes = [F.coalesce(F.size(c), F.lit(0)).alias(f"__max_{c}") for c in ids_cols]
    pos = dense_index(rows.select(order_col, "__row", *sizes), [order_col], "__pos")
    b = pos.withColumn("batch", F.floor(F.col("__pos") / batch_size).cast("long"))
    maxes = b.groupBy("batch").agg(*[F.max(f"__max_{c}").alias(f"__max_{c}") for c in ids_cols])
    out = rows.join(b.select("__row", "__pos", "batch").join(maxes, "batch"), "__row").drop("__row")
    for c in ids_cols:
        fill = F.array_repeat(F.lit(pad_id).cast("long"), (F.col(f"__max_{c}") - F.size(c)).cast("int"))
        out = out.withColumn(c, F.concat(F.col(c).cast("array<bigint>"), fill))
    return out.drop(*[f"__max_{c}" for c in ids_cols]).withColumnRenamed("__pos", "position")


def rank_within(df: DataFrame, group_cols, order_cols, idx_col: str = "idx") -> DataFrame:
    """0-based rank inside each group without a per-group window: one global
    dense index over (group, order), minus the first index of the group (a
    grouped minimum joined back; one row per group)."""
    group_cols = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    g = dense_index(df, group_cols + order_cols, "__g")
    first = g.groupBy(*group_cols).agg(F.min("__g").alias("__first"))
    return g.join(first, group_cols).withColumn(idx_col, F.col("__g") - F.col("__first")).drop("__g", "__first")


def vocab_per_group(df: DataFrame, group_col: str, toks_col: str = "toks", prefix=(PAD, UNK)) -> DataFrame:
    """W1 per language: each language's sorted vocabulary gets its own ids
    starting after the reserved prefix."""
    words = df.select(group_col, F.explode(toks_col).alias("word")).distinct()
    ranked = rank_within(words, [group_col], ["word"], "idx").withColumn("idx", F.col("idx") + len(prefix))
    if not prefix:
        return ranked
    groups = words.select(group_col).distinct()
    pre = groups.select(group_col, F.posexplode(F.array(*[F.lit(p) for p in prefix])).alias("idx", "word"))
    return pre.select(group_col, "word", F.col("idx").cast("long").alias("idx")).unionByName(ranked)


def multilingual_vocab(df: DataFrame, group_col: str, order: list | None = None, toks_col: str = "toks",
                       prefix=(PAD, UNK)) -> DataFrame:
    """Combined vocabulary -- the prefix, then each language's sorted
    block with a running offset.  Blocks follow ``order``, in which every
    language of the data must be listed (others raise), or without one the
    languages' own order."""
    words = df.select(group_col, F.explode(toks_col).alias("word")).distinct()
    block = F.col(group_col)
    if order is not None:
        block = F
        for i, g in enumerate(order):
            block = block.when(F.col(group_col) == g, F.lit(i))
        block = block.otherwise(F.raise_error(F.concat(F.lit("language without a place in the order: "), F.col(group_col))))
    ranked = dense_index(words.withColumn("__block", block), ["__block", "word"], "idx", offset=len(prefix)).drop("__block")
    if not prefix:
        return ranked
    spark = df.sparkSession
    pre = spark.createDataFrame([(None, w, i) for i, w in enumerate(prefix)],
                                f"{group_col} string, word string, idx long")
    return pre.unionByName(ranked)
