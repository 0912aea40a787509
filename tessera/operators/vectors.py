"""Word vectors: embedding tables, stacked / summed multilingual tables,
averaged and weighted document vectors (J5, J6, M8, M9, A18-A20).

Element-wise sums are exact and order-independent: components are turned
into integer micro-units (round(x * 1e6), BIGINT) before summing, so any
partition layout gives the same bits.  (Spark ML's Summarizer is not used:
it derives sums from a running mean, which is not exact.)  Articles are dealt
into chunks (``tessera.operators.lookup``); a vector goes once to each chunk
that has its word, the chunk adds up its articles, and the partial sums of an
article are folded element-wise with ``zip_with`` after one exchange -- no
vector per occurrence and no per-dimension explode.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.lookup import chunk_words, in_chunks, token_places

MICRO = 1_000_000.0
PAIRS = 50_000         # pairs of article and word that a task multiplies at a time


def micro(vec) -> Column:
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.transform(v, lambda x: F.round(x.cast("double") * F.lit(MICRO)).cast("long"))


def zeros(d) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), d)


def embedding_matrix(vocab: DataFrame, vectors: DataFrame, dim, by=()) -> DataFrame:
    """Every vocabulary row (of each ``by`` group) with its vector, a zero
    vector when absent, and a found flag (the reference's hit count is
    sum(found))."""
    j = vocab.join(vectors.select(*by, "word", F.col("vec").alias("__v")), [*by, "word"], "left")
    return j.select(*by, "idx", "word", F.coalesce("__v", zeros(dim)).alias("vec"),
                    F.col("__v").isNotNull().alias("found"))


def gaussian_fill(word_col: str, dim: int, seed: int, scale: float = 0.6) -> Column:
    """J6 default vector: scale * N(0, 1) per component, drawn from a
    hash of (seed, word, component) with Box-Muller, so the draw is
    reproducible whatever the partitioning."""
    def comp(i):
        h1 = F.xxhash64(F.lit(seed), F.col(word_col), i, F.lit(1))
        h2 = F.xxhash64(F.lit(seed), F.col(word_col), i, F.lit(2))
        u1 = (F.pmod(h1, F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
        u2 = F.pmod(h2, F.lit(1 << 30)) / F.lit(float(1 << 30))
        return (F.lit(scale) * F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)).cast("float")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), comp)


def _sum_arrays(df: DataFrame, key_cols, vec_col: str, factor_col: str, out_col: str) -> DataFrame:
    """Exact element-wise sum, in micro-units, of factor x vector per key.

    The float vectors and their factors of one key (one article's distinct
    matched words, or one word's few languages -- bounded by the article /
    the language count) move once; they become micro-units after the
    exchange and are folded with ``zip_with``."""
    g = df.groupBy(*key_cols).agg(F.collect_list(F.struct(F.col(vec_col).alias("v"), F.col(factor_col).alias("f"))).alias("__l"))
    zero = F.array_repeat(F.lit(0).cast("long"), F.size(F.element_at("__l", 1)["v"]))
    summed = F.aggregate("__l", zero, lambda acc, x: F.zip_with(acc, micro(x["v"]), lambda a, b: a + b * x["f"]))
    return g.select(*key_cols, F.size("__l").cast("long").alias("__rows"), summed.alias(out_col))


def _partial_sums(df: DataFrame, key: str, vec_col: str, factor_col: str) -> DataFrame:
    """(key, __p): within every task, the sum of factor x vector of each key,
    vectors in micro-units.  Rows are sorted by key inside the task (which
    spills) and only the key at a batch's end is carried over, so a task holds
    one batch and sends each key once."""
    rows = df.filter(F.col(vec_col).isNotNull()).select(key, F.col(vec_col).alias("__v"), F.col(factor_col).alias("__f")).sortWithinPartitions(key)
    # nulls sort first and compare by identity, so a key's number says where it changes
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, __p array<bigint>"

    def run(batches):
        last, carried = None, None

        def out(keys, sums):
            width = sums.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * width), pa.array(sums.ravel()))
            return pa.RecordBatch.from_arrays([keys, lists], [key, "__p"])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, vecs = batch.column(0), batch.column(1)
            v = vecs.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) * batch.column(2).to_numpy(zero_copy_only=False)[:, None]
            changed = pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            nulls = keys.is_null().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(changed & ~(nulls[1:] & nulls[:-1])) + 1])
            sums, firsts = np.add.reduceat(v, starts, axis=0), keys.take(pa.array(starts))
            if carried is not None:
                if last[0].equals(firsts[0]):
                    sums[0] += carried
                else:
                    yield out(last, carried[None, :])
            if len(sums) > 1:
                yield out(firsts.slice(0, len(sums) - 1), sums[:-1])
            last, carried = firsts.slice(len(sums) - 1), sums[-1].copy()
        if carried is not None:
            yield out(last, carried[None, :])
    return rows.mapInArrow(run, schema)


def _sum_partials(df: DataFrame, key: str, vec_col: str, factor_col: str) -> DataFrame:
    """(key, __s): exact sums of factor x vector, added up in the tasks that
    hold the rows; the exchange carries one vector per (key, task)."""
    g = _partial_sums(df, key, vec_col, factor_col).groupBy(key).agg(F.collect_list("__p").alias("__l"))
    first = F.element_at("__l", 1)
    rest = F.slice("__l", 2, F.size("__l"))
    return g.select(key, F.aggregate(rest, first, lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b)).alias("__s"))


def summed_by_word(vectors: DataFrame, key_cols=("word",)) -> DataFrame:
    """M9: element-wise sum of the vectors sharing a key (exact), with the
    number of rows summed."""
    key_cols = list(key_cols)
    sums = _sum_arrays(vectors.withColumn("__f", F.lit(1).cast("long")), key_cols, "vec", "__f", "__s")
    return sums.select(*key_cols, F.col("__rows").alias("n"), F.transform(
        "__s", lambda x: F.round(x / F.lit(MICRO), 6)).alias("vec"))


def weighted_doc_vectors(df: DataFrame, id_col: str, toks_col: str, vectors: DataFrame, dim,
                         weights: DataFrame | None = None, by=(), mean: bool = True, paged: bool = False) -> DataFrame:
    """A18 (mean=True): article vector = sum of token vectors / token count,
    OOV tokens are zero but counted (Q5).  A19 (weights given, mean=False):
    sum of weight(word) x vector over positions, weights per (by, word).
    Empty articles are left out (Q16).  With ``paged`` an article's tokens
    may stand in several rows."""
    base = df.select(id_col, *by, toks_col).filter(F.coalesce(F.size(toks_col), F.lit(0)) > 0)
    dealt, few = in_chunks(base, toks_col, [id_col, toks_col])      # the pages of one article need not share a chunk
    keys = [c for c in by if c in vectors.columns] + ["word"]
    # once per word, not per occurrence; rows that repeat a word add up
    vec = _sum_arrays(vectors.filter("vec is not null").withColumn("__1", F.lit(1).cast("long")), keys, "vec", "__1", "__m")
    found = chunk_words(few, toks_col, by).withColumn("word", F.col("__w")).join(vec.drop("__rows"), keys, "inner")
    if weights is not None:
        each = weights.groupBy(*by, "word").agg(F.sum(F.coalesce(F.col("weight"), F.lit(0)).cast("long")).alias("__f"))
        found = found.join(each, [*by, "word"], "left")
    factor = F.lit(1).cast("long") if weights is None else F.coalesce("__f", F.lit(0).cast("long"))
    found = found.select("__chunk", *by, "__w", "__m", factor.alias("__f"))
    schema = f"`{id_col}` {base.schema[id_col].dataType.simpleString()}, __p array<bigint>"

    def add_up(docs: pa.Table, found: pa.Table) -> pa.Table:
        _, row, _, at = token_places(docs, found, toks_col, by)
        k = max(found.num_rows, 1)
        pairs, n = np.unique((row * k + at)[at >= 0], return_counts=True)
        rows, r = np.unique(pairs // k, return_inverse=True)
        if not len(rows):
            return pa.table({id_col: docs[id_col].slice(0, 0), "__p": pa.array([], pa.list_(pa.int64()))})
        m = found["__m"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(k, -1) * found["__f"].to_numpy()[:, None]
        sums = np.zeros((len(rows), m.shape[1]), dtype=np.int64)
        for i in range(0, len(pairs), PAIRS):
            part, of = m[pairs[i:i + PAIRS] % k] * n[i:i + PAIRS, None], r[i:i + PAIRS]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            sums[of[starts]] += np.add.reduceat(part, starts, axis=0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * m.shape[1]), pa.array(sums.ravel()))
        return pa.Table.from_arrays([docs[id_col].take(pa.array(rows)), lists], [id_col, "__p"])
    parts = dealt.groupBy("__chunk").cogroup(found.groupBy("__chunk")).applyInArrow(add_up, schema)
    sums = _sum_partials(parts.withColumn("__1", F.lit(1).cast("long")), id_col, "__p", "__1")
    sized = base.select(id_col, F.size(toks_col).alias("__len"))
    if paged:
        sized = sized.groupBy(id_col).agg(F.sum("__len").alias("__len"))
    out = sized.join(sums, id_col, "left")
    arr = F.coalesce(F.col("__s").cast("array<double>"), F.array_repeat(F.lit(0.0), dim))
    # round half up in micro-units, then scale: the same IEEE operations in
    # every engine (decimal rounding of a binary double is engine-specific)
    if mean:
        vals = F.transform(arr, lambda x: F.floor(x / F.col("__len") + F.lit(0.5)) / F.lit(MICRO))
    else:
        vals = F.transform(arr, lambda x: x / F.lit(MICRO))
    return out.select(id_col, vals.alias("vec"))
