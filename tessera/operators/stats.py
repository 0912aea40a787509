"""Corpus statistics: frequencies, length histograms, document frequency,
IDF, TF-IDF, per-article word weights, vector coverage (A2-A13, J7, J8, U5,
W3).

Per-word aggregates pre-aggregate map-side (Zipf-hot words collapse before
the shuffle); articles are dealt into chunks (``tessera.operators.lookup``) in
which they are counted and ranked, bounded by the article length; what is
joined to word tables is one row per distinct word of a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.lookup import chunk_words, codes, in_chunks, lookup_tokens, token_places


def doc_freq(df: DataFrame, toks_col: str = "toks", by=("lang",)) -> DataFrame:
    """A10: number of distinct articles containing each word (per ``by``);
    de-duplication happens inside each row (array_distinct), so no shuffle
    is needed for the distinct step."""
    return (df.select(*by, F.explode(F.array_distinct(toks_col)).alias("word"))
            .groupBy(*by, "word").agg(F.count(F.lit(1)).alias("df")))


def idf(df_table: DataFrame, by=("lang",), numerator: str = "vocab") -> DataFrame:
    """idf = ln(N / (1 + df)) where N is the vocabulary size per ``by``
    (the reference's choice, Q3) or, with numerator='docs', a supplied
    ``n_docs`` column.  Also the integer-truncated weight (Q4)."""
    if numerator == "vocab":
        sizes = df_table.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
        t = df_table.join(sizes, list(by))
    else:
        t = df_table.withColumnRenamed("n_docs", "__n")
    val = F.log(F.col("__n") / (F.lit(1) + F.col("df")))
    return t.select(*by, "word", "df", val.alias("idf")).withColumn(
        "idf_trunc", F.col("idf").cast("int"))


def position_weights(df: DataFrame, id_col: str, toks_col: str, weights: DataFrame,
                     weight_col: str, by=("lang",), default=0.0, out_col: str = "weights",
                     frequent: DataFrame | None = None) -> DataFrame:
    """Per-position lookup of a per-word weight (default when absent),
    returned as an array in token order."""
    found = lookup_tokens(df, id_col, toks_col, weights, F.col(weight_col).cast("double"), by, frequent=frequent, words=False)
    return found.select(id_col, F.transform("__s", lambda s: F.coalesce(s["value"], F.lit(default))).alias(out_col))


def tfidf_top(df: DataFrame, id_col: str = "id", toks_col: str = "toks", k: int = 10,
              by=("lang",), min_len: int = 2) -> DataFrame:
    """A12 + W3: smoothed TF-IDF per (article, term) -- raw tf x
    (ln((1 + n) / (1 + df)) + 1), L2-normalised per article, terms of at
    least ``min_len`` characters -- and the top ``k`` terms per article
    (score desc, term asc).  n and df are per ``by`` group."""
    by = list(by)
    terms = df.select(id_col, *by, F.filter(toks_col, lambda t: F.length(t) >= min_len).alias("__t"))
    ndocs = terms.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    factor = F.log((F.lit(1) + F.col("__n")) / (F.lit(1) + F.col("df"))) + F.lit(1)
    factors = doc_freq(terms, "__t", by).join(ndocs, by).select(*by, F.col("word").alias("__w"), factor.alias("__f"))
    # an article's terms are counted and ranked in its chunk; only the chunk's distinct terms fetch their factors
    dealt, few = in_chunks(terms, "__t", [id_col])
    found = chunk_words(few, "__t", by).join(factors, [*by, "__w"])
    schema = T.StructType([terms.schema[id_col], *[found.schema[c] for c in by], T.StructField("rank", T.IntegerType()),
                           T.StructField("word", T.StringType()), T.StructField("tfidf", T.DoubleType())])

    def ranked(docs: pa.Table, found: pa.Table) -> pa.Table:
        _, row, _, at = token_places(docs, found, "__t", by)
        article, number = codes(docs, [id_col])
        first = np.unique(article, return_index=True)[1]
        size = max(found.num_rows, 1)
        pairs, tf = np.unique((article[row] * size + at)[at >= 0], return_counts=True)
        of, term = pairs // size, pairs % size
        raw = tf * found["__f"].to_numpy()[term] if len(pairs) else np.zeros(0)
        place = pc.rank(found["__w"].combine_chunks(), tiebreaker="dense").to_numpy()
        order = np.lexsort((place[term], -raw, of)) if len(pairs) else np.zeros(0, dtype=np.int64)
        of, term, raw = of[order], term[order], raw[order]
        norm = np.sqrt(np.bincount(of, weights=raw * raw, minlength=len(number)))
        ends = np.cumsum(np.bincount(of, minlength=len(number)))
        rank = np.arange(len(of)) - np.concatenate([[0], ends])[of] + 1
        top = rank <= k
        of, term = of[top], pa.array(term[top])
        columns = [docs[id_col].take(pa.array(first[of])), *[found[c].take(term) for c in by], pa.array(rank[top].astype(np.int32)),
                   found["__w"].take(term), pa.array(raw[top] / norm[of])]
        return pa.Table.from_arrays(columns, schema.names)
    top = dealt.groupBy("__chunk").cogroup(found.groupBy("__chunk")).applyInArrow(ranked, schema)
    return top.withColumn("tfidf", F.round("tfidf", 6))


def word_weight_top(df: DataFrame, id_col: str, weights_col: str, toks_col: str, k: int = 10) -> DataFrame:
    """A13 (+W3): mean weight per distinct word inside an article, ranked
    descending (word ascending on ties)."""
    zipped = F.transform(toks_col, lambda t, i: F.struct(t.alias("w"), F.col(weights_col)[i].alias("x")))
    # dealt out by article once, all that follows is done where the article is
    dealt, _ = in_chunks(df.select(id_col, toks_col, weights_col), toks_col, [id_col])
    pairs = dealt.select("__chunk", id_col, F.explode(zipped).alias("__z"))
    agg = (pairs.select("__chunk", id_col, F.col("__z.w").alias("word"), F.col("__z.x").alias("x"))
           .groupBy("__chunk", id_col, "word").agg(F.avg("x").alias("weight")))
    w = Window.partitionBy("__chunk", id_col).orderBy(F.col("weight").desc(), F.col("word"))
    return (agg.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(id_col, "rank", "word", F.round("weight", 6).alias("weight")))


def length_table(df: DataFrame, toks_col: str = "toks") -> DataFrame:
    """A3: number of articles per token count."""
    return (df.select(F.coalesce(F.size(toks_col), F.lit(0)).alias("n_tokens"))
            .groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_articles")))


def histogram_bins(lengths: DataFrame, value_col: str, bins: int) -> DataFrame:
    """Equal-width bins between min and max (last bin closed), the binning
    of the reference's histogram; min/max are scalar subqueries."""
    mn = lengths.select(F.min(value_col)).scalar()
    mx = lengths.select(F.max(value_col)).scalar()
    width = mx - mn
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value_col) - mn) * F.lit(bins) / width), F.lit(bins - 1)))
    return lengths.withColumn("bin", b.cast("int"))


def article_coverage(df: DataFrame, vectors: DataFrame, id_col: str = "id", toks_col: str = "toks", by=(),
                     frequent: DataFrame | None = None) -> DataFrame:
    """Share (in %) of an article's tokens, with multiplicity, that have
    a vector (of the article's language, with ``by``); the missing tokens in
    order; total; empty article = 100."""
    by = list(by)
    found = lookup_tokens(df, id_col, toks_col, vectors.select(*by, "word").distinct(), None, by, "word", by, frequent)
    total = F.size("__s").cast("long")
    missing = F.transform(F.filter("__s", lambda s: s["value"].isNull()), lambda s: s["word"])
    share = (total - F.size(missing)) * F.lit(100.0) / total
    return found.select(id_col, *by, total.alias("total"), F.when(total == 0, F.lit(100.0)).otherwise(share).alias("coverage"),
                        missing.alias("missing"))
