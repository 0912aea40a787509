"""Looking up every token of an article in a word table (J3, J4, J7, T11,
T17, A9, A18, A19): articles are dealt into chunks, and only a chunk's
distinct words travel.

A chunk holds about CHUNK tokens of whole articles.  Its distinct words go to
the word table and their values come back as the chunk's own small table, so
what is exchanged is every article once for its words and once for its values,
and each distinct word of a chunk, not a row per token.  A word that makes up
a third of all occurrences is one row per chunk.

Words that make up at least one in FREQUENT of all occurrences (so there are
FREQUENT at most, and they are short) stand in nearly every chunk; their values
are broadcast, and only the other words of a chunk go to their word.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize

FREQUENT = 100_000
LONGEST = 64           # characters of a frequent word
CHUNK = 2_000_000      # tokens of a chunk, about
CHUNK_ROWS = 100_000   # articles of a chunk, about


def word_occurrences(df: DataFrame, toks_col: str, by=(), share: int = FREQUENT) -> DataFrame:
    """(by.., word, n): the words (or ids) with at least one in ``share`` of
    all occurrences; no more than ``share`` rows, whatever the data."""
    counts = df.select(*by, F.explode(toks_col).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.select(F.sum("n")).scalar()
    return counts.filter((F.col("n") * F.lit(share) >= total) & (F.length(F.col("word").cast("string")) <= LONGEST))


def with_values(rows: DataFrame, table: DataFrame, value: Column | None, by=(), row_word: str = "word",
                word_col: str = "word", *, frequent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` plus __v, the value of each row's word, in two parts: rows of
    frequent words or none, which stay in their tasks, and the rest, joined by
    word.  ``frequent`` (by.., word) has few enough rows to be broadcast."""
    by = list(by)
    right = table.select(*by, F.col(word_col).alias("__k"), (F.lit(True) if value is None else value).alias("__v"))
    few = frequent.select(*by, F.col("word").alias("__k")).join(right, [*by, "__k"], "left").withColumn("__few", F.lit(True))
    left = rows.withColumn("__k", F.col(row_word))
    near = left.join(F.broadcast(few), [*by, "__k"], "left").filter("__few or __k is null").drop("__few", "__k")
    rest = left.filter("__k is not null").join(F.broadcast(frequent.select(*by, F.col("word").alias("__k"))), [*by, "__k"], "left_anti")
    return near, rest.join(right, [*by, "__k"], "left").drop("__k")


def in_chunks(df: DataFrame, toks_col: str, deal_by) -> tuple[DataFrame, DataFrame]:
    """``df`` plus __chunk, dealt out by it, and the same with each row's
    distinct tokens; rows alike in ``deal_by`` share a chunk.  One pass counts
    tokens and rows; small tables make a chunk for each task slot."""
    rows, tokens = df.select(F.count(F.lit(1)), F.sum(F.greatest(F.coalesce(F.size(toks_col), F.lit(0)), F.lit(0)))).first()
    n = max(math.ceil((tokens or 0) / CHUNK), math.ceil(rows / CHUNK_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    chunked = df.withColumn("__chunk", F.pmod(F.xxhash64(*deal_by), F.lit(n)))
    few = chunked.withColumn(toks_col, F.array_distinct(toks_col))
    return chunked.repartition(n, "__chunk"), few.repartition(n, "__chunk")


def chunk_words(few: DataFrame, toks_col: str, by=()) -> DataFrame:
    """(__chunk, by.., __w): the distinct words of every chunk, written once;
    they are found where the chunk is, from each article's distinct words."""
    return materialize(few.select("__chunk", *by, F.explode(toks_col).alias("__w")).distinct(), "chunk-words")


def codes(table: pa.Table, cols) -> tuple[np.ndarray, dict]:
    """A number for each row's values in ``cols``, and the numbers of the values."""
    number: dict = {}
    rows = zip(*[table[c].to_pylist() for c in cols]) if cols else [()] * table.num_rows
    return np.array([number.setdefault(r, len(number)) for r in rows], dtype=np.int64), number


def token_places(docs: pa.Table, found: pa.Table, toks_col: str, by):
    """Of one chunk: all tokens, each one's row of ``docs`` and its place there,
    and its row of ``found`` (by.., __w), -1 where the word is not there."""
    lists = docs[toks_col].combine_chunks()
    lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lens)), lens)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    at = np.full(len(flat), -1, dtype=np.int64)
    words = found["__w"].combine_chunks()
    own, _ = codes(docs, by)
    theirs, number = codes(found, by)
    if by:      # the same numbers on both sides
        own = np.array([number.get(r, -1) for r in zip(*[docs[c].to_pylist() for c in by])], dtype=np.int64)
    for g in range(len(number)):
        here, there = np.flatnonzero(own[row] == g), np.flatnonzero(theirs == g)
        hit = pc.fill_null(pc.index_in(flat.take(pa.array(here)), value_set=words.take(pa.array(there))), -1).to_numpy(zero_copy_only=False)
        at[here] = np.where(hit >= 0, there[hit], -1)
    return flat, row, pos, at


def lookup_tokens(df: DataFrame, id_col: str, toks_col: str, table: DataFrame, value: Column | None,
                  by=(), word_col: str = "word", extra=(), frequent: DataFrame | None = None, words: bool = True) -> DataFrame:
    """(id, *extra, __s): per article an array of (pos, word, value) in token
    order, without the word unless ``words``.  ``table`` has one row for each
    (by.., word) and ``value`` is an expression over its columns, null for a
    word that is not there.  Rows that share id and extra make one list.
    ``frequent`` is the result of ``word_occurrences`` where it is at hand; it
    is counted here otherwise."""
    by, extra = list(by), [c for c in extra if c != id_col]
    if frequent is None:
        frequent = word_occurrences(df, toks_col, by)
    keys = list(dict.fromkeys([id_col, *extra]))
    dealt, few = in_chunks(df.select(*dict.fromkeys([*keys, *by]), F.col(toks_col).alias("__t")), "__t", keys)
    near, far = with_values(chunk_words(few, "__t", by), table, value, by, "__w", word_col, frequent=frequent)
    cols = ["__chunk", *by, "__w", "__v"]
    found = near.select(*cols).unionByName(far.select(*cols)).filter("__v is not null")
    fields = [T.StructField("__pos", T.IntegerType()), *([T.StructField("word", found.schema["__w"].dataType)] if words else []),
              T.StructField("value", found.schema["__v"].dataType)]
    schema = T.StructType([*[T.StructField(c, dealt.schema[c].dataType) for c in keys],
                           T.StructField("__s", T.ArrayType(T.StructType(fields)))])
    names = [f.name for f in fields]

    def fill(docs: pa.Table, found: pa.Table) -> pa.Table:
        flat, row, pos, at = token_places(docs, found, "__t", by)
        value = found["__v"].combine_chunks().take(pa.array(at, mask=at < 0))
        parts = [pa.array(pos.astype(np.int32)), *([flat] if words else []), value]
        structs = pa.StructArray.from_arrays(parts, names)
        article, number = codes(docs, keys)
        if len(number) < docs.num_rows:     # rows of one article: its list is in the order of place, word and value
            ranks = [pc.rank(x.cast(pa.int8()) if pa.types.is_boolean(x.type) else x, tiebreaker="dense", null_placement="at_start").to_numpy()
                     for x in parts[1:]]
            structs = structs.take(pa.array(np.lexsort((*ranks[::-1], pos, article[row]))))
            docs = docs.take(pa.array(np.unique(article, return_index=True)[1]))
        ends = np.cumsum(np.bincount(article[row], minlength=len(number)))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), structs)
        return pa.Table.from_arrays([*[docs[c] for c in keys], lists], [*keys, "__s"])
    return dealt.groupBy("__chunk").cogroup(found.groupBy("__chunk")).applyInArrow(fill, schema)
