"""Near-duplicate documents by b-bit MinHash.

1. One pass turns each text into its set of distinct 5-word shingles (64-bit
   hashes) and takes 128 minima.  Of each minimum the low 4 bits are kept and
   packed into a 64-byte signature; 32 bands of 4 full minima give band keys.
   Texts with equal sets are one node from here on.
2. Nodes that share a band key are candidates.  Inside a bucket, dealt into
   blocks, signatures are compared by bit counts: the share of equal lanes,
   corrected for the 1/16 of lanes that agree by chance, estimates the
   similarity.  Only a spanning forest of the pairs estimated at 0.55 or more
   (five standard errors below 0.75) leaves a task.
3. Documents of candidate components fetch their texts once, and links are confirmed on
   full shingle sets, again by blocks.  Components of the confirmed links are
   the result.

A pair at similarity 0.75 shares no band with probability 5e-6 and is
estimated too low with probability 3e-7; links found are exact.

Defined results: null and word-less texts have an empty set and link with
nothing; a row with a null id takes the component of an equal set that has an
id and is kept only when there is none; links are between
ids, so rows that repeat an id with different texts are in one class, each text
with links of its own; empty tables give empty tables; other columns are
ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, slices
from tessera.llm.components import Nibbles, Sets, connected_components, deal, link_blocks

WORDS = 5
MINIMA, BAND_ROWS, LANE_BITS = 128, 4, 4
SIGNATURE_BLOCK, SET_BLOCK, SET_BLOCK_ITEMS = 2048, 512, 1 << 20
MARGIN = 0.20                                  # five standard errors of the estimate
SEED = 20260

_rng = np.random.default_rng(SEED)
_WORD_MULT = _rng.integers(1 << 62, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 1 << 32, (MINIMA, 1), dtype=np.uint32)
_MULT = _rng.integers(0, 1 << 32, (MINIMA, 1), dtype=np.uint32) | np.uint32(1)
_BAND_MULT = _rng.integers(1 << 62, 1 << 63, (MINIMA // BAND_ROWS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)
_BAND_ADD = _rng.integers(0, 1 << 63, MINIMA // BAND_ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles; of fewer
    words, the hash of the whole sequence."""
    from xxhash import xxh3_64_intdigest
    words = text.lower().split() if text else ()     # on bytes: A-Z, and \x20 \x09-\x0D
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    if n < WORDS:
        return _mix((w * _WORD_MULT[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    h = w[:n - WORDS + 1] * _WORD_MULT[0]
    for j in range(1, WORDS):
        h += w[j:n - WORDS + 1 + j] * _WORD_MULT[j]
    return np.unique(_mix(h))


def minima(items: np.ndarray, step: int = 1024) -> np.ndarray:
    """The smallest value of the items under each of the permutations."""
    low = (items & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), step):
        v = low[None, i:i + step] ^ _XOR
        v *= _MULT
        np.minimum(out, v.min(axis=1), out=out)
    return out


def signature(mins: np.ndarray) -> bytes:
    low = (mins & np.uint32((1 << LANE_BITS) - 1)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << LANE_BITS)).tobytes()


def band_keys(mins: np.ndarray) -> np.ndarray:
    bands = mins.astype(np.uint64).reshape(-1, BAND_ROWS)
    return _mix((bands * _BAND_MULT).sum(axis=1, dtype=np.uint64) + _BAND_ADD).view(np.int64)


def most_differing(similarity: float, margin: float = MARGIN) -> int:
    """Differing lanes at which the corrected estimate is still high enough."""
    chance = 2.0 ** -LANE_BITS
    return int(np.floor(MINIMA * (1 - chance) * (1 - (similarity - margin))))


def sketch(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig, bands) of every row."""
    schema = "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>"

    def run(batches):
        from xxhash import xxh3_128_digest
        for batch in batches:
            for part in slices(batch):
                size, keys, sigs, bands = [], [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    s = shingles(text)
                    m = minima(s) if len(s) else None
                    size.append(len(s))
                    keys.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(signature(m) if len(s) else None)
                    bands.append(band_keys(m) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(keys, pa.binary()),
                     pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_key", "sig", "bands"])
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _with_sets(rows: DataFrame) -> DataFrame:
    """(g, id, set_key, text) -> (g, id, p, w): the shingle set and its size,
    of the texts that have this set (an id may have others)."""
    def run(batches):
        from xxhash import xxh3_128_digest
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t).tobytes() for t in part.column("text").cast(pa.binary()).to_pylist()]
                own = [i for i, (s, k) in enumerate(zip(sets, part.column("set_key").to_pylist())) if s and xxh3_128_digest(s) == k]
                yield pa.RecordBatch.from_arrays(
                    [part.column("g").take(pa.array(own, pa.int32())), part.column("id").take(pa.array(own, pa.int32())),
                     pa.array([sets[i] for i in own], pa.binary()), pa.array([len(sets[i]) // 8 for i in own], pa.int64())], ["g", "id", "p", "w"])
    return rows.select("g", "id", "set_key", "text").mapInArrow(run, "g long, id long, p binary, w long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest
    id reachable over links, its own included) and kept (doc_id is it)."""
    docs = materialize(sketch(df, id_col, text_col), "sketch")
    nodes = materialize(docs.filter("set_key is not null").groupBy("set_key")
                        .agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")),
                        "nodes")
    known = nodes.filter("id is not null")
    buckets = deal(known.select(F.explode("bands").alias("g"), "id"), SIGNATURE_BLOCK)
    candidates = link_blocks(buckets.join(known.select("id", F.col("sig").alias("p")), "id"),
                             partial(Nibbles, most_differing=most_differing(percent / 100)), SIGNATURE_BLOCK)
    groups = materialize(connected_components(candidates), "candidates")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = _with_sets(texts.join(groups.select("id", F.col("component").alias("g")).join(known.select("id", "set_key"), "id"), "id"))
    rows = deal(materialize(sets, "sets"), SET_BLOCK, "w", SET_BLOCK_ITEMS)
    links = link_blocks(rows, partial(Sets, percent=percent), SET_BLOCK)
    found = connected_components(links)
    classes = (nodes.select("set_key", "id").join(found, "id", "left")
               .select("set_key", F.coalesce("component", "id").alias("component")))
    out = (docs.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
           .withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component"))))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
