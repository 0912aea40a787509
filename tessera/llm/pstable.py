"""Near-duplicate embeddings by p-stable (Euclidean) hashing.

1. Vectors are normalised in double precision.  Each of 64 tables quantises
   20 Gaussian projections, ``floor((a . v + b) / 2.5)``, into one bucket
   key.  Two unit vectors at cosine 0.9 (distance 0.447) agree on a
   projection with probability 0.857, so they meet in some table with
   probability 0.95; at cosine 0.95 with 0.9997; unrelated vectors (distance
   1.41) meet in a table with probability 1e-5.
2. Buckets, dealt into blocks, compare 8-bit copies of the vectors with a
   margin no smaller than their rounding error; a spanning forest of what
   passes gives candidate components.
3. Inside each candidate component all pairs are compared exactly, block
   against block as matrix products.  A task returns link counts per vector
   and a spanning forest, never the pairs.  Links missed by every table are
   found here when the two vectors are connected through others.

Equal vectors are folded into one node first, with their number, so copies
cost nothing however many there are.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component link with nothing, as do rows with a null id; vectors of
different lengths never link; rows that repeat an id count as vectors of
their own and share the id's component; empty tables give empty tables;
labels and other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, slices
from tessera.llm.components import connected_components, deal, forest, link_blocks, runs

TABLES, PROJECTIONS, WIDTH = 64, 20, 2.5
BUCKET_BLOCK, PAIR_BLOCK = 2048, 1024
SEED = 77


@lru_cache(maxsize=8)
def family(dim: int, tables: int, projections: int, width: float):
    """Projections, offsets and the multipliers that fold a table's quanta into a key."""
    rng = np.random.default_rng([SEED, dim])
    a = rng.standard_normal((dim, tables * projections))
    b = rng.uniform(0, width, tables * projections)
    mult = rng.integers(1 << 62, 1 << 63, (tables, projections), dtype=np.uint64) | np.uint64(1)
    return a, b, mult, rng.integers(0, 1 << 63, tables, dtype=np.uint64)


def bucket_keys(unit: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> np.ndarray:
    """Keys of unit vectors, one row each, one column for each table."""
    a, b, mult, add = family(unit.shape[1], tables, projections, width)
    q = np.floor((unit @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, projections)
    h = (q * mult).sum(axis=2, dtype=np.uint64) + add
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def unit_vector(values) -> np.ndarray | None:
    """A list of numbers as a unit vector in double precision, or None."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    v = np.asarray(values, dtype=np.float64)
    if not np.isfinite(v).all() or not (top := np.abs(v).max()):
        return None
    v = v / top
    return v / np.sqrt((v * v).sum())


def eight_bit(unit: np.ndarray) -> bytes:
    return np.rint(unit * (127 / np.abs(unit).max())).astype(np.int8).tobytes()


def sketch(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, key, v, q, bands): bytes that tell vectors apart, the unit
    vector, its 8-bit copy and its bucket keys; nulls where it links with nothing."""
    schema = "vec_id long, key binary, v binary, q binary, bands array<long>"

    def run(batches):
        for batch in batches:
            for part in slices(batch, 512):
                ids = part.column("vec_id").to_pylist()
                units = [unit_vector(v) if i is not None else None for i, v in zip(ids, part.column("v").to_pylist())]
                bands: list = [None] * len(units)
                for dim in {len(u) for u in units if u is not None}:
                    rows = [i for i, u in enumerate(units) if u is not None and len(u) == dim]
                    for i, keys in zip(rows, bucket_keys(np.stack([units[i] for i in rows]))):
                        bands[i] = keys
                from xxhash import xxh3_128_digest
                raw = [None if u is None else u.tobytes() for u in units]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array([None if r is None else xxh3_128_digest(r) for r in raw], pa.binary()),
                     pa.array(raw, pa.binary()), pa.array([None if u is None else eight_bit(u) for u in units], pa.binary()),
                     pa.array(bands, pa.list_(pa.int64()))], ["vec_id", "key", "v", "q", "bands"])
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, schema)


class EightBit:
    """8-bit copies, linked when their cosine could be the exact one's bound."""

    def __init__(self, payloads, cosine: float):
        q = np.frombuffer(b"".join(payloads), dtype=np.int8).reshape(len(payloads), -1).astype(np.float32)
        self.rows = q / np.sqrt((q * q).sum(axis=1, keepdims=True))
        self.least = cosine - np.sqrt(q.shape[1]) / 127 - 1e-4     # each copy is off by at most half of that

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        return self.rows[others] @ self.rows[i] >= self.least


class Links:
    """A block's links as a boolean matrix."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        return self.matrix[i, others]


def exact_links(rows: DataFrame, cosine: float) -> DataFrame:
    """Rows (g, k, blk, id, copies, v) of groups in blocks -> (a, b, n): for
    b null, n rows linked with a in some pair of blocks; else an edge."""
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    pairs = (rows.withColumn("o", other).select("g", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"),
                                                "blk", "id", "copies", "v"))

    def run(batches):
        for (_, i, j), (blk, ids, copies, vs) in runs(batches, ["g", "i", "j"], ["blk", "id", "copies", "v"]):
            n = len(ids)
            v = np.frombuffer(b"".join(vs), dtype=np.float64).reshape(n, -1)
            link = v @ v.T >= cosine
            if i != j:
                link &= blk[:, None] != blk[None, :]
            np.fill_diagonal(link, False)
            count = link @ copies
            has = np.flatnonzero(count)
            if not len(has):
                continue
            label = forest(Links(link), n)
            edge = np.flatnonzero(label != np.arange(n))
            a = np.concatenate((ids[has], ids[edge]))
            b = pa.array(np.concatenate((np.zeros(len(has), dtype=np.int64), ids[label[edge]])),
                         mask=np.concatenate((np.ones(len(has), dtype=bool), np.zeros(len(edge), dtype=bool))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), b, pa.array(np.concatenate((count[has], np.zeros(len(edge), dtype=np.int64))))], ["a", "b", "n"])
    return (pairs.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "id")
            .mapInArrow(run, "a long, b long, n long"))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per input row: vec_id, n_links (other vectors linked directly),
    component_id (smallest id reachable, its own included), kept."""
    vectors = materialize(sketch(df, id_col, vector_col), "vectors")
    nodes = materialize(vectors.filter("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"),
        F.first("v").alias("v"), F.first("q").alias("q"), F.first("bands").alias("bands")), "nodes")
    buckets = deal(nodes.select(F.explode("bands").alias("g"), "id"), BUCKET_BLOCK)
    candidates = link_blocks(buckets.join(nodes.select("id", F.col("q").alias("p")), "id"),
                             partial(EightBit, cosine=cosine), BUCKET_BLOCK)
    groups = connected_components(candidates).select("id", F.col("component").alias("g"))
    members = materialize(nodes.select("id", "copies", "v").join(groups, "id"), "members")
    found = materialize(exact_links(deal(members, PAIR_BLOCK), cosine), "found")
    counts = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    classes = connected_components(found.filter("b is not null").select("a", "b"))
    per_node = (nodes.select("key", "id", "copies").join(counts, "id", "left").join(classes, "id", "left")
                .select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"),
                        F.coalesce("component", "id").alias("component")))
    out = vectors.select("vec_id", "key").join(per_node, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
