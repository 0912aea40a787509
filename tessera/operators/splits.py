"""Reproducible exact-size splits, split application, overlap checks and
language mixes (X1-X6, U4).

Order is a keyed hash, md5("<seed>:<id>") -- identical in every engine and
independent of partitioning.  Split points are found by selection: a grouped
count of the leading hash digits tells in which bucket the k-th hash is, and
only that bucket is refined, until it is exact.  So a split is a comparison of
each row's hash with a few literals: nothing is sorted, shuffled or written,
and exact sizes never need one task to see all rows.  Rows that repeat an id
have one hash and fall on one side, so no id leaks into two parts; sizes then
are as near as whole ids allow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.vocab import rank_within

DIGITS = 4              # hash digits by which a bucket is refined: 65,536 counts reach the driver
FEW = 4096              # hashes of a bucket that are looked at one by one
HASH_DIGITS = 32


def seeded_key(id_col: str, seed, salt: str = "") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}{salt}:"), F.col(id_col).cast("string")))


def cut_points(df: DataFrame, key: Column, places: Callable[[int], list[int]]) -> list[str | None]:
    """For each of ``places(number of rows)`` the key of the row at that place
    (counted from 1) in the order of ``key``, a string of HASH_DIGITS hex
    digits; None for places before the first row.  Places after the last get
    the last.  The driver sees DIGITS digits' counts per pass and FEW keys."""
    rows = df.select(key.alias("h")).filter("h is not null")

    def counted(prefixes: set[str]) -> dict[str, int]:
        size = len(next(iter(prefixes)))
        some = rows.filter(F.substring("h", 1, size).isin(*prefixes)) if size else rows
        groups = some.groupBy(F.substring("h", 1, size + DIGITS).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        return {r["p"]: r["n"] for r in groups.collect()}                    # 16 ** DIGITS for each prefix, at most

    counts = counted({""})
    total = sum(counts.values())
    wanted = [min(k, total) for k in places(total)]
    at = {k: ("", k) for k in wanted if k > 0}                               # place -> bucket, place inside it
    while True:
        for k, (prefix, inside) in at.items():
            for p in sorted(q for q in counts if q.startswith(prefix)):
                if inside <= counts[p]:
                    at[k] = p, inside
                    break
                inside -= counts[p]
        open_ = {p for p, _ in at.values() if counts[p] > FEW and len(p) < HASH_DIGITS}
        few = {p for p, _ in at.values()} - open_
        if not open_:
            break
        done = {k: v for k, v in at.items() if v[0] in few}
        more = {k: v for k, v in at.items() if v[0] in open_}
        counts = counted(open_) | {p: counts[p] for p, _ in done.values()}
    keys: dict[str, list[str]] = {}
    short = {p for p in few if len(p) < HASH_DIGITS}
    if short:
        sizes = {len(p) for p in short}
        hit = None
        for n in sizes:
            test = F.substring("h", 1, n).isin(*[p for p in short if len(p) == n])
            hit = test if hit is None else hit | test
        for r in rows.filter(hit).collect():                                 # FEW for each place, at most
            for n in sizes:
                keys.setdefault(r["h"][:n], []).append(r["h"])
    return [None if k <= 0 else at[k][0] if len(at[k][0]) >= HASH_DIGITS else sorted(keys[at[k][0]])[at[k][1] - 1] for k in wanted]


def up_to(key: Column, cut: str | None) -> Column:
    """Whether a row stands at or before a cut point."""
    return F.lit(False) if cut is None else key <= cut


def split_80_10_10(df: DataFrame, id_col: str, seed=1, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Permutation by seeded hash; train = first int(train*m), val = next
    int(val*m), test = rest.  A null id has no hash and is in test."""
    key = seeded_key(id_col, seed)
    first, second = cut_points(df, key, lambda m: [int(train * m), int(train * m) + int(val * m)])
    return df.withColumn("split", F.when(up_to(key, first), F.lit("train")).when(up_to(key, second), F.lit("val")).otherwise(F.lit("test")))


def split_nested(keys: DataFrame, key_col: str, train_size: int, sub_size: int, val_size: int,
                 seed=57, names=("monolingual_train", "multilingual_train", "val", "test"),
                 keep_rest: bool = True) -> DataFrame:
    """Exact-size nested split of distinct keys -- ``train_size`` keys,
    ``sub_size`` of those as a nested subset, ``val_size`` of the remaining
    keys, the rest as test (dropped when ``keep_rest`` is False).  All cuts
    are ranges of one seeded order.  Returns (key, split) memberships; a
    nested key has two rows."""
    k = keys.select(key_col).distinct()
    key = seeded_key(key_col, seed)
    sub, train, val = (up_to(key, c) for c in cut_points(k, key, lambda m: [sub_size, train_size, train_size + val_size]))
    part = (F.when(sub, F.array(F.lit(names[0]), F.lit(names[1]))).when(train, F.array(F.lit(names[0])))
            .when(val, F.array(F.lit(names[2])))
            .otherwise(F.array(F.lit(names[3])) if keep_rest else F.array().cast("array<string>")))
    return k.select(key_col, F.explode(part).alias("split"))


def apply_split(df: DataFrame, members: DataFrame, key_col: str) -> DataFrame:
    """Attach the split of every row's key (rows of every language,
    multiplicity kept; a key in a nested split yields one row per split)."""
    return df.join(members, key_col, "inner")


def split_overlaps(members: DataFrame, key_col: str) -> DataFrame:
    """Number of keys shared by each ordered pair of splits.  Pairs are
    formed per key among that key's own (few) splits."""
    per_key = members.groupBy(key_col).agg(F.collect_set("split").alias("__s"))
    a = per_key.select(key_col, "__s", F.explode("__s").alias("split_a"))
    b = a.select("split_a", F.explode("__s").alias("split_b")).filter(F.col("split_a") != F.col("split_b"))
    return b.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("n_common"))


def build_mixes(df: DataFrame, lang_col: str, id_col: str, mixes: dict, seed=57) -> DataFrame:
    """U4 + X4: concatenate the languages of each mix and shuffle each mix
    by a seeded hash; ``position`` is the row's place in its mix."""
    spark = df.sparkSession
    table = spark.createDataFrame([(m, l) for m, ls in mixes.items() for l in ls], f"mix string, {lang_col} string")
    rows = df.join(F.broadcast(table), lang_col)
    keyed = rows.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("mix"), F.lit(":"),
                                                  F.col(id_col).cast("string"))))
    return rank_within(keyed, ["mix"], ["__h", id_col], "position").drop("__h")
