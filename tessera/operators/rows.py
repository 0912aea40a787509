"""Row filters, rejects, cross-language alignment and set differences
(P1-P4, U1-U3, U7, J2, O1, A14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_GROUPS = 10_000


def nonempty(col: str) -> Column:
    return F.coalesce(F.size(col), F.lit(0)) > 0


def drop_empty(df: DataFrame, col: str) -> DataFrame:
    """Keep rows whose list column is non-empty (NULL counts as empty)."""
    return df.filter(nonempty(col))


def empty_report(df: DataFrame, cols) -> DataFrame:
    """P1 report: for each column in turn (applied sequentially, as the
    reference drops empty labels and then empty tokens), rows seen, rows
    dropped and the dropped share -- one aggregate pass."""
    aggs, cur = [], F.lit(True)
    for c in cols:
        seen = F.sum(cur.cast("long"))
        dropped = F.sum((cur & ~nonempty(c)).cast("long"))
        aggs += [seen.alias(f"seen_{c}"), dropped.alias(f"dropped_{c}")]
        cur = cur & nonempty(c)
    row = df.agg(*aggs)
    parts = [row.select(F.lit(c).alias("column"), F.col(f"seen_{c}").alias("n_total"),
                        F.col(f"dropped_{c}").alias("n_dropped"),
                        F.round(F.col(f"dropped_{c}") / F.col(f"seen_{c}"), 4).alias("share_dropped"))
             for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_status(df: DataFrame, checks: list) -> DataFrame:
    """Evaluate the predicates once and keep every row with a status
    (the first failing check's name, or 'kept'): rejects stay a side
    table selectable by status."""
    status = F.lit("kept")
    for name, pred in reversed(checks):
        status = F.when(~pred, F.lit(name)).otherwise(status)
    return df.withColumn("status", status)


def common_keys(df: DataFrame, key_col: str, part_col: str) -> DataFrame:
    """Keys present in every part (distinct parts per key equal the
    number of parts); one shuffle for any number of parts, and the
    (key, part) pre-distinct absorbs hot keys map-side."""
    n_parts = df.select(F.count_distinct(part_col)).scalar()
    per_key = df.select(key_col, part_col).distinct().groupBy(key_col).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.filter(F.col("__n") == n_parts).select(key_col)


def align(df: DataFrame, key_col: str, part_col: str) -> DataFrame:
    """U1 + J2 + O1: rows whose key is common to all parts, multiplicity
    kept (semi join), ordered by key."""
    return df.join(common_keys(df, key_col, part_col), key_col, "left_semi").orderBy(key_col, part_col)


def group_names(df: DataFrame, group_col: str, max_groups: int = MAX_GROUPS) -> list:
    """Distinct group names (languages, parts) -- metadata, size-checked
    before it reaches the driver."""
    rows = df.select(group_col).distinct().limit(max_groups + 1).collect()  # one job, bounded
    if len(rows) > max_groups:
        raise ValueError(f"more than {max_groups} groups")
    return sorted(r[0] for r in rows)


def set_differences(df: DataFrame, group_col: str, item_col: str, groups: list | None = None) -> DataFrame:
    """(group_a, group_b, item) for every item present in a and
    absent from b.  Each item carries the set of groups holding it (at most
    the number of groups), so pairs are formed per item, never across all
    rows of a group."""
    groups = groups if groups is not None else group_names(df, group_col)
    allg = F.array(*[F.lit(g) for g in groups])
    per_item = df.select(item_col, group_col).distinct().groupBy(item_col).agg(F.collect_set(group_col).alias("__s"))
    a = per_item.select(item_col, "__s", F.explode("__s").alias("group_a"))
    b = a.select(item_col, "group_a", F.explode(F.array_except(allg, F.col("__s"))).alias("group_b"))
    return b.select("group_a", "group_b", item_col)


def pair_difference_counts(df: DataFrame, group_col: str, item_col: str) -> DataFrame:
    """|items(a) minus items(b)| for every ordered pair of groups,
    zeros included."""
    groups = group_names(df, group_col)
    spark = df.sparkSession
    pairs = spark.createDataFrame([(a, b) for a in groups for b in groups if a != b], "group_a string, group_b string")
    diffs = set_differences(df, group_col, item_col, groups).groupBy("group_a", "group_b").agg(
        F.count(F.lit(1)).alias("n_only_a"))
    return pairs.join(diffs, ["group_a", "group_b"], "left").select(
        "group_a", "group_b", F.coalesce("n_only_a", F.lit(0)).cast("long").alias("n_only_a"))
