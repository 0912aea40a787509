"""Split, alignment-split and mix queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tessera.operators import rows as rw
from tessera.operators import splits as sp
from tessera.plans import views as V
from tessera.plans.catalog import register
from tessera.plans.q_vocab import _SPLIT_SQL
from tessera.session import read_table

# Sizes for the nested key split at test scale (the reference used
# 30,000 / 10,000 / 1,000 on 33,528 keys).
NESTED = dict(train_size=90, sub_size=30, val_size=20, seed=57)


@register("split_80_10_10", _SPLIT_SQL + "SELECT id, split FROM split")
def split_80_10_10(spark, sf):
    """Exact 80/10/10 split of all documents by seeded hash order."""
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return sp.split_80_10_10(d, "id", seed=1)


def _nested_sql():
    s = NESTED["seed"]
    return f"""
WITH n AS (SELECT count(DISTINCT part) AS n FROM aligned),
k AS (SELECT key FROM aligned GROUP BY key HAVING count(DISTINCT part) = (SELECT n FROM n)),
r1 AS (SELECT key, row_number() OVER (ORDER BY md5('{s}:' || CAST(key AS VARCHAR)), key) - 1 AS r FROM k),
members AS (SELECT key, 'monolingual_train' AS split FROM r1 WHERE r < {NESTED['train_size']}
  UNION ALL SELECT key, 'multilingual_train' FROM r1 WHERE r < {NESTED['sub_size']}
  UNION ALL SELECT key, 'val' FROM r1 WHERE r >= {NESTED['train_size']} AND r < {NESTED['train_size'] + NESTED['val_size']}
  UNION ALL SELECT key, 'test' FROM r1 WHERE r >= {NESTED['train_size'] + NESTED['val_size']})
"""


def _members(spark, sf):
    a = V.aligned(spark, sf)
    keys = rw.common_keys(a, "key", "part")
    return a, sp.split_nested(keys, "key", **NESTED)


@register("split_nested", _nested_sql() + "SELECT key, split FROM members", ["aligned"])
def split_nested(spark, sf):
    """Exact-size nested split of the keys common to all parts."""
    return _members(spark, sf)[1]


@register("split_apply", _nested_sql() + """
SELECT a.key, a.part, a.row_id, m.split FROM aligned a JOIN members m USING (key)
""", ["aligned"])
def split_apply(spark, sf):
    """The one key split applied to every part."""
    a, m = _members(spark, sf)
    return sp.apply_split(a, m, "key").select("key", "part", "row_id", "split")


@register("split_leak_check", _nested_sql() + """
SELECT x.split AS split_a, y.split AS split_b, count(*) AS n_common
FROM members x JOIN members y ON x.key = y.key AND x.split <> y.split GROUP BY 1, 2
""", ["aligned"])
def split_leak_check(spark, sf):
    """Keys shared by each ordered pair of splits (only the nested
    train subset may overlap train)."""
    return sp.split_overlaps(_members(spark, sf)[1], "key")


def language_mixes(langs) -> dict:
    """Every language alone, every pair, and all together."""
    langs = sorted(langs)
    return ({x: [x] for x in langs} | {f"{a}_{b}": [a, b] for a, b in combinations(langs, 2)} | {"all": langs})


# The same mixes in SQL, from the languages of the data.
MIX_SQL = """
ln AS (SELECT DISTINCT lang FROM documents),
mx AS (SELECT lang AS mix, lang FROM ln UNION ALL SELECT 'all', lang FROM ln
  UNION ALL SELECT a.lang || '_' || b.lang, unnest([a.lang, b.lang]) FROM ln a JOIN ln b ON a.lang < b.lang)
"""


def _mix_sql():
    return f"""
WITH {MIX_SQL},
r AS (SELECT mx.mix, d.doc_id AS id, d.lang, md5('57:' || mx.mix || ':' || CAST(d.doc_id AS VARCHAR)) AS h
      FROM documents d JOIN mx ON d.lang = mx.lang)
SELECT mix, id, lang, row_number() OVER (PARTITION BY mix ORDER BY h, id) - 1 AS position FROM r
"""


@register("mix_build", _mix_sql())
def mix_build(spark, sf):
    """U4 + X4: single-language and mixed-language sets, each shuffled by a
    seeded hash (position = place in the shuffled mix)."""
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    langs = [r[0] for r in d.select("lang").distinct().collect()]        # languages, not documents
    return sp.build_mixes(d, "lang", "id", language_mixes(langs), seed=57).select("mix", "id", "lang", "position")


FIXED_SAMPLE = dict(train_size=600, sub_size=0, val_size=100, seed=57)


@register("split_fixed_sample", f"""
WITH k AS (SELECT doc_id AS id FROM documents),
r1 AS (SELECT id, row_number() OVER (ORDER BY md5('57:' || CAST(id AS VARCHAR)), id) - 1 AS r FROM k)
SELECT id, 'train' AS split FROM r1 WHERE r < {FIXED_SAMPLE['train_size']}
UNION ALL SELECT id, 'val' FROM r1 WHERE r >= {FIXED_SAMPLE['train_size']} AND r < {FIXED_SAMPLE['train_size'] + FIXED_SAMPLE['val_size']}
""")
def split_fixed_sample(spark, sf):
    """Fixed-size train and validation samples of the documents, the
    remainder dropped."""
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    m = sp.split_nested(d, "id", names=("train", "unused", "val", "test"), keep_rest=False, **FIXED_SAMPLE)
    return m.filter(F.col("split") != "unused")


@register("rep_split_sizes", _nested_sql() + """
SELECT a.part, m.split, count(*) AS n FROM aligned a JOIN members m USING (key) GROUP BY a.part, m.split
""", ["aligned"])
def rep_split_sizes(spark, sf):
    """Rows per part and split after the key split is applied to every
    part (the reference's printed split sizes)."""
    a, m = _members(spark, sf)
    return sp.apply_split(a, m, "key").groupBy("part", "split").agg(F.count(F.lit(1)).alias("n"))
