"""Vocabulary, ids and encoding queries (A1, A1', W1, W2, J3, T13, T17, W7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import vocab as vb
from tessera.operators.splits import split_80_10_10
from tessera.plans import views as V
from tessera.plans.catalog import register
from tessera.session import materialize


@register("voc_build", "SELECT DISTINCT lang, unnest(toks) AS word FROM tokens", ["tokens"])
def voc_build(spark, sf):
    """A1: distinct words per language (sorted ids come with voc_index)."""
    return V.tokens(spark, sf).select("lang", F.explode("toks").alias("word")).distinct()


@register("voc_index", """
WITH w AS (SELECT DISTINCT lang, unnest(toks) AS word FROM tokens)
SELECT lang, word, CAST(row_number() OVER (PARTITION BY lang ORDER BY word) + 1 AS BIGINT) AS idx FROM w
UNION ALL SELECT DISTINCT lang, '<pad>' AS word, CAST(0 AS BIGINT) AS idx FROM w
UNION ALL SELECT DISTINCT lang, '<unk>' AS word, CAST(1 AS BIGINT) AS idx FROM w
""", ["tokens"])
def voc_index(spark, sf):
    """Dense ids per language after the reserved <pad>=0, <unk>=1."""
    return vb.vocab_per_group(V.tokens(spark, sf), "lang", "toks")


@register("voc_multilang", """
WITH w AS (SELECT DISTINCT lang, unnest(toks) AS word FROM tokens)
SELECT lang, word, CAST(row_number() OVER (ORDER BY lang, word) + 1 AS BIGINT) AS idx FROM w
UNION ALL SELECT NULL AS lang, '<pad>' AS word, CAST(0 AS BIGINT) AS idx
UNION ALL SELECT NULL AS lang, '<unk>' AS word, CAST(1 AS BIGINT) AS idx
""", ["tokens"])
def voc_multilang(spark, sf):
    """Combined vocabulary, prefix then a block for each language of the
    data with running offsets."""
    return vb.multilingual_vocab(V.tokens(spark, sf), "lang", toks_col="toks")


_SPLIT_SQL = """
WITH base AS (SELECT doc_id AS id, md5('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
m AS (SELECT count(*) AS m FROM base),
r AS (SELECT id, row_number() OVER (ORDER BY h, id) - 1 AS pos FROM base),
split AS (SELECT r.id, CASE WHEN pos < floor(m.m * 0.8::DOUBLE) THEN 'train'
          WHEN pos < floor(m.m * 0.8::DOUBLE) + floor(m.m * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split
          FROM r, m)
"""


@register("voc_by_split", _SPLIT_SQL + """
, w AS (SELECT DISTINCT t.lang, unnest(t.toks) AS word, s.split FROM tokens t JOIN split s USING (id))
SELECT lang, word, bool_or(split = 'train') AS in_train, bool_or(split = 'val') AS in_val,
       bool_or(split = 'test') AS in_test FROM w GROUP BY lang, word
""", ["tokens"])
def voc_by_split(spark, sf):
    """A1': per-split vocabularies combined, with membership flags."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"))
    s = split_80_10_10(docs, "id", seed=1)
    w = (V.tokens(spark, sf).join(s, "id")
         .select("lang", F.explode("toks").alias("word"), "split").distinct())
    return w.groupBy("lang", "word").agg(
        F.bool_or(F.col("split") == "train").alias("in_train"),
        F.bool_or(F.col("split") == "val").alias("in_val"),
        F.bool_or(F.col("split") == "test").alias("in_test"))


# Each language has the vocabulary of its training articles, so <unk> occurs.
_ENC_SQL = _SPLIT_SQL + """
, v AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY word) + 1 AS idx FROM
        (SELECT DISTINCT t.lang, unnest(t.toks) AS word FROM tokens t JOIN split s USING (id) WHERE s.split = 'train')),
p AS (SELECT t.id, t.lang, u.word, u.pos FROM tokens t,
      LATERAL (SELECT unnest(t.toks) AS word, generate_subscripts(t.toks, 1) AS pos) u),
enc AS (SELECT p.id, p.lang, list(CAST(coalesce(v.idx, 1) AS BIGINT) ORDER BY p.pos) AS ids
        FROM p LEFT JOIN v ON p.lang = v.lang AND p.word = v.word GROUP BY p.id, p.lang
        UNION ALL SELECT id, lang, []::BIGINT[] AS ids FROM tokens WHERE len(toks) = 0)
"""


def train_tokens(spark, sf):
    """Token rows of the articles in the train split.  Tokens have the rows of
    documents, so they are split where they are, without a join."""
    t = V.tokens(spark, sf)
    return split_80_10_10(t, "id", seed=1).filter((F.col("split") == "train") & F.col("id").isNotNull()).select(*t.columns)


def train_vocab(spark, sf):
    """(lang, word, idx) of the train split, <pad>=0 and <unk>=1 in every language."""
    return V._shared(spark, "train_vocab", sf, lambda: vb.vocab_per_group(train_tokens(spark, sf), "lang", "toks"))


def _encoded(spark, sf):
    t, vocab = V.tokens(spark, sf), train_vocab(spark, sf)
    # normalised tokens never equal the reserved <pad>/<unk>, so every word is unique
    return t, vocab, vb.encode_ids(t, vocab, "id", "toks", "ids", unk_id=1, unique_words=True, by=["lang"],
                                   frequent=V.frequent_words(spark, sf))


@register("enc_token_ids", _ENC_SQL + "SELECT id, lang, ids FROM enc", ["tokens"])
def enc_token_ids(spark, sf):
    """Every document encoded with its language's vocabulary of the
    train split (<pad>=0, <unk>=1)."""
    return _encoded(spark, sf)[2]


@register("enc_truncate", "SELECT id, toks[1:500] AS toks FROM tokens", ["tokens"])
def enc_truncate(spark, sf):
    """Keep the first 500 tokens."""
    from tessera.functions.text import truncate_tokens
    return V.tokens(spark, sf).select("id", truncate_tokens("toks", 500).alias("toks"))


@register("enc_decode", _ENC_SQL + """
, ids AS (SELECT e.id, e.lang, u.i, u.pos FROM enc e, LATERAL (SELECT unnest(e.ids) AS i, generate_subscripts(e.ids, 1) AS pos) u),
names AS (SELECT DISTINCT lang, '<pad>' AS word, 0 AS idx FROM v UNION ALL SELECT DISTINCT lang, '<unk>', 1 FROM v
          UNION ALL SELECT lang, word, idx FROM v)
SELECT ids.id, ids.lang, array_to_string(list(n.word ORDER BY ids.pos), ' ') AS text
FROM ids JOIN names n ON ids.lang = n.lang AND ids.i = n.idx WHERE ids.i <> 0 GROUP BY ids.id, ids.lang
UNION ALL SELECT id, lang, '' AS text FROM enc WHERE len(list_filter(ids, lambda i: i <> 0)) = 0
""", ["tokens"])
def enc_decode(spark, sf):
    """Ids back to text, pad id skipped."""
    _, vocab, enc = _encoded(spark, sf)
    return vb.decode_ids(materialize(enc, "encoded"), vocab, "id", "ids", "text", pad_id=0, by=["lang"])


@register("enc_pad_batches", _ENC_SQL + """
, b AS (SELECT id, ids, row_number() OVER (ORDER BY id) - 1 AS position FROM enc),
bb AS (SELECT *, CAST(floor(position / 32) AS BIGINT) AS batch FROM b),
mx AS (SELECT batch, max(len(ids)) AS m FROM bb GROUP BY batch)
SELECT bb.id, bb.batch, bb.position,
       list_concat(bb.ids, CAST(list_transform(range(mx.m - len(bb.ids)), lambda x: 0) AS BIGINT[])) AS ids
FROM bb JOIN mx USING (batch)
""", ["tokens"])
def enc_pad_batches(spark, sf):
    """Batches of 32 in id order, every list padded with 0 to the
    longest list of its batch."""
    enc = _encoded(spark, sf)[2]
    return vb.pad_batches(enc, "id", ["ids"], 32, pad_id=0).select("id", "batch", "position", "ids")
