"""Registered queries of the operators in this package: each applies its
operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, bpe, decontam, minhash, pii, prefix_trie, pstable, quality, repeats, sharding, token_cache, toxicity, warc
from tessera.llm.common import read_table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        LLM_QUERIES[name] = f
        if oracle:
            LLM_ORACLES[name] = oracle
        return f
    return keep


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; $TOKENIZER_DIR overrides the package's."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def digests() -> list:
    """n_tokens, ids_sha256 and decoded_sha256 from the columns ids and decoded."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256")]


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encoded and decoded texts as digests."""
    return bpe.encode_and_decode(docs, path, cache=100_000).select("doc_id", *digests())


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """BPE encoding and decoding of every whole text of documents."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return encoded_digests(docs, tokenizer_path("word_bpe_49k.json"))


# DuckDB compares every pair in double precision; a component is named by the
# smallest id that repeated hops over links reach.
_VECTORS_ORACLE = """
WITH RECURSIVE u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
          WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(low.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


@query("op2_pstable", oracle=_VECTORS_ORACLE)
def op2_pstable(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate classes and link counts of all embeddings at cosine 0.9."""
    return pstable.near_vectors(read_table(spark, sf, "embeddings"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every whole text of documents, learnt outside the held-out fold."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf, "labels"))
    return toxicity.score(docs, model)


@query("op4_quality")
def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every whole document from its text and its site."""
    return quality.quality_scores(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


#: The library takes the key as an argument; a real one is kept secret.
SURROGATE_KEY = "public demonstration key"


@query("op5_pii")
def op5_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents with personal data replaced by keyed surrogates."""
    return pii.pseudonymise(read_table(spark, sf, "documents").select("doc_id", "text"), SURROGATE_KEY)


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items that each document repeats, parameters, case and marks aside."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return decontam.contamination(docs, read_table(spark, sf, "benchmark"), both=True)


@query("op7_minhash")
def op7_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate classes of documents at similarity 0.75."""
    return minhash.near_duplicates(read_table(spark, sf, "documents"))


@query("op8_warc", oracle="""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS holder FROM p),
-- base32 of the 40 hex digits: eight groups of 5 hex digits, four letters each
b AS (SELECT *, list_reduce(list_transform(generate_series(0, 31), lambda k:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (((('0x' || hex[1 + (k // 4) * 5 : 5 + (k // 4) * 5])::BIGINT) >> (15 - 5 * (k % 4))) & 31)::INT]),
        lambda x, y: x || y) AS payload_digest FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to FROM b
""")
def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.archive_round_trip(read_table(spark, sf, "pages"))


def _sharding_oracle(shards: int = 40, slot_buckets: int = 64) -> str:
    tree = sharding.even_tree(shards)
    regions = tree.with_region(shards).regions
    hashed = "(('0x' || left(md5({}), 13))::BIGINT)"

    def draws(name, weights):
        return "[" + ", ".join("ln((" + hashed.format(f"'0/{name}.{i}/' || key") + f" + 1) / 4503599627370496.0) / {w!r}"
                               for i, w in enumerate(weights)) + "]"

    def won(name, weights):
        d = draws(name, weights)
        return f"list_position({d}, list_max({d})) - 1"
    weights = [float(sum(s[1] for c in r for s in c)) for r in regions]
    racks = "CASE region " + " ".join(
        f"WHEN {i} THEN {won(f'r.{i}', [float(sum(s[1] for s in c)) for c in r])}" for i, r in enumerate(tree.regions)) + " END"
    leaf = "CASE " + " ".join(
        f"WHEN region = {i} AND rack = {j} THEN {[s for s, _ in c]}[1 + {won(f'r.{i}.{j}', [w for _, w in c])}]"
        for i, r in enumerate(tree.regions) for j, c in enumerate(r)) + " END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
r AS (SELECT *, {won('r', weights[:-1])} AS region, {won('r', weights)} AS grown_region FROM d),
k AS (SELECT *, {racks} AS rack FROM r),
s AS (SELECT *, CAST({leaf} AS INTEGER) AS shard, {hashed.format("'slot/' || key")} % {slot_buckets} AS bucket FROM k)
SELECT doc_id, CAST(strlen(text) + 16 AS BIGINT) AS size, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id) - 1 AS slot,
       CAST(CASE WHEN grown_region = {len(regions) - 1} THEN {shards} ELSE shard END AS INTEGER) AS grown_shard FROM s
"""


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """All documents placed by the hierarchical weighted hash tree."""
    return sharding.shard_documents(read_table(spark, sf, "documents"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every whole document, distinct texts encoded once."""
    return token_cache.count_tokens(read_table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op11_prefix_trie")
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations with its subtree totals."""
    return prefix_trie.prefix_trie(read_table(spark, sf, "conversations"))


@query("op12_suffix_arrays")
def op12_suffix_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole document without the 50-byte strings that smaller ids hold."""
    return repeats.without_repeats(read_table(spark, sf, "documents"))


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of two tokenizers aligned over every whole document, with corpus counts of linked ids."""
    return alignment.alignment(read_table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
