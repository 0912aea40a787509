"""BPE against the tokenizers library, and the digest cache."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tessera.llm import bpe, token_cache
from tessera.llm.queries import encoded_digests, tokenizer_path

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["", " ", "\n\n x", "<|endoftext|>", "a<|startoftext|> b <|endoftext|><|endoftext|>", "ΑΣ ΣΑΣ", "İstanbul ǅ",
       "日本語 テスト １２３ ½", "éạ ​ x\x85y\x1cz", "😀👍🏽 family", "a" * 3000, "thethethe" * 200, "!!!???...///" * 9,
       "don't we'll I'm 'S", "ﬁn ß ẞ", "нет ёж", "नदी और २", "x" * 40_000]


def texts():
    rnd = random.Random(5)
    out = list(ODD)
    for _ in range(1500):
        out.append("".join(rnd.choice("abcdeftheingion '!?.,1290éñßüΣ\n\t  中<|>") for _ in range(rnd.randint(1, 60))))
    for _ in range(300):
        out.append("".join(chr(rnd.choice([rnd.randint(0, 0x557), rnd.randint(0x20, 0x7e), rnd.randint(0x558, 0xd7ff)]))
                           for _ in range(rnd.randint(1, 30))))
    return out


@pytest.mark.parametrize("name", FILES)
def test_ids_counts_and_decoding_equal_the_library(name):
    own, lib = bpe.tokenizer(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    for t in texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, repr(t)
        assert own.count(t) == len(ids)
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", FILES)
def test_every_code_point_is_split_alike_below_the_plain_limit(name):
    own, lib = bpe.tokenizer(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    for cp in range(bpe.PLAIN_LIMIT):
        t = f"a{chr(cp)}1{chr(cp)}{chr(cp)} {chr(cp)}  {chr(cp)}"
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids, hex(cp)


def test_one_token_at_most_is_last_for_a_prefix():
    own = bpe.tokenizer(tokenizer_path(FILES[0]))
    word = own._symbols("internationalisation")
    last = {}
    for end, (token, size) in own.trie.iter(word):
        start = end - size
        if start < 0 or (start in last and own.compatible(last[start], token)):
            assert end not in last
            last[end] = token
    assert len(last) == len(word)


def test_operator_rows_nulls_and_clashing_columns(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())])
    rows = [(1, "Hello hello", "x", "y"), (1, "Hello hello", "x", "y"), (None, None, None, None), (3, "", "", "")]
    path = tokenizer_path(FILES[0])
    df = spark.createDataFrame(rows, schema)
    out = bpe.decode(bpe.encode(df, path), path)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted((r.doc_id or 0, list(r.ids), r.decoded) for r in out.collect())
    lib = Tokenizer.from_file(path)
    hello = lib.encode("Hello hello", add_special_tokens=False).ids
    assert got == [(0, [], ""), (1, hello, lib.decode(hello)), (1, hello, lib.decode(hello)), (3, [], "")]
    both = bpe.encode_and_decode(df, path)
    assert both.columns == out.columns and sorted((r.doc_id or 0, list(r.ids), r.decoded) for r in both.collect()) == got
    assert bpe.encode(df.limit(0), path).count() == 0
    d = {r.doc_id: r for r in encoded_digests(df, path).collect()}
    assert d[1].n_tokens == len(hello) and d[1].ids_sha256 == hashlib.sha256(" ".join(map(str, hello)).encode()).hexdigest()
    assert d[3].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_cache_encodes_only_new_distinct_texts(spark, tmp_path):
    path, folder = tokenizer_path(FILES[1]), str(tmp_path / "cache")
    schema = "doc_id long, text string, n_tokens string, digest string"
    first = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(["a b", "a b", "", "c" * 9000, None])], schema)
    lib = Tokenizer.from_file(path)
    want = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    got = {r.doc_id: r for r in token_cache.count_tokens(first, path, cache_dir=folder).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {0: want("a b"), 1: want("a b"), 2: 0, 3: want("c" * 9000), 4: 0}
    assert got[3].over_limit and not got[0].over_limit and got[3].n_bytes == 9000 and got[4].n_bytes == 0
    stored = f"{folder}/{token_cache.tokenizer_version(path)}"
    assert spark.read.parquet(stored).count() == 3
    again = first.union(spark.createDataFrame([(9, "new text", "", "")], schema))
    assert {r.doc_id: r.n_tokens for r in token_cache.count_tokens(again, path, cache_dir=folder).collect()}[9] == want("new text")
    assert spark.read.parquet(stored).count() == 4
    assert token_cache.count_tokens(first.limit(0), path, cache_dir=folder).count() == 0


def test_hot_text_arrives_once_from_each_task(spark, tmp_path):
    path, folder = tokenizer_path(FILES[1]), str(tmp_path / "hot")
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    out = token_cache.count_tokens(df, path, cache_dir=folder)
    assert out.count() == 3000 and out.filter("n_tokens is null").count() == 0
    assert spark.read.parquet(f"{folder}/{token_cache.tokenizer_version(path)}").count() == 2001
