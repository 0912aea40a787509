"""Alignment against a byte-by-byte brute force with the libraries' own tokens."""

import hashlib
from collections import Counter

import pytest

from tessera.llm import alignment
from tessera.llm.common import read_table
from tessera.llm.queries import LLM_QUERIES, tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))


def brute(texts, libraries):
    from tokenizers.pre_tokenizers import ByteLevel
    a, b = libraries
    # the printable character of each byte, as the library shows it
    shown = {ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(i))[0][0]: i for i in range(128)}
    shown |= {c: i for i, c in enumerate(alignment.byte_alphabet())}
    docs = []
    for t in texts:
        raw = (" " + (t or "")).encode()
        ai = a.encode(" " + t, add_special_tokens=False).ids if t else []
        bi = b.encode(t) if t else []
        ab = [bytes(shown[c] for c in a.id_to_token(i)) for i in ai]
        bb = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in bi]
        if b"".join(ab) != raw or b"".join(bb) != raw:
            ai = bi = ab = bb = []
        owner = [[k for k, p in enumerate(x) for _ in p] for x in (ab, bb)]
        links = sorted({(x, y) for x, y in zip(*owner)})
        ends = [{sum(map(len, x[:k + 1])) for k in range(len(x))} for x in (ab, bb)]
        out, ga, gb, at = [], [], [], 0
        both = sorted(ends[0] & ends[1])
        for cut in both:
            ga = list(dict.fromkeys(owner[0][at:cut]))
            gb = list(dict.fromkeys(owner[1][at:cut]))
            out.append(",".join(str(ai[k]) for k in ga) + "|" + ",".join(str(bi[k]) for k in gb))
            at = cut
        docs.append((ai, bi, len(both), [(ai[x], bi[y]) for x, y in links],
                     hashlib.sha256(";".join(out).encode()).hexdigest() if ai else ""))
    held = Counter(p for d in docs for p in set(d[3]))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return [(len(d[0]), len(d[1]), d[2], len(d[3]), sum(held[p] == best[p[0]] for p in d[3]), sum(held[p] for p in d[3]), d[4]) for d in docs]


HARD = ["", None, "plain text", "a", " ", "  two  blanks", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ low line", "café é 中文 \U0001f600 \U0001f468‍\U0001f469",
        "tab\tand\nnew line", "　wide blank", "it's I'll 12345 !!! ...", "ab " * 700, "x" * 3000, "\u0000null", "plain text", "ÿtþý"]


def columns(df):
    return df.select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("limits", [None, (3, 200, 4, 5)])
def test_equals_brute_force(spark, monkeypatch, libraries, limits):
    if limits:                                         # many blocks, streams, folds and chunks
        for name, value in zip(("BLOCKS", "STREAM_BYTES", "FOLD", "CHUNK"), limits):
            monkeypatch.setattr(alignment, name, value)
    df = spark.createDataFrame([(i // 2 if i < 6 else None if i < 8 else i, t, 1, "x") for i, t in enumerate(HARD)],
                               "doc_id long, text string, __row int, pairs string").repartition(3)
    rows = [r.text for r in df.collect()]
    got = alignment.alignment(df, tokenizer_path(A), tokenizer_path(B))
    assert sorted(map(tuple, columns(got).collect())) == sorted(brute(rows, libraries))
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, (r.doc_id for r in df.collect())))


def test_whole_table_equals_brute_force(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = read_table(spark, sf, "documents").select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in rows), brute([r.text for r in rows], libraries)))
    got = LLM_QUERIES["op13_alignment"](spark, sf)
    assert {r.doc_id: tuple(r)[1:] for r in got.select("doc_id", *columns(got).columns).collect()} == want


def test_long_blanks_and_empty_table(spark, libraries):
    text = "a" + " " * 1_200_000 + "b\n" + "\n" * 20_000
    side = alignment.ByteLevel(tokenizer_path(A))
    assert side.encode([text, "x"]) == [libraries[0].encode(" " + t, add_special_tokens=False).ids for t in (text, "x")]
    none = spark.createDataFrame([], "doc_id string, text string")
    assert alignment.alignment(none, tokenizer_path(A), tokenizer_path(B)).collect() == []


def test_ranked_ids_equal_the_library(libraries):
    import random
    rnd = random.Random(5)
    parts = ["a", " ", "  ", "\n", "\t", " ", "　", "é", "é", "中", "\U0001f600", "'s", "'S", "1", "٣", "<|endoftext|>", "\x85", "\x1c", "_", "​", "I'll", "x" * 30]
    side = alignment.ByteLevel(tokenizer_path(A))
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    assert side.encode(texts) == [libraries[0].encode(" " + t, add_special_tokens=False).ids for t in texts]
