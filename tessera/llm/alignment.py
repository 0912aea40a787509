"""Cross-tokenizer alignment by coalescing intervals.

Both tokenizers read the same bytes, so each token is an interval of byte
offsets.  All A and B tokens of a slice of documents are sorted by start; the
running maximum of their ends tells where a group ends: at the first start
that reaches it.  Inside a group every A token is expanded to the B tokens
that its bytes overlap.  That is one pass of array operations over whole
texts; it leaves, per document, the sizes, a digest of the groups and the
distinct linked id pairs with how often they occur.

How many documents hold a pair is a grouped sum, folded per task first.  The
counts then meet the documents' pairs by blocks of A ids: a block's counts
(bounded by the vocabularies) go ahead of the documents' pairs in one sorted
stream, and a block with many pairs is dealt over several streams, so nothing
is broadcast and no stream grows with the corpus.

Defined results: null and empty texts, and texts whose joined token bytes
differ from a blank plus the text for either tokenizer, have no tokens: zeros,
and the empty string instead of a digest.  Strings of special tokens inside a
text are plain text.  Rows are told apart by a key of their own, so null or
repeated ids keep their rows, each a document of its own in the counts; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import BYTE_LEVEL_PATTERN, byte_alphabet
from tessera.llm.common import materialize, slices, text_or_empty

BLOCKS = 16                    # of A ids
STREAM_BYTES = 64 << 20        # of pairs in one stream, about
FOLD = 1 << 20                 # distinct pairs that a task holds before it passes their counts on
CHUNK = 1 << 16                # counts in a row of a block's table
# The rank library's splitter overflows its stack on longer runs of blanks.
LONG_BLANKS = re.compile(r"\s{10000}")


class ByteLevel:
    """A byte-level BPE file.  Its merges are in the order of its ids, so the
    library for ranked tokens gives the same ids, faster (a test compares)."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, vocab = spec["pre_tokenizer"], spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if (spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel"
                or pre.get("add_prefix_space") or any(vocab[a + b] != 256 + n for n, (a, b) in enumerate(pairs))):
            raise ValueError(f"{path}: not a plain byte-level BPE file with ids in the order of its merges")
        known = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(known[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.path = path
        self.ranked = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = {i: b for b, i in ranks.items()}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._library(t) if len(t) > 10000 and LONG_BLANKS.search(t) else self.ranked.encode_ordinary(t)
                for t in (" " + t for t in texts)]

    def _library(self, text: str) -> list[int]:
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(self.path)
        t.encode_special_tokens = True
        return t.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece file, which adds the blank before a text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = ((i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))
        self.pieces = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in names}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """One tokenizer with its tokens' bytes, byte counts and decimal ids."""

    def __init__(self, path: str, ends: str):
        self.tokens = Pieces(path) if path.endswith(".model") else ByteLevel(path)
        self.size = max(self.tokens.pieces) + 1
        self.bytes = [self.tokens.pieces.get(i, b"") for i in range(self.size)]
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        #: decimal id and comma, and after these decimal id and what ends the side's part of a group
        self.words = np.array([f"{i}," for i in range(self.size)] + [f"{i}{ends}" for i in range(self.size)], dtype=object)

    def exact(self, ids: list[int], text: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == text


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[Side, Side]:
    """The two tokenizers, once for each Python worker."""
    return Side(a_path, "|"), Side(b_path, ";")


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0] + [len(x) for x in lists])
    return np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(ends[-1])), ends


def groups(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): intervals sorted by start (on equal starts as given) and
    the number of each one's group; a group ends where a start reaches the
    running maximum of the ends."""
    order = np.lexsort((np.arange(len(starts)), starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.zeros(len(starts), dtype=np.int64)
    np.cumsum(starts[order][1:] >= reach[:-1], out=group[1:])
    return order, group


def overlaps(a_start, a_end, b_start, b_end) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and B tokens of each overlapping pair, by A; B tokens
    follow one another."""
    first = np.searchsorted(b_end, a_start, "right")
    n = np.searchsorted(b_start, a_end, "left") - first
    a = np.repeat(np.arange(len(n)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Aligned:
    """The tokens, groups and links of a list of texts."""

    def __init__(self, a: Side, b: Side, texts: list[str]):
        self.a, self.b, n = a, b, len(texts)
        raw = [b" " + t.encode() for t in texts]
        ids = [list(x) for x in zip(*(pair if t and a.exact(pair[0], r) and b.exact(pair[1], r) else ([], [])
                                      for t, r, *pair in zip(texts, raw, a.tokens.encode(texts), b.tokens.encode(texts))))]
        self.a_ids, self.a_ends = _flat(ids[0])
        self.b_ids, self.b_ends = _flat(ids[1])
        a_end, b_end = np.cumsum(a.lengths[self.a_ids]), np.cumsum(b.lengths[self.b_ids])
        a_start, b_start = a_end - a.lengths[self.a_ids], b_end - b.lengths[self.b_ids]
        self.a_doc = np.repeat(np.arange(n), np.diff(self.a_ends))
        self.order, self.group = groups(np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]))
        doc = np.concatenate([self.a_doc, np.repeat(np.arange(n), np.diff(self.b_ends))])[self.order]
        opens = np.diff(self.group, prepend=-1) > 0
        self.n_groups = np.bincount(doc[opens], minlength=n)
        self.a_link, self.b_link = overlaps(a_start, a_end, b_start, b_end)
        self.n_links = np.bincount(self.a_doc[self.a_link], minlength=n)
        self.doc, self.n = doc, n

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups; empty without tokens."""
        b_side = self.order >= len(self.a_ids)
        by = np.lexsort((b_side, self.group))                # A before B inside a group
        side, group, token = b_side[by], self.group[by], self.order[by]
        last = np.ones(len(by), dtype=bool)
        last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
        words = np.empty(len(by), dtype=object)
        words[~side] = self.a.words[self.a_ids[token[~side]] + last[~side] * self.a.size]
        words[side] = self.b.words[self.b_ids[token[side] - len(self.a_ids)] + last[side] * self.b.size]
        words, cut = words.tolist(), np.searchsorted(self.doc, np.arange(self.n + 1)).tolist()
        return [hashlib.sha256("".join(words[s:e])[:-1].encode()).hexdigest() if e > s else "" for s, e in zip(cut, cut[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (document, pair) in order, the pair as a number, and how
        many links of the document are of that pair."""
        space = self.a.size * self.b.size
        key = self.a_doc[self.a_link] * space + self.a_ids[self.a_link] * self.b.size + self.b_ids[self.b_link]
        key, n = np.unique(key, return_counts=True)
        return key // space, key % space, n


#: One row of a document's pairs: the pair's number and its links, at most 255; further rows hold the rest.
PAIR = np.dtype([("pair", "<u8"), ("n", "u1")])
PAIR_32 = np.dtype([("pair", "<u4"), ("n", "u1")])
#: One row of a block's table: a pair's number, its count, and whether it is its A id's best.
TABLE = np.dtype([("pair", "<i8"), ("n", "<i8"), ("best", "u1")])


def pair_type(space: int) -> np.dtype:
    return PAIR_32 if space <= 1 << 32 else PAIR


def _packed(aligned: Aligned, blocks: int) -> pa.Array:
    """For each document a list of a packed array of pairs for each block."""
    doc, pair, n = aligned.pairs()
    parts = -(-n // 255)
    row = np.empty(int(parts.sum()), dtype=pair_type(aligned.a.size * aligned.b.size))
    row["pair"] = np.repeat(pair, parts)
    row["n"] = np.where(np.append(np.diff(np.repeat(np.arange(len(n)), parts)) > 0, True), np.repeat(n - 255 * (parts - 1), parts), 255) if len(n) else 0
    place = np.repeat(doc, parts) * blocks + np.repeat(pair // aligned.b.size % blocks, parts)
    by = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[by], np.arange(aligned.n * blocks + 1)) * row.dtype.itemsize
    values = pa.Array.from_buffers(pa.binary(), aligned.n * blocks,
                                   [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(row[by].tobytes())])
    return pa.ListArray.from_arrays(pa.array(np.arange(aligned.n + 1) * blocks, pa.int32()), values)


ALIGNED = "__row long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<binary>"


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: __row (a key), doc_id, n_a, n_b, n_groups,
    n_links, groups_sha256 and pairs, the document's distinct pairs by block."""
    blocks = BLOCKS

    def run(batches):
        both = sides(a_path, b_path)
        for batch in batches:
            for part in slices(batch):
                x = Aligned(*both, part.column("text").to_pylist())
                long = lambda v: pa.array(v, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("__row"), part.column("doc_id"), long(np.diff(x.a_ends)), long(np.diff(x.b_ends)),
                     long(x.n_groups), long(x.n_links), pa.array(x.digests(), pa.string()), _packed(x, blocks)],
                    ["__row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])
    rows = df.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, ALIGNED.format(id=rows.schema["doc_id"].dataType.simpleString()))


def _unpack(column, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a column of packed pairs end to end, and where each value's start."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=dtype), np.cumsum([0] + [len(v) // dtype.itemsize for v in values])


def pair_counts(aligned: DataFrame, a_size: int, b_size: int) -> DataFrame:
    """(a, pair, n, best): documents that hold each pair linked, and whether
    no pair of the same A id is held by more."""
    dtype = pair_type(a_size * b_size)

    def run(batches):
        held = (np.empty(0, dtype=np.int64),) * 2

        def out(pairs, n):
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
        for batch in batches:
            rows, ends = _unpack(batch.column("pairs").flatten(), dtype)
            pair = rows["pair"].astype(np.int64)
            once = np.ones(len(pair), dtype=bool)            # a pair's further rows follow its first
            once[1:] = pair[1:] != pair[:-1]
            once[ends[:-1][ends[:-1] < len(pair)]] = True
            pairs, n = np.unique(pair[once], return_counts=True)
            merged, place = np.unique(np.concatenate([held[0], pairs]), return_inverse=True)
            held = merged, np.bincount(place, weights=np.concatenate([held[1], n]), minlength=len(merged)).astype(np.int64)
            if len(merged) > FOLD:
                yield out(*held)
                held = (np.empty(0, dtype=np.int64),) * 2
        yield out(*held)
    counts = aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    a = F.floor(F.col("pair") / F.lit(b_size)).cast("long")
    most = F.max("n").over(Window.partitionBy("a"))          # as many rows as there are B ids, at most
    return counts.withColumn("a", a).select("a", "pair", "n", (F.col("n") == most).alias("best"))


def _tables(counts: DataFrame) -> DataFrame:
    """(block, table): the counts of a block in packed chunks."""
    def run(batches):
        for batch in batches:
            block = batch.column("block").to_numpy()
            row = np.empty(len(block), dtype=TABLE)
            for name in ("pair", "n"):
                row[name] = batch.column(name).to_numpy()
            row["best"] = batch.column("best").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            cuts = sorted({*cuts.tolist(), *range(0, len(block), CHUNK), len(block)})
            yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array([row[s:e].tobytes() for s, e in zip(cuts, cuts[1:])], pa.binary())],
                                             ["block", "table"])
    rows = counts.select(F.pmod("a", F.lit(BLOCKS)).cast("int").alias("block"), "pair", "n", "best")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, table binary")


def pair_sums(aligned: DataFrame, counts: DataFrame, a_size: int, b_size: int) -> DataFrame:
    """(__row, n_best, count_sum) of every row with links."""
    dtype = pair_type(a_size * b_size)
    pairs = aligned.select("__row", F.posexplode("pairs").alias("block", "packed")).filter("octet_length(packed) > 0")
    total = pairs.agg(F.sum(F.octet_length("packed").cast("long"))).first()[0] or 0
    streams = -(-total // (BLOCKS * STREAM_BYTES)) or 1
    stream = F.pmod(F.xxhash64("__row"), F.lit(streams))
    tables = _tables(counts).select("block", F.explode(F.sequence(F.lit(0), F.lit(streams - 1).cast("long"))).alias("stream"), F.lit(0).alias("turn"),
                                    F.lit(None).cast("long").alias("__row"), F.col("table").alias("packed"))
    docs = pairs.select("block", stream.alias("stream"), F.lit(1).alias("turn"), "__row", "packed")
    both = tables.unionByName(docs).repartition("block", "stream").sortWithinPartitions("block", "stream", "turn")

    def run(batches):
        key, parts, table = None, [], None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("block", "stream", "turn")]
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                at = int(cols[0][s]), int(cols[1][s])
                if at != key:
                    key, parts, table = at, [], None
                if not cols[2][s]:
                    parts += part.column("packed").to_pylist()
                    continue
                if table is None:
                    table = np.frombuffer(b"".join(parts), dtype=TABLE)
                    table, parts = table[np.argsort(table["pair"])], []
                for few in slices(part, 4096):
                    rows, ends = _unpack(few.column("packed"), dtype)
                    found = table[np.searchsorted(table["pair"], rows["pair"].astype(np.int64))]
                    n = rows["n"].astype(np.int64)
                    sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[ends]) for v in (n * found["best"], n * found["n"])]
                    yield pa.RecordBatch.from_arrays([few.column("__row"), *map(pa.array, sums)], ["__row", "n_best", "count_sum"])
    return (both.mapInArrow(run, "__row long, n_best long, count_sum long")
            .groupBy("__row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))


def alignment(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum and groups_sha256."""
    a, b = sides(a_path, b_path)
    aligned = materialize(align(df, a_path, b_path, id_col, text_col), "aligned")
    counts = materialize(pair_counts(aligned, a.size, b.size), "pair-counts")
    sums = pair_sums(aligned, counts, a.size, b.size)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return (aligned.drop("pairs").join(sums, "__row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"))
