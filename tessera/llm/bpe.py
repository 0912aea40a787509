"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece there is one token with which its encoding ends.
It is found without replaying merges: an automaton over the vocabulary (trie
plus suffix links) lists the tokens that end at each position, and a token is
the last one of the prefix exactly when it is compatible with the last token
of the prefix before it, i.e. when no merge would have joined the border
between the two earlier.  Following the stored tokens back from the end gives
the ids.  The cost is linear in the piece, whatever its length.

Tokenizer files are read inside the tasks from a path (a parameter); pieces
that repeat are served from a cache of bounded size.  Encoding and decoding
are single passes over the rows with no shuffle; a lost task is simply run
again.

Null texts encode like empty ones (no ids); null id lists decode to the empty
text; ids outside the vocabulary are skipped, as the library does; empty
tables give empty tables; a column that already has the name of an output
column is replaced.
"""

from __future__ import annotations

import json
import struct
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import drop_columns, slices

NEVER = 1 << 62
# Fixed value: the piece pattern of byte-level tokenizers that name none.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Below this code point the pattern library and the tokenizers library class
# and fold every character alike (a test compares them); texts with others go
# through the library's own normaliser and splitter, then the same encoder.
PLAIN_LIMIT = 0x558
FINAL = 0x10000       # added to a piece's last character when words have an end mark


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def pre_splits_at_space(pattern: str) -> bool:
    """Whether no piece of a pattern holds white space; a blank in one of its
    alternatives, or a class of white space, says that it may."""
    return " " not in pattern and r"\s+" not in pattern


class PieceCache(dict):
    """piece -> value, made on a miss.  Two generations of at most ``limit``
    entries: when the younger is full the older is forgotten."""

    def __init__(self, make, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def __missing__(self, piece):
        value = self.older.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = value
        return value


class PairCache(dict):
    """pair key -> whether the two tokens may stand side by side."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, pair):
        if len(self) >= self.limit:
            self.clear()
        self[pair] = value = self.make(pair)
        return value


class Bpe:
    """A tokenizer file as merge tables, an automaton and a piece splitter."""

    def __init__(self, path: str, cache: int = 50_000):
        import ahocorasick
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: not a byte-level BPE file")
        self.path, self.spec, self._library = path, spec, None
        self.end = model.get("end_of_word_suffix") or ""
        self.alphabet = byte_alphabet()
        self.names = {i: t for t, i in model["vocab"].items()}
        self._merges(model)
        self.trie = ahocorasick.Automaton()
        for token, i in model["vocab"].items():
            if self._self_encoding(i):
                key = self._inner(token)
                self.length[i] = len(key)
                self.trie.add_word(key, (i, len(key)))
        self.trie.make_automaton()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens with rules of their own")
        self.names |= {i: t for t, i in self.specials.items()}
        self.split_specials = regex.compile("(" + "|".join(
            map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        steps = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
        pattern = next((p["pattern"]["Regex"] for p in steps if p["type"] == "Split"), BYTE_LEVEL_PATTERN)
        self.find = regex.compile(pattern).findall
        self.unusual = regex.compile(f"[^\\x00-\\u{PLAIN_LIMIT - 1:04x}]").search
        norm = spec.get("normalizer") or {}
        kinds = {n["type"] for n in norm.get("normalizers", [norm] if norm else [])}
        if not kinds <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"{path}: normaliser {kinds}")
        self.compose, self.fold = "NFC" in kinds, "Lowercase" in kinds
        self.pairs = PairCache(lambda p: self.compatible(p >> 32, p & 0xFFFFFFFF), 2 * cache)
        self.ids = PieceCache(self._packed, cache)
        self.counts = PieceCache(lambda p: len(self._packed(p)) // 4, 2 * cache)
        # where pieces end at white space, words can be cached whole
        self.words = PieceCache(lambda w: b"".join(map(self.ids.__getitem__, self.find(w))), cache) if pre_splits_at_space(pattern) else None

    def _inner(self, token: str) -> str:
        """A vocabulary string with the end mark folded into its last character."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            token = token[:-len(self.end)]
            return token[:-1] + chr(ord(token[-1]) + FINAL)
        return token

    def _merges(self, model) -> None:
        vocab = model["vocab"]
        size = max(vocab.values()) + 1
        self.length, self.born = [0] * size, [-1] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.rank = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), r)
            if self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = r, x, y

    def _self_encoding(self, i: int) -> bool:
        """Whether the token's own string is encoded as this token."""
        todo = [i]
        while todo:
            t = todo.pop()
            if self.born[t] >= 0:
                if not self.compatible(self.left[t], self.right[t], self.born[t]):
                    return False
                todo += [self.left[t], self.right[t]]
        return self.born[i] >= 0 or len(self._inner(self.names[i])) == 1

    def compatible(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge of a rank under ``before`` joins the border of a|b.

        Goes back in time: x and y are the tokens at the border, x until the
        merge of rank ``x_ends`` takes it up, y until ``y_ends``.  Of merges
        of one rank the leftmost comes first, hence the strict test on x
        alone."""
        rank, born, left, right = self.rank, self.born, self.left, self.right
        x, y, x_ends, y_ends = a, b, before, before
        while True:
            joined = rank.get((x, y))
            if joined is not None and joined < x_ends and joined <= y_ends and joined < before:
                return False
            if born[x] < 0 and born[y] < 0:
                return True
            if born[x] > born[y]:
                x_ends, x = born[x], right[x]
            else:
                y_ends, y = born[y], left[y]

    def _encode(self, symbols: str) -> tuple:
        """Ids of a piece written in the file's alphabet."""
        last = [-1] * len(symbols)          # last token of each prefix
        pairs = self.pairs
        for end, (token, size) in self.trie.iter(symbols):
            if last[end] < 0:
                start = end - size
                if start < 0 or (last[start] >= 0 and pairs[last[start] << 32 | token]):
                    last[end] = token
        out, at = [], len(symbols) - 1
        length = self.length
        while at >= 0:
            out.append(last[at])
            at -= length[last[at]]
        out.reverse()
        return tuple(out)

    def _symbols(self, shown: str) -> str:
        return shown[:-1] + chr(ord(shown[-1]) + FINAL) if self.end else shown

    def _packed(self, piece: str) -> bytes:
        """Ids of a plain piece as 32-bit numbers, end to end."""
        return pack(self._encode(self._symbols("".join(map(self.alphabet.__getitem__, piece.encode("utf-8"))))))

    @property
    def library(self):
        """The tokenizers library's reading of the same file, made when needed."""
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _segments(self, text: str):
        """(special id, None) or (None, plain text), in order."""
        if self.split_specials is None or not any(s in text for s in self.specials):
            yield None, text
            return
        for part in self.split_specials.split(text):
            if part in self.specials:
                yield self.specials[part], None
            elif part:
                yield None, part

    def _plain(self, text: str) -> str | None:
        """The normalised text if the pattern library splits it exactly, else None."""
        if not text.isascii():
            if self.unusual(text):
                return None
            if self.compose:
                import unicodedata
                text = unicodedata.normalize("NFC", text)
            if self.fold:
                text = text.replace("Σ", "σ")   # the library folds characters one by one
        return text.lower() if self.fold else text

    def _library_pieces(self, text: str) -> list[str]:
        t = self.library
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(text)]

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text as 32-bit numbers, end to end."""
        out = []
        for special, part in self._segments(text or ""):
            if special is not None:
                out.append(pack((special,)))
                continue
            plain = self._plain(part)
            if plain is None:
                out.extend(pack(self._encode(self._symbols(p))) for p in self._library_pieces(part))
            elif self.words is not None and not any(c in plain for c in "\x1c\x1d\x1e\x1f"):   # blanks to str.split alone
                out.extend(map(self.words.__getitem__, plain.split()))
            else:
                out.extend(map(self.ids.__getitem__, self.find(plain)))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()

    def count(self, text: str | None) -> int:
        n = 0
        for special, part in self._segments(text or ""):
            if special is not None:
                n += 1
                continue
            plain = self._plain(part)
            if plain is None:
                n += sum(len(self._encode(self._symbols(p))) for p in self._library_pieces(part))
            else:
                n += sum(map(self.counts.__getitem__, self.find(plain)))
        return n

    def decode(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        known = self.shown[ids[(ids >= 0) & (ids < len(self.shown))]].tolist()
        if not self.spec.get("decoder"):
            return " ".join(known if None not in known else [t for t in known if t is not None])
        return b"".join(t for t in known if t is not None).decode("utf-8", "replace")

    @cached_property
    def shown(self) -> np.ndarray:
        """Each id's share of a decoded text, None for numbers that are no ids."""
        out = np.full(max(self.names) + 1, None, dtype=object)
        known = {c: b for b, c in enumerate(self.alphabet)}
        for i, t in self.names.items():
            if not self.spec.get("decoder"):
                out[i] = t
            else:
                out[i] = bytes(known[c] for c in t) if all(c in known for c in t) else t.encode("utf-8")
        return out


def pack(ids) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


@lru_cache(maxsize=4)
def tokenizer(path: str, cache: int = 50_000) -> Bpe:
    """One tokenizer for each file, cache size and Python worker."""
    return Bpe(path, cache)


def _append(df: DataFrame, source: str, made: list[T.StructField], make) -> DataFrame:
    """``df`` plus columns computed from the column ``source`` by
    ``make(Arrow array) -> Arrow arrays``, in one pass."""
    names = [f.name for f in made]
    low = {n.lower() for n in names}
    base = drop_columns(df, *[n for n in names if n.lower() != source.lower()])
    schema = T.StructType([f for f in base.schema.fields if f.name.lower() not in low] + made)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                values = make(part.column(source))
                keep = [i for i, n in enumerate(part.schema.names) if n.lower() not in low]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in keep] + values,
                                                 [part.schema.names[i] for i in keep] + names)
    return base.mapInArrow(run, schema)


def _ids_of(bpe: Bpe, texts) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each text's start."""
    packed = [bpe.packed(t) for t in texts.to_pylist()]
    return np.frombuffer(b"".join(packed), dtype=np.int32), np.cumsum([0] + [len(p) // 4 for p in packed])


def _texts_of(bpe: Bpe, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([bpe.decode(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` plus the token ids of its whole texts, as the tokenizers library
    gives them without added special tokens, truncation or padding (special
    strings inside a text are recognised)."""
    return _append(df, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))],
                   lambda texts: [_lists(*_ids_of(tokenizer(path), texts))])


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` plus the text of its ids, special tokens kept, as the library
    decodes them."""
    return _append(df, ids_col, [T.StructField(out_col, T.StringType())], lambda ids: [_texts_of(
        tokenizer(path), ids.values.fill_null(-1).to_numpy(zero_copy_only=False), ids.offsets.to_numpy())])


def encode_and_decode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
                      out_col: str = "decoded", cache: int = 50_000) -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass, with one tokenizer in
    memory and no transfer of the ids between the two.  ``cache`` words are
    kept in each of two generations; a word is some 300 bytes there."""
    def make(texts):
        bpe = tokenizer(path, cache)
        flat, ends = _ids_of(bpe, texts)
        return [_lists(flat, ends), _texts_of(bpe, flat, ends)]
    return _append(df, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(out_col, T.StringType())], make)
