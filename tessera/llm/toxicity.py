"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

A text is sentences, a sentence is units: white-space words without the
punctuation around and inside them, and runs of three or more single
characters read as one word ("i d i o t").  Two units are compared by the gap-weighted
subsequence kernel: every common subsequence of three characters counts,
damped by 0.5 for each character it spans in either unit, so an insult with
characters put in, left out or swapped stays close to itself.

Training, on a bounded sample of labelled documents (``toxic_docs`` and
``clean_docs``, the rows first in a fixed hash order): landmarks are units that
mark toxic documents, taken one after another by the documents that those
before do not cover, plus common neutral ones; the Nystroem map turns kernel
values against them into coordinates in which a linear SVM is the kernel SVM.
Positive units are those that mark toxic documents and are like a landmark,
and variants of the clearest with characters put in, left out or changed;
negative ones are all others that come near a landmark.  A logistic curve over
a document's worst unit and its number of toxic units, neither weighted below
0, gives the score, so a further toxic unit never lowers it.

Scoring is one pass with the model (a few kilobytes) in the closure.  Units
repeat, so each worker keeps the scores of recent units, bounded; a miss is
computed with the others of its slice of rows as one array program.  Whole
texts are scored: units longer than 24 characters are read in windows of 24
that overlap by half.

Null and empty texts get the score of a text without toxic units; null ids
keep their row and are never training rows; repeated rows are scored each;
labels that are null are not used; with no labels of both kinds every score is
the base rate; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import string
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices
from tessera.llm.labelled import fit_curve, held_out_fold, training_rows

SUBSEQUENCE, DECAY, SHARPEN = 3, 0.5, 2
LONGEST, LANDMARKS = 24, 48
CACHE_UNITS = 250_000
FLOOR, CEILING = -1.5, 2.0                # decision value of a text without units; the highest that counts
ALIKE, NEAR = 0.25, 0.1                   # similarity of a unit that a landmark covers, and of one worth learning from
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[^\S\n]+[^\W_]){2,}(?![^\W_])")
_SIGNS = {ord(c): None for c in string.punctuation + "\u00ab\u00bb\u2018\u2019\u201c\u201d\u201e\u2026\u00a1\u00bf\u2013\u2014"}


def units_of(text: str) -> list[str]:
    """Raw lower-case units of a text: words and joined runs of single characters."""
    low = text.lower()
    words = low.split()
    spaced = _SPACED.findall(low)
    return words + ["".join(s.split()) for s in spaced] if spaced else words


def windows(unit: str) -> list[str]:
    """A unit without the punctuation around and inside it, in pieces of bounded length."""
    if not unit.isalnum():
        unit = unit.translate(_SIGNS)
    if len(unit) <= LONGEST:
        return [unit]
    return [unit[i:i + LONGEST] for i in range(0, len(unit) - LONGEST // 2, LONGEST // 2)]


def _codes(units: list[str], n: int) -> np.ndarray:
    """Code points of units of one length."""
    return np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.int32).reshape(len(units), n)


class Marks:
    """Landmarks as a table from character triples to damped counts, so that
    the kernel of a unit with all of them is a sum over the unit's own
    triples that any landmark has."""

    def __init__(self, marks: list[str]):
        self.marks, self.own = marks, self_kernel(marks)
        letters = sorted({c for m in marks for c in m})
        self.letter = np.zeros(max(map(ord, letters), default=0) + 2, dtype=np.int32)   # 0: in no landmark
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.base = len(letters) + 1
        self.place = np.zeros(self.base ** SUBSEQUENCE, dtype=np.int32)                 # 0: in no landmark
        rows = [np.zeros(len(marks), dtype=np.float32)]
        for j, m in enumerate(marks):
            ids, damp = self._triples(_codes([m], len(m)))
            for t, d in zip(ids[0].tolist(), damp.tolist()):
                if not self.place[t]:
                    self.place[t] = len(rows)
                    rows.append(np.zeros(len(marks), dtype=np.float32))
                rows[self.place[t]][j] += d
        self.table = np.stack(rows)

    def _triples(self, codes: np.ndarray):
        """(triple numbers of units of one length, damping by span)."""
        at, damp = triples(codes.shape[1])
        x = self.letter[np.minimum(codes, len(self.letter) - 1)]
        ids = (x[:, at[0]] * self.base + x[:, at[1]]) * self.base + x[:, at[2]]
        if self.base > 1:
            ids[(x[:, at[0]] == 0) | (x[:, at[1]] == 0) | (x[:, at[2]] == 0)] = 0
        return ids, damp

    def similarity(self, units: list[str]) -> np.ndarray:
        """Kernel of every unit with every landmark, scaled to 1 for equal
        strings and sharpened by a power (a product of kernels is a kernel);
        0 without a common subsequence."""
        out = np.zeros((len(units), len(self.marks)), dtype=np.float32)
        by_length: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by_length.setdefault(len(u), []).append(i)
        for n, rows in by_length.items():
            if n < SUBSEQUENCE or not self.marks:
                continue
            step = max(1, (1 << 20) // len(triples(n)[1]))
            for at in range(0, len(rows), step):
                part = np.array(rows[at:at + step])
                codes = _codes([units[i] for i in part.tolist()], n)
                ids, damp = self._triples(codes)
                row, col = np.nonzero(found := self.place[ids])
                if not len(row):
                    continue
                values = self.table[found[row, col]] * damp[col, None]
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                some = row[first]
                scale = np.sqrt(_self_kernel(codes[some])[:, None] * self.own[None, :])
                out[part[some]] = (np.add.reduceat(values, first, axis=0) / scale) ** SHARPEN
        return out


@lru_cache(maxsize=LONGEST + 1)
def triples(n: int):
    """Index triples i < j < k below n, and the damping of each."""
    at = np.array(list(combinations(range(n), SUBSEQUENCE)), dtype=np.int64).reshape(-1, SUBSEQUENCE).T
    return at, (DECAY ** (at[-1] - at[0] + 1)).astype(np.float32) if at.size else np.zeros(0, dtype=np.float32)


def self_kernel(units: list[str]) -> np.ndarray:
    """Kernel of each unit with itself."""
    return np.array([_self_kernel(_codes([u], len(u)))[0] for u in units], dtype=np.float32)


def _self_kernel(codes: np.ndarray) -> np.ndarray:
    """Kernel of units of one length with themselves, by dynamic programming
    over both copies: prime[i][j] holds common subsequences of i characters in
    the read part of one and the first j characters of the other, damped up to
    both ends."""
    n, w = codes.shape
    d, p = np.float32(DECAY), SUBSEQUENCE
    s = np.ascontiguousarray(codes.T)
    prime = [np.ones((w + 1, n), dtype=np.float32)] + [np.zeros((w + 1, n), dtype=np.float32) for _ in range(p - 1)]
    total = np.zeros(n, dtype=np.float32)
    for a in range(w):
        same = s[a] == s
        total += (same * prime[p - 1][:w]).sum(axis=0)
        for i in range(p - 1, 0, -1):
            add = same * prime[i - 1][:w]
            run = np.zeros(n, dtype=np.float32)
            prime[i] *= d
            for j in range(w):
                run *= d
                run += add[j]
                prime[i][j + 1] += run * (d * d)
    return total * (d * d)


@dataclass
class Model:
    marks: Marks
    weights: np.ndarray            # of the similarities: Nystroem map and SVM in one
    bias: float
    curve: tuple                   # logistic curve: worst unit, number of toxic units, constant

    def decisions(self, units: list[str]) -> np.ndarray:
        return self.marks.similarity(units) @ self.weights + self.bias

    def scores(self, worst, toxic) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-(a * np.clip(worst, FLOOR, CEILING) + b * np.log1p(toxic) + c)))


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 30):
    """Linear SVM with squared hinge loss by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-6
    weight = weight / weight.sum()
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active][:, None]
        new = np.linalg.solve((xa * wa).T @ xa + np.diag(pen), (xa * wa).T @ y[active])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w[:-1], float(w[-1])


def _without_copies(texts: list[str], labels: list[int], values: int = 8):
    """Texts without those much like one before: a copy's words would pass
    for words that mark many documents.  Two texts are alike when half of
    their smallest word hashes are the same."""
    owner: dict[int, int] = {}
    keep = []
    for i, t in enumerate(texts):
        smallest = sorted({zlib.crc32(w.encode("utf-8", "replace")) for w in set(t.lower().split())})[:values]
        votes = Counter(owner[h] for h in smallest if h in owner)
        if votes and 2 * votes.most_common(1)[0][1] >= len(smallest):
            continue
        keep.append(i)
        for h in smallest:
            owner[h] = i
    return [texts[i] for i in keep], [labels[i] for i in keep]


def _apart(units: list[str], most: int, alike: float = 0.3) -> list[str]:
    """The first units of a ranking, without those much like one before."""
    out: list[str] = []
    for u in units[:40 * most]:
        if len(out) < most and (not out or Marks(out).similarity([u]).max() < alike):
            out.append(u)
    return out


def variants(unit: str) -> set[str]:
    """A unit with a character put in, left out or changed, or two put in."""
    cut = range(len(unit) + 1)
    put = {unit[:i] + c + unit[i:] for i in cut for c in ("x", "q", "1")} | {unit[:i] + "zk" + unit[i:] for i in cut[1:-1]}
    return (put | {unit[:i] + c + unit[i + 1:] for i in cut[:-1] for c in ("", "x")}) - {unit}


def _landmarks(units: list[str], candidates: np.ndarray, has: list[np.ndarray], cost: np.ndarray, toxic_n: int, most: int) -> list[int]:
    """Candidates one after another, each the one that stands in most toxic
    documents that those before do not cover yet, so that languages and
    subjects with few documents get landmarks too; ``cost`` is counted off."""
    seen = sorted({k for k in range(len(units)) if len(has[k])})
    names, left, open_, picked = [units[k] for k in seen], np.ones(toxic_n), candidates.tolist(), []
    while open_ and len(picked) < most:
        gain = [left[has[k]].sum() - cost[k] for k in open_]
        best = int(np.argmax(gain))
        if gain[best] < 1:
            break
        picked.append(open_.pop(best))
        like = dict(zip(seen, Marks([units[picked[-1]]]).similarity(names)[:, 0].tolist()))
        covered = {d for k, v in like.items() if v >= ALIKE for d in has[k].tolist()}
        left[sorted(covered)] *= 0.5
        open_ = [k for k in open_ if like[k] < 2 * ALIKE]
    return picked


def fit_rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A logistic curve none of whose weights is negative: more evidence never
    lowers a score."""
    use = list(range(x.shape[1]))
    while True:
        fitted = fit_curve(x[:, use], y, weight)
        if (fitted[:-1] >= 0).all():
            break
        use = [u for u, v in zip(use, fitted) if v > 0]
    out = np.zeros(x.shape[1] + 1)
    out[use], out[-1] = fitted[:-1], fitted[-1]
    return out


def train(texts: list[str], labels: list[int], base_rate: float | None = None, landmarks: int = LANDMARKS) -> Model:
    """Fit on whole labelled texts (see the module's notes)."""
    texts, labels = _without_copies(texts, labels)
    y = np.asarray(labels, dtype=np.int64)
    rate = base_rate if base_rate is not None else float(np.mean(y)) if len(y) else 0.5
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    constant = Model(Marks([]), np.zeros(0), 0.0, (0.0, 0.0, math.log(rate / (1 - rate))))
    if not len(y) or y.min() == y.max():
        return constant
    docs = [sorted({w for u in units_of(t) for w in windows(u) if len(w) >= SUBSEQUENCE}) for t in texts]
    units = sorted({u for d in docs for u in d})
    if not units:
        return constant
    where = {u: i for i, u in enumerate(units)}
    held = [np.array([where[u] for u in d], dtype=np.int64) for d in docs]
    toxic_n, clean_n = int(y.sum()), int(len(y) - y.sum())
    dirty = np.bincount(np.concatenate([h for h, label in zip(held, y) if label]), minlength=len(units)).astype(np.float64)
    clean = np.bincount(np.concatenate([h for h, label in zip(held, y) if not label]), minlength=len(units)).astype(np.float64)
    pooled = (dirty + clean + 1) / (len(y) + 2)
    # how far a unit's rate in toxic documents stands out
    excess = (dirty / toxic_n - clean / clean_n) / np.sqrt(pooled * (1 - pooled) * (1 / toxic_n + 1 / clean_n))
    candidates = np.flatnonzero((dirty >= 3) & (excess > 3) & (dirty / toxic_n > 5 * clean / clean_n))
    inside: list[list[int]] = [[] for _ in units]
    for n, h in enumerate(h for h, label in zip(held, y) if label):
        for k in h.tolist():
            inside[k].append(n)
    picked = _landmarks(units, candidates, [np.array(d, dtype=np.int64) for d in inside], 2 * clean * toxic_n / clean_n, toxic_n, landmarks * 3 // 4)
    if not picked:
        return constant
    marks = [units[k] for k in picked]
    neutral = [units[k] for k in np.lexsort((np.arange(len(units)), -clean))[:40 * landmarks].tolist() if clean[k] and units[k] not in marks]
    table = Marks(marks + _apart(neutral, landmarks // 4))
    own = table.similarity(table.marks).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-4 * values.max()
    nystroem = vectors[:, keep] / np.sqrt(values[keep])
    similar = table.similarity(units).astype(np.float64)
    nearest, x = similar[:, :len(marks)].max(axis=1), similar @ nystroem
    # units of toxic documents that are like a landmark and rare elsewhere, against all others that come near one
    positive = (excess > 2) & (dirty >= 2) & (dirty / toxic_n > 3 * clean / clean_n) & (nearest >= ALIKE)
    positive[picked] = True
    negative = (clean > 0) & (nearest > NEAR) & ~positive
    far = (clean > 0) & ~negative & ~positive
    put = sorted({v for k in picked if not clean[k] and excess[k] > 8 for v in variants(units[k])} - set(units))
    rows = np.vstack([x[positive], table.similarity(put).astype(np.float64) @ nystroem, x[negative], x[far]])
    sides = np.concatenate([np.ones(positive.sum() + len(put)), -np.ones(negative.sum() + far.sum())])
    share = lambda v, whole: whole * v / v.sum() if len(v) else v
    weight = np.concatenate([share(np.sqrt(dirty[positive]), 0.5), share(np.ones(len(put)), 0.5), share(np.sqrt(clean[negative]), 10.0), share(np.sqrt(clean[far]), 1.0)])
    w, bias = fit_svm(rows, sides, weight, ridge=1e-4)
    decision = x @ w + bias
    worst = np.array([decision[h].max() if len(h) else FLOOR for h in held])
    toxic = np.array([(decision[h] > 0).sum() for h in held])
    balance = np.where(y == 1, rate / toxic_n, (1 - rate) / clean_n) * len(y)
    curve = fit_rising(np.stack([np.clip(worst, FLOOR, CEILING), np.log1p(toxic)], axis=1), y, balance)
    return Model(table, nystroem @ w, bias, tuple(map(float, curve)))


class Scorer:
    """A model with the decisions of recent units of one worker."""

    def __init__(self, model: Model):
        self.model, self.known, self.older = model, {}, {}

    def learn(self, raw: set) -> None:
        known, older = self.known, self.older
        new = []
        for u in raw.difference(known):
            if u in older:
                known[u] = older[u]
            else:
                new.append(u)
        pieces = [windows(u) for u in new]
        distinct = list({w for ws in pieces for w in ws if len(w) >= SUBSEQUENCE})
        value = dict(zip(distinct, self.model.decisions(distinct).tolist()))
        known.update((u, value.get(ws[0], FLOOR) if len(ws) == 1 else max(value.get(w, FLOOR) for w in ws))
                     for u, ws in zip(new, pieces))

    def documents(self, texts: list) -> np.ndarray:
        docs = [units_of(t) if t else [] for t in texts]
        if len(self.known) > CACHE_UNITS:
            self.older, self.known = self.known, {}
        self.learn({u for d in docs for u in d})
        worst, toxic = np.full(len(docs), FLOOR), np.zeros(len(docs))
        for i, d in enumerate(docs):
            if d:
                f = np.fromiter(map(self.known.__getitem__, d), dtype=np.float64, count=len(d))
                worst[i] = f.max()
                if worst[i] > 0:
                    toxic[i] = len({u for u, v in zip(d, f.tolist()) if v > 0})
        return self.model.scores(worst, toxic)


_SCORERS: dict = {}


def scorer(blob: bytes) -> Scorer:
    """The worker's scorer of a pickled model, kept between tasks."""
    key = hashlib.sha256(blob).digest()
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(pickle.loads(blob))
    return _SCORERS[key]


def fit(docs: DataFrame, labels: DataFrame, toxic_docs: int = 800, clean_docs: int = 1600) -> Model:
    texts, y, rate = training_rows(docs, labels, "toxic", toxic_docs, clean_docs)
    return train(texts, y, rate)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score in 0..1, predicted."""
    blob = pickle.dumps(model)

    def run(batches):
        own = scorer(blob)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(own.documents(part.column("text").to_pylist()), pa.float64())],
                    ["doc_id", "score"])
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out_fold(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
