"""Toxicity: averaged subword embeddings under a linear softmax of two classes, trained jointly in numpy.

A word (lower-cased, cut at white space, punctuation at its ends taken off) is the mean of the vectors of its
character 3- to 6-grams, ends marked, hashed to a table of fixed size; a text is the mean of its words; a linear
softmax over that mean gives the score of label 1. Vectors and softmax are trained together, by Adam steps over
shuffled batches, so a misspelling that was never seen still shares most of its vectors with the word it comes from.

The fit is on the driver, from a bounded sample of the labelled rows: at most ``FIT_ROWS`` rows and ``FIT_BYTES``
bytes of text for each label, in the order of a hash; each label is weighted to its share of all labelled rows. As
both layers are linear, all that scoring needs of a n-gram is one number: a vector of fixed size is broadcast,
and texts are scored whole in Arrow batches, without a shuffle.

Defined cases: a null text is empty; a text without a word has the score of the bias alone. Rows with a label that
is null or neither 0 nor 1 do not train; an id that is labelled both ways counts as 1. Without any labelled row, or with one label only, the scores
lean to what was seen (0.5 for nothing). Repeated rows are scored alike, and count as often as they come in the
fit. Long texts and long unbroken runs of characters are read in slices. Columns of the new names are replaced, other columns are untouched
and never read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosewell.llm.common import modest_batches, slices, stored

BITS, DIMENSION = 18, 8
ORDERS = (3, 4, 5, 6)
FIT_ROWS, FIT_BYTES = 4_000, 24_000_000
EPOCHS, BATCHES, BATCH, RATE, PENALTY = 8, 32, 256, 0.3, 1e-6
STRIPPED = ".,;:!?()[]{}\"'«»“”|-"
#: Words that a task remembers the value of, and the longest such word.
REMEMBERED, SHORT_WORD = 100_000, 64
_SLICE = 1 << 18


@dataclass(frozen=True)
class ToxicityModel:
    """vectors [buckets, dimension] of the n-grams, softmax [dimension, 2] and bias [2]."""

    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    @property
    def values(self) -> np.ndarray:
        """Of each n-gram: its vector's logit of label 1 over label 0."""
        return (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64)

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def _hashed(code: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the n-grams of code points."""
    m = len(code) - n + 1
    h = np.full(m, 0x811C9DC5 + n, np.uint32)
    for k in range(n):
        h = (h ^ code[k : k + m]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(13)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def _code(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket): the n-grams of each word, by word. Every word has one at least, as its ends are marked."""
    code = _code(words)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) + 2 for w in words])
    owners, buckets = [], []
    for n in ORDERS:
        m = len(code) - n + 1
        if m > 0:
            own = owner[:m] == owner[n - 1 :]
            owners.append(owner[:m][own])
            buckets.append(_hashed(code, n)[own].astype(np.int32))
    owners, buckets = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owners, kind="stable")
    return owners[order], buckets[order]


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_values(words: list[str], values: np.ndarray) -> np.ndarray:
    """The mean value of each word's n-grams."""
    out, at = np.zeros(len(words)), 0
    while at < len(words):
        first, size = at, 0
        while at < len(words) and (at == first or size + len(words[at]) < _SLICE):
            size += len(words[at]) + 2
            at += 1
        if size > 2 * _SLICE:  # one long run of characters
            code, total, count = _code(words[first:at]), 0.0, 0
            for start in range(0, len(code), _SLICE):
                for n in ORDERS:
                    part = code[start : start + _SLICE + n - 1]
                    if len(part) >= n:
                        found = _hashed(part, n)
                        total, count = total + float(values[found].sum()), count + len(found)
            out[first] = total / count
        else:
            owner, bucket = subwords(words[first:at])
            count = np.bincount(owner, minlength=at - first)
            out[first:at] = np.bincount(owner, weights=values[bucket], minlength=at - first) / count
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every range."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def fit(texts: list[str | None], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), seed: int = 0) -> ToxicityModel:
    """Vectors and softmax of labelled texts; ``weights`` are those of a row of label 0 and of label 1."""
    rng = np.random.default_rng(seed)
    vectors = (rng.normal(size=(1 << BITS, DIMENSION)) * 0.01).astype(np.float32)
    softmax, bias = rng.normal(size=(DIMENSION, 2)) * 0.5, np.zeros(2)
    y, known, bags = np.array(labels, np.int64), {}, []
    for text in texts:
        bag = Counter(w for w in (t.strip(STRIPPED) for t in tokens(text)) if w)
        bags.append((np.array([known.setdefault(w, len(known)) for w in bag], np.int64), np.array(list(bag.values()), float)))
    if not len(y):
        return ToxicityModel(vectors * 0, softmax, bias)
    owner, bucket = subwords(list(known)) if known else (np.zeros(0, np.int32), np.zeros(0, np.int32))
    n_grams = np.bincount(owner, minlength=len(known))
    grams_at, n_words = np.cumsum(n_grams) - n_grams, np.array([len(w) for w, _ in bags])
    words_at = np.cumsum(n_words) - n_words
    word = np.concatenate([w for w, _ in bags])
    share = np.concatenate([c / max(c.sum(), 1) for _, c in bags])
    trained = (vectors, softmax, bias)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in trained]
    step, size = 0, min(BATCH, max(BATCH // 8, len(y) // BATCHES))  # few rows make as many steps as many
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(order), size):
            step += 1
            rows = order[k : k + size]
            at, row = _spread(words_at[rows], n_words[rows]), np.repeat(np.arange(len(rows)), n_words[rows])
            used, which = np.unique(word[at], return_inverse=True)
            grams = bucket[_spread(grams_at[used], n_grams[used])]
            mine, per = np.repeat(np.arange(len(used)), n_grams[used]), 1 / np.maximum(n_grams[used], 1)
            lean = softmax[:, 1] - softmax[:, 0]
            of_word = np.bincount(mine, weights=(vectors @ lean.astype(np.float32))[grams], minlength=len(used)) * per
            z = np.bincount(row, weights=of_word[which] * share[at], minlength=len(rows)) + bias[1] - bias[0]
            w = np.where(y[rows] == 1, weights[1], weights[0])
            r = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows]) * w / w.sum()
            to_word = np.bincount(which, weights=r[row] * share[at], minlength=len(used)) * per
            to_gram = np.bincount(grams, weights=to_word[mine], minlength=1 << BITS).astype(np.float32)
            to_lean = vectors.T @ to_gram
            slopes = (np.outer(to_gram, lean.astype(np.float32)) + np.float32(PENALTY) * vectors, np.stack([-to_lean, to_lean], 1), np.array([-r.sum(), r.sum()]))
            rate = RATE * (1 - epoch / EPOCHS)
            for x, (mean, square), slope in zip(trained, moments, slopes, strict=True):
                mean += 0.1 * (slope - mean)
                square += 0.001 * (slope * slope - square)
                x -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-10)
    return ToxicityModel(vectors, softmax, bias)


def labelled(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of the bounded sample, and how many ids have each label.

    The ids are picked from the table of labels; at most ``FIT_ROWS`` for each label are broadcast to the
    documents, so that no text is shuffled but those of the sample.
    """
    rows = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    totals = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        some = rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    texts = stored(texts.where(F.octet_length("text") <= FIT_BYTES).withColumn("h", F.xxhash64("id")), "toxicity-sample")
    found = None
    for y in (0, 1):
        some = texts.where(F.col("y") == y).orderBy("h", "id", "text").limit(FIT_ROWS)
        so_far = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("y").orderBy("h", "id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        some = some.withColumn("bytes", so_far).where(F.col("bytes") <= FIT_BYTES).select("h", "text", "y")
        found = some if found is None else found.unionByName(some)
    return found, totals


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> ToxicityModel:
    """The model of the documents (id, text) that the table of labels (id, label 0 or 1) covers."""
    sample, totals = labelled(docs, labels, text, doc_id, label)
    rows = sorted(sample.collect(), key=lambda r: (r.h, r.text, r.y))
    taken = Counter(r.y for r in rows)
    weights = tuple(totals.get(y, 0) / taken[y] if taken[y] else 1.0 for y in (0, 1))
    return fit([r.text for r in rows], [r.y for r in rows], weights)


class Scorer:
    """Scores of texts; the values of short words are remembered, up to a bound."""

    def __init__(self, values: np.ndarray, offset: float) -> None:
        self.values, self.offset = values, offset
        self.known: dict[str, float | None] = {}

    def _learn(self, new: list[str]) -> dict[str, float | None]:
        bare = [t.strip(STRIPPED) for t in new]
        found = word_values([w for w in bare if w], self.values)
        at = iter(found.tolist())
        return {t: next(at) if w else None for t, w in zip(new, bare, strict=True)}

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for k, text in enumerate(texts):
            bag = Counter(tokens(text))
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = [t for t in bag if t not in self.known]
            learned = self._learn(new) if new else {}
            self.known.update((t, v) for t, v in learned.items() if len(t) <= SHORT_WORD)
            total, n = 0.0, 0
            for t, count in bag.items():
                v = learned[t] if t in learned else self.known[t]
                if v is not None:
                    total, n = total + count * v, n + count
            out[k] = total / n if n else 0.0
        return 1 / (1 + np.exp(-np.clip(out + self.offset, -700, 700)))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the score of label 1, from 0 to 1."""
    modest_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    base = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias("__read"))
    sent = docs.sparkSession.sparkContext.broadcast((model.values, model.offset))

    def run(batches):
        scorer = Scorer(*sent.value)
        for b in batches:
            found = [scorer.score(part.to_pylist()) for _, part in slices(b.column(len(kept)))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(np.concatenate([np.zeros(0), *found]))], [*kept, name])

    return base.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.DoubleType())]))
