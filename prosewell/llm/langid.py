"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of every labelled text, per language, in one distributed
pass; the languages x buckets matrix of log probabilities (its size does not depend on the corpus) is
broadcast; scoring is sparse, per batch, in numpy.

Defined cases: a null text or one without a letter (of Unicode's letter categories; numbers such as one half
are none) is ``und`` with score 0; so is every text if no
labelled text was there. Rows with a null label do not train. Equal posteriors go to the language
that sorts first. More than ``MAX_LANGUAGES`` labels raise ValueError. Repeated rows count as often as they come. Other columns are never read; those of a
caller are passed through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosewell.llm.common import modest_batches, slices

BUCKETS = 1 << 16
#: Labels at most: the matrix has a row of half a megabyte for each.
MAX_LANGUAGES = 256
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_ASCII = np.full(128, 32, np.uint32)
_ASCII[97:123] = np.arange(97, 123)


@dataclass(frozen=True)
class LanguageModel:
    """languages in sorted order; log_prob [languages, buckets]; log_prior [languages]."""

    languages: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray


def _grams(texts: list[str], chunk: int = 1_000_000):
    """Yields (first, count, owner, bucket): n-grams of texts[first:first + count]; owner counts from 0."""
    at = 0
    while at < len(texts):
        group, size, first = [], 0, at
        while at < len(texts) and (not group or size < chunk):
            group.append(f" {texts[at].lower()} ")
            size += len(group[-1])
            at += 1
        code = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(code < 128, _ASCII[np.minimum(code, 127)], code).astype(np.uint32)
        owner = np.repeat(np.arange(len(group), dtype=np.int32), [len(g) for g in group])
        letter = code != 32
        for n in ORDERS:
            m = len(code) - n + 1
            if m <= 0:
                continue
            h = np.full(m, 0x811C9DC5 + n, np.uint32)
            keep = owner[:m] == owner[n - 1 :]
            some = np.zeros(m, bool)
            for k in range(n):
                h = (h ^ code[k : k + m]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(13)
                some |= letter[k : k + m]
            keep &= some
            h = (h * np.uint32(0x85EBCA6B)) >> np.uint32(16)
            yield first, len(group), owner[:m][keep], h[keep]


def train(labelled: DataFrame, text: str = "text", label: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """The model of all labelled rows. What reaches the driver is languages x buckets, whatever the corpus."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}
        for b in batches:
            for at, part in slices(b.column(0)):
                labels = b.column(1).slice(at, len(part)).to_pylist()
                texts = part.to_pylist()
                for y in sorted(set(labels)):
                    own = [t or "" for t, z in zip(texts, labels, strict=True) if z == y]
                    n_docs[y] = n_docs.get(y, 0) + len(own)
                    s = sums.setdefault(y, np.zeros(BUCKETS, np.int64))
                    for _, _, _, bucket in _grams(own):
                        s += np.bincount(bucket, minlength=BUCKETS)
        for y, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_pydict(
                {"y": [y] * (len(at) + 1), "b": np.append(at, -1).astype(np.int32), "n": np.append(s[at], n_docs[y]).astype(np.int64)},
                schema=pa.schema([("y", pa.string()), ("b", pa.int32()), ("n", pa.int64())]),
            )

    modest_batches(labelled.sparkSession)
    some = labelled.select(F.col(label).cast("string").alias("y")).where("y is not null").distinct().limit(MAX_LANGUAGES + 1).count()
    if some > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    pairs = labelled.select(F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("y")).where("y is not null")
    rows = pairs.mapInArrow(count, "y string, b int, n long").groupBy("y", "b").agg(F.sum("n").alias("n")).toArrow()
    y, b, n = rows["y"].to_pylist(), rows["b"].to_numpy(), rows["n"].to_numpy()
    languages = sorted(set(y))
    counts, docs = np.zeros((len(languages), BUCKETS)), np.zeros(len(languages))
    which = np.array([languages.index(x) for x in y], np.int64)
    counts[which[b >= 0], b[b >= 0]] = n[b >= 0]
    docs[which[b < 0]] = n[b < 0]
    log_prob = np.log(counts + smoothing) - np.log(counts.sum(axis=1, keepdims=True) + smoothing * BUCKETS)
    return LanguageModel(languages, log_prob, np.log(docs) - np.log(docs.sum()) if languages else docs)


def classify(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text."""
    n_lang = len(model.languages)
    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    which = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if not n_lang or not which:
        return names, score
    total = np.tile(model.log_prior, (len(which), 1))
    for first, count, owner, bucket in _grams([texts[i] for i in which]):
        for k in range(n_lang):
            total[first : first + count, k] += np.bincount(owner, weights=model.log_prob[k][bucket], minlength=count)
    best = total.argmax(axis=1)
    top = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    for i, k, p in zip(which, best, top, strict=True):
        names[i], score[i] = model.languages[k], p
    return names, score


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the two columns added; a column of ``docs`` with such a name is replaced."""
    modest_batches(docs.sparkSession)
    base = docs.drop(lang, score)
    at = base.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = [classify(part.to_pylist(), sent.value) for _, part in slices(b.column(at))]
            names, p = [x for n, _ in found for x in n], np.concatenate([np.zeros(0), *(s for _, s in found)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(p)], [*b.schema.names, lang, score])

    schema = T.StructType([*base.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return base.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: LanguageModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` whose language is known: not ``und``, and likelier than all others together (``least``). Columns stay as they are."""
    named = identify(docs, model, text, "__lang", "__score")
    return named.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least)).drop("__lang", "__score")
