"""LM scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark, memory-mapped by workers.

Every stage is sharded by a hash, so no machine holds a table of all words or n-grams:

1. words: each task sums its words' 64-bit hashes and sends sorted blocks to hash-range shards, which write
   sorted hash arrays with counts to the shared folder. Within a shard words are ranked by count; a word's
   id is its rank and shard, so frequent words have small ids, which compress well;
2. n-grams of the highest order (``ORDER``): each task sums them and sends them to shards by context; contexts
   of frequent words only are split further by the whole n-gram, and their sums, one row per shard at most,
   are added up later. A shard writes its sorted hash array with counts and its contexts' sums (total and
   numbers of words seen once, twice, more often), and sends the n-grams of the order below, each counted
   once per word that precedes it, on to the shards of that order; and so on, in one job, down to words;
3. scoring: workers memory-map these arrays and look each block's distinct words, n-grams and contexts up.

Each order has discounts D1, D2, D3+ from its own counts of counts and is interpolated with the order below,
the lowest with the uniform distribution over V + 1 outcomes (the last is any unknown word). A text starts
with ORDER - 1 start symbols; n-grams that begin with one keep their plain counts, as nothing precedes them. An
unseen context gives the lower order. A few numbers per shard, and the frequent words (fewer than eight times
the shards), reach the driver. Counts of any size are kept (the arrays take the narrowest width that holds them).

Odds: words are told apart by 64 bits (see ``common.words_hashed``), n-grams by 64 bits while they are counted
(some two of n agree with n * n / 2**65). A shard's sorted hashes lie in buckets of 8 to 16, of which each keeps
its next 32 bits: an n-gram that was never seen is taken for one that was with odds of 16 / 2**32.

A context that was seen once in all is not stored: its n-gram of the order below tells that it was seen.

Defined cases: a null text counts as empty and is one end token; an untrained model (no training rows) has
N = V = 0, knows no token and gives every token the uniform probability over one outcome (score 0); repeated
rows count as often as they come; texts are read whole. Other columns pass through; those with the names of
the new ones are replaced.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosewell.llm.common import fresh_path, map_array, mix, modest_batches, pack_sorted, parts, summed, unpack_sorted, words_hashed, write_array

ORDER = 3
END = np.uint64(0x5EED0FE2D5E2D111)  # hash that stands for the end of a text
#: n-grams that a task gathers before it sends them on; bytes of text that are scored at once; mapped files.
FLUSH, SCORED, MAPS = 1_500_000, 4_000_000, 4_096
HALF = np.uint64(32)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class KneserNey:
    """Where the arrays lie, and the few numbers that are global. discounts: of each order, the lowest first."""

    uri: str
    shards: int
    order: int
    n_tokens: int = 0
    n_types: int = 0
    n_pairs: int = 0
    unknown: int = 0  # the id of any unknown word; the next one is the start symbol
    discounts: list[tuple[float, float, float]] = field(default_factory=list)
    lower_backoff: float = 1.0
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # ids of frequent words, sorted

    @property
    def start(self) -> int:
        return self.unknown + 1


def _range_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a 64-bit hash: ranges of equal width, so shards in order are sorted as a whole."""
    return ((keys >> HALF) * np.uint64(shards) >> HALF).astype(np.int64)


def _tokens(texts, chunk: int = 2_000_000):
    """Yields (first, n_tokens per text, hashes with an end after each text's words)."""
    for first, n, hashes in words_hashed(texts, chunk):
        ends = np.cumsum(n)
        yield first, n + 1, np.insert(hashes, ends, END)


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if values.size else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def _write_numbers(uri: str, values: np.ndarray) -> None:
    """Whole numbers in the narrowest width that holds them; eight bytes in front tell which."""
    narrow = _narrow(values)
    write_array(uri, np.concatenate([np.array([narrow.itemsize], np.uint64).view(np.uint8), np.ascontiguousarray(narrow).reshape(-1).view(np.uint8)]))


def _bucket_bits(n: int) -> int:
    """So that a bucket has 8 to 16 of n keys."""
    return max(n.bit_length() - 4, 0)


def _bucketed(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (the upper bits) and the next 32 bits of hashes."""
    bucket = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    return bucket.astype(np.int64), (keys << np.uint64(bits) >> HALF).astype(np.uint32)


def _write_keys(uri: str, shard: int, keys: np.ndarray) -> None:
    """Sorted hashes: where each bucket starts, and 32 bits of each."""
    bits = _bucket_bits(len(keys))
    bucket, rest = _bucketed(keys, bits)
    _write_numbers(f"{uri}-starts/{shard}", np.searchsorted(bucket, np.arange((1 << bits) + 1)))
    write_array(f"{uri}-keys/{shard}", rest)


def _context(columns: np.ndarray) -> np.ndarray:
    """Hash of the words of a context (rows of ``columns``)."""
    h = np.full(columns.shape[1], len(columns), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = mix(h * _FOLD + c)
    return h


def _gram(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context * _FOLD + word + np.uint64(1))


def _among(hot: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(values.shape, bool)
    return hot[np.minimum(np.searchsorted(hot, values), len(hot) - 1)] == values


def _shard(model: KneserNey, columns: np.ndarray, context: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each n-gram, and whether its context is split: by the context's hash, or by the n-gram's where the context has frequent words only."""
    split = _among(model.hot, columns).all(axis=0)
    return (mix(np.where(split, gram, context)) % np.uint64(model.shards)).astype(np.int64), split


def _packed(columns: np.ndarray, counts: np.ndarray) -> bytes:
    """Columns of ids and counts, byte plane by byte plane, compressed."""
    parts_ = [_narrow(columns), _narrow(counts)]
    planes = b"".join(np.ascontiguousarray(x.reshape(-1, x.shape[-1])).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in parts_)
    head = np.array([len(planes), columns.shape[0], *(x.itemsize for x in parts_)], np.int64).tobytes()
    return head + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, rows, wide, wide_n = np.frombuffer(data[:32], np.int64).tolist()
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[32:], size, asbytes=True), np.uint8)
    n = size // (rows * wide + wide_n)
    own, counts = (np.ascontiguousarray(x.reshape(w, -1).T).view(f"u{w}").reshape(-1) for x, w in ((planes[: rows * n * wide], wide), (planes[rows * n * wide :], wide_n)))
    return own.reshape(rows, n).astype(np.uint64), counts.astype(np.int64)


def _distinct(key: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their columns and the sums of their counts."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], columns[:, order[first]], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _by_shard(shard: np.ndarray, columns: np.ndarray, counts: np.ndarray):
    """(shard, packed columns and counts) of each shard."""
    order = np.argsort(shard, kind="stable")
    shard, columns, counts = shard[order], columns[:, order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else []
    for s, e in zip(at, at[1:], strict=False):
        yield int(shard[s]), _packed(columns[:, s:e], counts[s:e])


def _classes(counts: np.ndarray) -> list[int]:
    """Numbers of entries counted 1, 2, 3 and 4 times, and more than twice."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts > 2).sum())]


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts; where these are too few, the usual halves."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    found = (1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5)
    return tuple(float(np.clip(d, 0.05, k - 0.05)) for d, k in zip(found, (1, 2, 3), strict=True))


class _Reader:
    """Memory-mapped arrays of a model, opened as they are needed; the ones longest unused are closed beyond MAPS."""

    def __init__(self, model: KneserNey) -> None:
        self.model, self.open = model, OrderedDict()

    def array(self, name: str, shard: int, dtype=None) -> np.ndarray:
        """Without a dtype, numbers as _write_numbers leaves them."""
        key = (name, shard)
        if key not in self.open:
            found = map_array(f"{self.model.uri}/{name}/{shard}", dtype or np.uint8)
            if dtype is None and len(found):
                found = found[8:].view(f"u{int(found[:8].view(np.uint64)[0])}")
            self.open[key] = found
            if len(self.open) > MAPS:
                self.open.popitem(last=False)
        self.open.move_to_end(key)
        return self.open[key]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of sorted distinct hashes."""
        m = self.model
        ids, counts = np.full(len(hashes), m.unknown, np.uint64), np.zeros(len(hashes), np.int64)
        bounds = np.searchsorted(_range_shard(hashes, m.shards), np.arange(m.shards + 1))
        for shard in np.flatnonzero(np.diff(bounds)):
            s, e = bounds[shard], bounds[shard + 1]
            keys = self.array("word-keys", shard, np.uint64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes[s:e]), len(keys) - 1)
                known = keys[at] == hashes[s:e]
                ids[s:e][known] = self.array("word-ranks", shard)[at[known]].astype(np.uint64) * np.uint64(m.shards) + np.uint64(shard)
                counts[s:e][known] = self.array("word-counts", shard)[at[known]]
        return ids, counts

    def preceded(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of different words before each of the ids."""
        m = self.model
        out, shard = np.zeros(len(ids), np.int64), np.where(ids < m.unknown, ids % np.uint64(m.shards), np.uint64(m.shards)).astype(np.int64)
        for k, own in _groups(shard, m.shards):
            out[own] = self.array("word-before", k)[(ids[own] // np.uint64(m.shards)).astype(np.int64)]
        return out

    def places(self, name: str, shard: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes in a sorted array, and which of them are there."""
        rest = self.array(f"{name}-keys", shard, np.uint32)
        if not len(rest):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        starts = self.array(f"{name}-starts", shard)
        bucket, want = _bucketed(keys, _bucket_bits(len(rest)))
        low, high = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
        end = high
        while (low < high).any():  # by halving, all at once; a bucket is small
            middle = (low + high) >> 1
            less = rest[np.minimum(middle, len(rest) - 1)] < want
            open_ = low < high
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        return np.minimum(low, len(rest) - 1), (low < end) & (rest[np.minimum(low, len(rest) - 1)] == want)

    def grams(self, order: int, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Counts of n-grams by hash and shard."""
        out = np.zeros(len(keys), np.int64)
        for k, own in _groups(shard, self.model.shards):
            at, known = self.places(f"grams-{order}", k, keys[own])
            if known.any():
                out[own[known]] = self.array(f"grams-{order}", k)[at[known]]
        return out

    def contexts(self, order: int, keys: np.ndarray, split: np.ndarray) -> np.ndarray:
        """Total, and numbers of words seen once, twice, more often, after each context; 0 where it is not stored."""
        m = self.model
        out = np.zeros((len(keys), 4), np.int64)
        shard = (mix(keys) % np.uint64(m.shards)).astype(np.int64)
        for kind, name in ((False, f"contexts-{order}"), (True, f"split-{order}")):
            for k, own in _groups(np.where(split == kind, shard, m.shards), m.shards):
                at, known = self.places(name, k, keys[own])
                if known.any():
                    out[own[known]] = self.array(name, k).reshape(-1, 4)[at[known]]
        return out


def _groups(shard: np.ndarray, shards: int):
    """(shard, places in ``shard``) of each shard below ``shards`` that is there."""
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        yield int(k), order[bounds[k] : bounds[k + 1]]


_READERS: dict[str, _Reader] = {}


def _reader(model: KneserNey) -> _Reader:
    if model.uri not in _READERS:
        _READERS.clear()
        _READERS[model.uri] = _Reader(model)
    return _READERS[model.uri]


def _columns(model: KneserNey, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The ORDER - 1 tokens before each token, the farthest first (the start symbol before a text), and the token."""
    place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    out = np.full((model.order, len(ids)), model.start, np.uint64)
    for back in range(model.order):
        has = np.flatnonzero(place >= back)
        out[model.order - 1 - back, has] = ids[has - back]
    return out


_ROWS = "shard int, kind int, data binary, numbers array<long>"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    shard, kind, data, numbers = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary()), pa.array(numbers, pa.list_(pa.int64()))], ["shard", "kind", "data", "numbers"])


def _count_words(docs: DataFrame, shards: int) -> DataFrame:
    """shard, keys, counts: sorted blocks of word hashes."""

    def run(batches):
        keys, counts, size = [], [], 0

        def blocks():
            k, n = summed(np.concatenate(keys), np.concatenate(counts))
            shard = _range_shard(k, shards)
            at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
            rows = [(int(shard[s]), pack_sorted(k[s:e]), _packed(np.zeros((0, e - s), np.uint64), n[s:e])) for s, e in zip(at, at[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["shard", "keys", "counts"])

        for b in batches:
            for _, _, hashes in _tokens(b.column(0)):
                k, n = np.unique(hashes, return_counts=True)
                keys.append(k)
                counts.append(n)
                size += len(k)
                if size > FLUSH:
                    yield blocks()
                    keys, counts, size = [], [], 0
        if size:
            yield blocks()

    return docs.mapInArrow(run, "shard int, keys binary, counts binary")


def _write_words(uri: str):
    def run(pdf):
        import pandas as pd

        keys, counts = summed(np.concatenate([unpack_sorted(k) for k in pdf["keys"]]), np.concatenate([_unpacked(c)[1] for c in pdf["counts"]]))
        shard = int(pdf["shard"].iloc[0])
        rank = np.empty(len(keys), np.int64)
        rank[np.lexsort((keys, -counts))] = np.arange(len(keys))
        write_array(f"{uri}/word-keys/{shard}", keys)
        _write_numbers(f"{uri}/word-counts/{shard}", counts)
        _write_numbers(f"{uri}/word-ranks/{shard}", rank)
        return pd.DataFrame({"types": [len(keys)], "tokens": [int(counts.sum())]})

    return run


def _frequent(spark, model: KneserNey) -> np.ndarray:
    """Ids of the words that are more than one of 4 x shards of all tokens: fewer than 4 x shards, so they fit the driver."""

    def run(batches):
        for b in batches:
            out = []
            for shard in b.column(0).to_pylist():
                counts = _Reader(model).array("word-counts", shard)
                ranks = _Reader(model).array("word-ranks", shard)
                out += [int(r) * model.shards + shard for r in ranks[counts > model.n_tokens / (4 * model.shards)]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["id"])

    return np.array(sorted(r.id for r in spark.range(0, model.shards, 1, min(model.shards, parts(spark))).mapInArrow(run, "id long").collect()), np.uint64)


def _count_grams(docs: DataFrame, sent) -> DataFrame:
    """Blocks of n-grams of the highest order (kind: the order)."""

    def run(batches):
        m = sent.value
        reader, held, size = _reader(m), [], 0

        def blocks():
            key, columns, counts = _distinct(*(np.concatenate([h[k] for h in held], axis=-1) for k in range(3)))
            shard, _ = _shard(m, columns[:-1], _context(columns[:-1]), key)
            return _rows([(s, m.order, data, None) for s, data in _by_shard(shard, columns, counts)])

        for b in batches:
            for _, n, hashes in _tokens(b.column(0)):
                distinct, back = np.unique(hashes, return_inverse=True)
                columns = _columns(m, n, reader.words(distinct)[0][back])
                key, first, counts = np.unique(_gram(_context(columns[:-1]), columns[-1]), return_index=True, return_counts=True)
                held.append((key, columns[:, first], counts))
                size += len(key)
                if size > FLUSH:
                    yield blocks()
                    held, size = [], 0
        if size:
            yield blocks()

    return docs.mapInArrow(run, _ROWS)


def _write_sums(uri: str, shard: int, context: np.ndarray, sums: np.ndarray) -> None:
    """Contexts in order, without those that were seen once in all."""
    own = np.flatnonzero(sums[:, 0] > 1)
    _write_keys(uri, shard, context[own])
    _write_numbers(f"{uri}/{shard}", sums[own])


def _level(sent, order: int):
    """Writes a shard's n-grams of an order and the split contexts of the order above; sends the order below on."""

    def run(pdf):
        import pandas as pd

        m = sent.value
        shard = int(pdf["shard"].iloc[0])
        out = [(shard, 0, None, list(x)) for x in pdf.loc[pdf["kind"] == 0, "numbers"]]
        partial = [_unpacked(x) for x in pdf.loc[pdf["kind"] == -(order + 1), "data"]]
        if partial:
            columns = np.concatenate([c for c, _ in partial], axis=1)
            _, first, at = np.unique(columns[0], return_index=True, return_inverse=True)
            sums = np.zeros((len(first), 4), np.int64)
            np.add.at(sums, at, columns[1:].T.astype(np.int64))
            _write_sums(f"{m.uri}/split-{order + 1}", shard, columns[0][first], sums)
        blocks = [_unpacked(x) for x in pdf.loc[pdf["kind"] == order, "data"]]
        if blocks:
            columns, counts = (np.concatenate(x, axis=-1) for x in zip(*blocks, strict=True))
            if order == 1:
                reader = _Reader(m)
                whole = np.zeros(len(reader.array("word-keys", shard, np.uint64)), np.int64)
                np.add.at(whole, (columns[0] // np.uint64(m.shards)).astype(np.int64), counts)
                _write_numbers(f"{m.uri}/word-before/{shard}", whole)
                out.append((shard, 0, None, [1, *_classes(whole), int(whole.sum())]))
            else:
                out += _grams(m, order, shard, columns, counts)
        return pd.DataFrame(out, columns=["shard", "kind", "data", "numbers"])

    return run


def _grams(m: KneserNey, order: int, shard: int, columns: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Writes the n-grams of a shard and their contexts; rows of the split contexts, of the order below, and of the counts of counts."""
    context = _context(columns[:-1])
    key, columns, counts = _distinct(_gram(context, columns[-1]), columns, counts)
    name = f"{m.uri}/grams-{order}"
    _write_keys(name, shard, key)
    _write_numbers(f"{name}/{shard}", counts)
    out = [(shard, 0, None, [order, *_classes(counts), int(counts.sum())])]

    context = _context(columns[:-1])
    _, split = _shard(m, columns[:-1], context, key)
    by = np.argsort(context, kind="stable")
    contexts, first = np.unique(context[by], return_index=True)
    sums = np.stack([np.add.reduceat(x[by].astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts > 2)], axis=1)
    apart = split[by][first]
    _write_sums(f"{m.uri}/contexts-{order}", shard, contexts[~apart], sums[~apart])
    to = (mix(contexts[apart]) % np.uint64(m.shards)).astype(np.int64)
    pairs = np.concatenate([contexts[apart][None], sums[apart].T.astype(np.uint64)])
    out += [(s, -order, data, None) for s, data in _by_shard(to, pairs, np.ones(len(to), np.int64))]

    lower = columns[1:]
    # what begins with a start symbol keeps its plain count
    each = np.where(lower[0] == m.start, counts, 1) if order > 2 else np.ones(len(counts), np.int64)
    inner = _context(lower[:-1])
    key, lower, each = _distinct(_gram(inner, lower[-1]), lower, each)
    if order > 2:
        to, _ = _shard(m, lower[:-1], _context(lower[:-1]), key)
    else:
        to = (lower[0] % np.uint64(m.shards)).astype(np.int64)
    return out + [(s, order - 1, data, None) for s, data in _by_shard(to, lower, each)]


def train(docs: DataFrame, text: str = "text", order: int = ORDER) -> KneserNey:
    """The model of all texts of ``docs``; ``order`` is two or more."""
    if order < 2:
        raise ValueError("the order is two or more")
    spark = docs.sparkSession
    modest_batches(spark)
    shards = max(2, parts(spark))
    uri = fresh_path(spark, "kneser-ney")
    texts = docs.select(F.col(text).cast("string").alias("t"))
    rows = _count_words(texts, shards).groupBy("shard").applyInPandas(_write_words(uri), "types long, tokens long").collect()
    model = KneserNey(uri, shards, order, sum(r.tokens for r in rows), sum(r.types for r in rows), unknown=shards * max((r.types for r in rows), default=0))
    if not model.n_tokens:
        return model
    model.hot = np.append(_frequent(spark, model), np.uint64(model.start))
    sent = spark.sparkContext.broadcast(model)
    flow = _count_grams(texts, sent)
    for level in range(order, 0, -1):
        flow = flow.groupBy("shard").applyInPandas(_level(sent, level), _ROWS)
    numbers = np.array([r.numbers for r in flow.where("kind = 0").select("numbers").collect()], np.int64)
    of = [numbers[numbers[:, 0] == level, 1:].sum(axis=0) for level in range(1, order + 1)]
    model.discounts = [_discounts(n[:4]) for n in of]
    model.n_pairs = int(of[0][5])
    d, n = model.discounts[0], of[0]
    model.lower_backoff = float(d[0] * n[0] + d[1] * n[1] + d[2] * n[4]) / model.n_pairs
    return model


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0)


def _one_earlier(of: np.ndarray, start: np.ndarray, first: int) -> np.ndarray:
    """Each token's predecessor's entry; ``first`` at the start of a text."""
    out = np.empty_like(of)
    out[1:] = of[:-1]
    out[start] = first
    return out


def score_texts(texts, reader: _Reader) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base score and model score (both log10) of each text."""
    m = reader.model
    n_tokens, n_known = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    base, score = np.zeros(len(texts)), np.zeros(len(texts))
    for first, n, hashes in _tokens(texts, SCORED):
        here = slice(first, first + len(n))
        n_tokens[here] = n
        start = np.cumsum(n) - n
        if not m.n_tokens:
            continue
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = reader.words(distinct)
        n_known[here] = np.add.reduceat((counts > 0)[back].astype(np.int64), start)
        by_word = np.log10((counts + 0.5) / (m.n_tokens + 0.5 * (m.n_types + 1)))
        base[here] = np.add.reduceat(by_word[back], start)
        lower = _discounted(reader.preceded(ids), m.discounts[0]) / m.n_pairs + m.lower_backoff / (m.n_types + 1)
        p, token = lower[back], ids[back]
        # the different contexts, the start symbol last; each token's; and whether a context was seen
        contexts, of, seen = np.append(ids, np.uint64(m.start))[None], _one_earlier(back, start, len(ids)), np.append(counts > 0, True)
        for order in range(2, m.order + 1):
            context, split = _context(contexts), _among(m.hot, contexts).all(axis=0)
            sums = reader.contexts(order, context, split)
            sums[seen & (sums[:, 0] == 0)] = (1, 1, 0, 0)  # not stored, but seen: once in all
            key, last = _gram(context[of], token), order == m.order
            one, at = slice(None), slice(None)
            if not last:
                key, one, at = np.unique(key, return_index=True, return_inverse=True)
            own = of[one]
            count = reader.grams(order, key, (mix(np.where(split[own], key, context[own])) % np.uint64(m.shards)).astype(np.int64))
            d = m.discounts[order - 1]
            total = np.maximum(sums[:, 0], 1)
            backoff = np.where(sums[:, 0] > 0, (sums[:, 1] * d[0] + sums[:, 2] * d[1] + sums[:, 3] * d[2]) / total, 1.0)
            p = _discounted(count, d)[at] / total[of] + backoff[of] * p
            if not last:  # the n-gram that ends one token earlier is the next order's context
                contexts = np.concatenate([contexts[:, own], token[one][None]])
                contexts = np.concatenate([contexts, np.full((order, 1), m.start, np.uint64)], axis=1)
                of, seen = _one_earlier(at, start, len(key)), np.append(count > 0, True)
        score[here] = np.add.reduceat(np.log10(p), start)
    return n_tokens, n_known, base, score


def score(docs: DataFrame, model: KneserNey, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score, score and perplexity; columns of those names are replaced."""
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    base = docs.drop(*(set(new) - {text}))
    kept = [c for c in base.columns if c not in new]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reader = _reader(sent.value)
        reader.model = sent.value
        for b in batches:
            n, known, by_word, p = score_texts(b.column(b.schema.get_field_index(text)), reader)
            perplexity = 10.0 ** np.minimum(-p / np.maximum(n, 1), 300)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(n), pa.array(known), pa.array(np.full(len(n), sent.value.n_tokens)), pa.array(by_word), pa.array(p), pa.array(perplexity)], [*kept, *new])

    kinds = [T.LongType()] * 3 + [T.DoubleType()] * 3
    return base.mapInArrow(run, T.StructType([*(base.schema[c] for c in kept), *(T.StructField(c, k) for c, k in zip(new, kinds, strict=True))]))
