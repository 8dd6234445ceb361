"""Line dedup: a segment-partition edit join over the distinct lines of all documents.

Lines within an edit distance of ``edits`` (2) are near copies. A line cut into edits + 1 segments shares
one of them, the i-th, with each near copy so that at most i edits lie to its left and edits - i to its
right. So

1. tasks hash the segments of every line under its own length (the index side) and the substrings that could
   meet the segments of a line up to ``edits`` shorter (the probe side, multi-match-aware), all from prefix
   sums in numpy; a task sends equal lines once. Keys go out sorted and packed, a row for each range of keys;
2. index and probe keys of a range meet in one sorted pass, after equal lines of different tasks have become one
   (else a line that stands in t tasks would meet itself and its near copies t * t times). Keys that more than
   ``MANY`` lines share make no pairs there, but a row for each of their lines: the rows are in proportion to the
   probe keys, whatever a group's size. What a task already knows to be crowded goes past the ranges, so that a key which
   very many lines share is no one task's work;
3. the lines that share such a crowded key are all compared with one of them only, the pivot: of a sample of
   ``SAMPLE`` the one that agrees with the others the longest; keys with the same pivot are one group. From left
   to right, a line is read along the pivot; where it deviates, up to ``edits`` edits take it on, in each possible
   way. Any two near copies, read so with the edits that turn one into the other, come to a deviation (place in the
   pivot, the line's character there) that both have, or both to the end, and then their rests are as near as the
   edits left allow. So a deviation met with edits left is a new key, under which the rests are read along pivots
   of their own, and the rest itself after any edits is a key, too: equal rests make near copies if the edits of
   both are ``edits`` at most, else only with an edit at the same place. A line has one key without edits and
   1 + 3 + ... in all, whatever the size of its group. Most are its own; a first reading packs all keys into a bitmap
   of those that are made twice, and only these become rows. Pairs are made within keys of ``MANY`` rows or fewer
   and within equal rests, for ``ROUNDS`` rounds. What is left then, or once it makes no more pairs than there were
   lines at first, is compared in full;
4. texts are fetched for lines of such pairs and keys only - a bitmap marks them, so the others never
   leave their task - and a banded bit-parallel edit distance decides.

A line goes if the same line stands earlier (smaller doc_id, then smaller line number), or if a near copy of
it first stands earlier. Lines under ``min_chars`` (30) characters stay and have no near copies: headings,
brackets and list items recur in sound texts, two edits are much of so short a line, and its segments of a few
characters would meet most other lines. ``document_report`` counts and lists their exact repeats (of lines that
are not blank), which need the line's id only.

A line's id is its 128-bit XXH3 hash: some two of n different lines agree with odds of n * n / 2**129 (1e-11 for
a hundred trillion lines), whatever pattern the lines have. Segment keys and 64-bit parts of ids only
find candidates; every near copy is decided on the texts, each under its full id.

Defined cases: a null text has no lines and stays null; an empty text is one empty line; of repeated rows of
the same id and text the lines count as the same place; a null doc_id sorts first; an empty table gives no rows.
doc_id is an integer column (others raise ValueError). A document whose lines all go is dropped by
``deduplicated``. Long lines are used whole. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewell.llm.common import mix, modest_batches, pack_sorted, parts, slices, stored, unpack_sorted

EDITS, MIN_CHARS = 2, 30
MANY, ROUNDS, SAMPLE = 8, 6, 16
#: Keys that a task holds before it sends them, and that a range of keys has at most, or about so many.
KEYS = 1_000_000
#: Members of crowded keys that go out as one row.
MEMBERS = 50_000
#: Bits of a bitmap for each value, and of a bitmap at least and at most; bits of a part in which one of them is made.
BITS_EACH, LEAST_BITS, MOST_BITS, PART_BITS = 16, 1 << 20, 1 << 31, 1 << 21


def _bits(n: int) -> int:
    """Bits of a bitmap of n values: 16 for each, so that it stays sparse, up to 256 MB (then more values than wanted pass, no fewer)."""
    return min(max(LEAST_BITS, 1 << (BITS_EACH * n - 1).bit_length() if n else 0), MOST_BITS)


_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.n = 0
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            n = max(n, 1 << 16)
            base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse)]), dtype=np.uint64)
            self.n = n
        return self.up, self.down


_POWERS = _Powers()


def _segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of each of the edits + 1 even segments of parts of the given lengths; the longer ones come last."""
    n = edits + 1
    size, longer = length // n, length % n
    out, start = [], np.zeros_like(length)
    for i in range(n):
        here = size + (i >= n - longer)
        out.append((start, here))
        start = start + here
    return out


class _Lines:
    """The lines of some texts, with hashes of any of their parts."""

    def __init__(self, texts: list[str | None]) -> None:
        parts = [(t + "\n") if t is not None else "" for t in texts]
        joined = "".join(parts)
        self.code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.raw = joined.encode("utf-8", "surrogatepass").split(b"\n")
        self.end = np.flatnonzero(self.code == 10)
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else self.end
        self.length = self.end - self.start
        bounds = np.cumsum([len(p) for p in parts])
        self.owner = np.searchsorted(bounds, self.start, side="right")
        first = np.searchsorted(self.owner, np.arange(len(texts)))
        self.number = np.arange(len(self.start)) - first[self.owner] if len(self.start) else self.start
        self.sums = None

    def ids(self, which: np.ndarray) -> np.ndarray:
        """128-bit ids of the lines, as two 64-bit columns."""
        raw = self.raw
        return np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[k]) for k in which.tolist()]), np.int64).reshape(-1, 2)

    def hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of parts; equal parts agree. Unequal ones may (rarely): they only make candidates."""
        with np.errstate(over="ignore"):
            if self.sums is None:
                up, self.down = _POWERS.get(len(self.code) + 1)
                self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.code.astype(np.uint64) + np.uint64(1)) * up[: len(self.code)], dtype=np.uint64)])
            return mix((self.sums[start + size] - self.sums[start]) * self.down[start] + size.astype(np.uint64) * _C[0])

    def taking_part(self, min_chars: int, every: bool = False) -> np.ndarray:
        """Lines of ``min_chars`` or more; with ``every`` also the shorter ones that are not blank."""
        ok = self.length >= min_chars
        if every:
            rest = np.flatnonzero(~ok)
            ok[rest] = [bool(self.raw[k].decode("utf-8", "surrogatepass").strip()) for k in rest.tolist()]
        return np.flatnonzero(ok)


def _keys(lines: _Lines, which: np.ndarray, edits: int, min_chars: int):
    """(line, key, own) of the segments of lines (``own``), and of the other substrings that could meet a segment of a line as long or up to ``edits`` shorter.

    Segment i is sought at shifts that leave at most i edits to its left and edits - i to its right.
    """
    for less in range(edits + 1):
        length = lines.length[which] - less
        ok = length >= min_chars
        some, length = which[ok], length[ok]
        for i, (start, size) in enumerate(_segments(length, edits)):
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                fits = np.flatnonzero((start + shift >= 0) & (start + shift + size <= length + less))
                part = lines.hashes((lines.start[some] + start + shift)[fits], size[fits])
                with np.errstate(over="ignore"):
                    yield some[fits], mix(part + np.uint64(i) * _C[1] + length[fits].astype(np.uint64) * _C[2]).view(np.int64), less == shift == 0


def _is_set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    bit = np.mod(values, 8 * len(bits))
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _chunks(column):
    """(first row, texts) of about a million bytes."""
    for at, part in slices(column, 1_000_000):
        yield at, part.to_pylist()


def _binary(ids: np.ndarray) -> pa.Array:
    """128-bit ids as a binary column."""
    offsets = np.arange(0, 16 * len(ids) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(ids).tobytes())])


def _new(ids: np.ndarray, ok: np.ndarray, sent: set[int]) -> np.ndarray:
    """Indices of the lines with ``ok`` that this task has not sent; only saves repeats."""
    at = np.flatnonzero(ok)
    line, first = np.unique(ids[at, 0], return_index=True)
    new = np.array([h not in sent for h in line.tolist()], bool)
    if len(sent) > 1_000_000:
        sent.clear()
    sent.update(line[new].tolist())
    return np.sort(at[first[new]])


def _scan(docs: DataFrame, min_chars: int, schema: str, rows, rest=lambda: ()) -> DataFrame:
    """``rows(batch, first row, lines, which, their ids)`` over all texts, then ``rest()``; a task sees a line once."""

    def run(batches):
        sent: set[int] = set()
        for b in batches:
            for at, texts in _chunks(b.column(2)):
                lines = _Lines(texts)
                which = lines.taking_part(min_chars)
                ids = lines.ids(which)
                new = _new(ids, np.ones(len(ids), bool), sent)
                if len(new):
                    yield from rows(b, at, lines, which[new], ids[new])
        yield from rest()

    return docs.mapInArrow(run, schema)


def _lines(docs: DataFrame, min_chars: int, every: bool) -> DataFrame:
    """id, doc_id, text_hash, number, long (of ``min_chars`` or more) of every place of a line."""

    def run(batches):
        for b in batches:
            for at, texts in _chunks(b.column(2)):
                lines = _Lines(texts)
                which = lines.taking_part(min_chars, every)
                if not len(which):
                    continue
                owner = pa.array(lines.owner[which] + at)
                yield pa.RecordBatch.from_arrays([_binary(lines.ids(which)), b.column(0).take(owner), b.column(1).take(owner), pa.array(lines.number[which].astype(np.int32)), pa.array(lines.length[which] >= min_chars)], ["id", "doc_id", "text_hash", "number", "long"])

    return docs.mapInArrow(run, "id binary, doc_id long, text_hash long, number int, long boolean")


def _marked(values: DataFrame) -> np.ndarray | None:
    """Bits of the 64-bit values in column v. None if there are none."""
    size = _bits(values.count())
    words = values.select(F.expr(f"cast(pmod(v, {size}) as long)").alias("bit")).select(F.expr("bit div 64").cast("int").alias("w"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    if not len(words):
        return None
    bits = np.zeros(size // 64, np.int64)
    bits[words["w"].to_numpy()] = words["m"].to_numpy()
    return bits.view(np.uint8)


def _first_of_each(*columns: np.ndarray) -> np.ndarray:
    """Indices of the different rows, in the order of the columns."""
    order = np.lexsort(columns[::-1])
    differ = np.zeros(max(len(order) - 1, 0), bool)
    for c in columns:
        differ |= c[order[1:]] != c[order[:-1]]
    return order[np.concatenate([[True], differ])] if len(order) else order


def _crowded_here(key: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys that more than MANY different lines of sorted ``key`` share, in order; which rows are of such a key and not among its first MANY + 1)."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([starts, [len(key)]]))
    often, spare = [], np.zeros(len(key), bool)
    for k in np.flatnonzero(size > MANY).tolist():
        at = np.arange(starts[k], starts[k] + size[k])
        first = at[np.unique(line[at], return_index=True)[1]]
        if len(first) > MANY:
            often.append(key[starts[k]])
            spare[at] = True
            spare[first[: MANY + 1]] = False
    return np.array(often, np.uint64), spare


def _labels(spark, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for ranges of keys and for as many parts of members, such that a shuffle by them gives each of its partitions as many as any other."""
    n = parts(spark)
    each = -(-2 * ranges // n)
    of: dict[int, list[int]] = {}
    more = 8 * (each + 8)
    for r in spark.range(n * more).select(F.col("id").cast("int").alias("k"), F.expr(f"pmod(hash(cast(id as int)), {n})").alias("p")).collect():  # in proportion to the ranges
        of.setdefault(r.p, []).append(r.k)
    dealt = [of[k % n][k // n] if len(of.get(k % n, ())) > k // n else n * more + k for k in range(2 * ranges)]
    return np.array(dealt[:ranges], np.int32), np.array(dealt[ranges:], np.int32)


def _sent_keys(docs: DataFrame, edits: int, min_chars: int, ranges: int, labels: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """part, own, keys, lines: the keys of all lines, packed for each of ``ranges`` even ranges of them.

    A key that is crowded within what a task holds is crowded for good: the task sends MANY + 1 of its lines to the
    range, which mark it there, and all others as members (``own`` is null), to parts that any task can take. So what a range
    gets of one key does not grow with the lines that share it, but with the number of tasks.
    """
    bounds = np.array([k * (1 << 64) // ranges for k in range(1, ranges)], np.uint64)
    held = []  # each task has its own
    turn = [0]
    names = ["part", "own", "keys", "lines"]

    def packed():
        often, spared = np.zeros(0, np.uint64), []
        for own in (True, False):
            found = [x for x in held if x[2] == own]
            if not found:
                continue
            key, line = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            order = np.argsort(key)
            key, line = key[order], line[order]
            if own:
                often, spare = _crowded_here(key, line)
            else:
                at = np.minimum(np.searchsorted(often, key), max(len(often) - 1, 0))
                spare = often[at] == key if len(often) else np.zeros(len(key), bool)
            spared.append((key[spare], line[spare]))
            key, line = key[~spare], line[~spare]
            cuts = np.concatenate([[0], np.searchsorted(key, bounds), [len(key)]])
            at = np.flatnonzero(np.diff(cuts))
            offsets = pa.py_buffer((8 * cuts).astype(np.int32).tobytes())
            columns = [pa.Array.from_buffers(pa.binary(), ranges, [None, offsets, pa.py_buffer(x.tobytes())]).take(pa.array(at)) for x in (key, line)]
            yield pa.RecordBatch.from_arrays([pa.array(labels[0][at]), pa.array(np.full(len(at), own)), *columns], names)
        held.clear()
        key, line = (np.concatenate([np.zeros(0, t), *(x[k] for x in spared)]) for k, t in ((0, np.uint64), (1, np.int64)))
        for start in range(0, len(key), MEMBERS):
            some = slice(start, start + MEMBERS)
            turn[0] += 1
            part = labels[1][(turn[0] * 7919 + int(line[start]) % 104729) % ranges]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([None], pa.bool_()), pa.array([key[some].tobytes()], pa.binary()), pa.array([line[some].tobytes()], pa.binary())], names)

    def rows(b, at, lines, which, ids):
        of = np.zeros(len(lines.start), np.int64)
        of[which] = ids[:, 0]
        held.extend((key.view(np.uint64), of[line], own) for line, key, own in _keys(lines, which, edits, min_chars))
        if sum(len(x[0]) for x in held) > KEYS:
            yield from packed()

    return _scan(docs, min_chars, "part int, own boolean, keys binary, lines binary", rows, packed)


def _met(sent: DataFrame) -> DataFrame:
    """a, b, key: of packed keys (see ``_sent_keys``) the pairs (a, b) of different lines that share one; no pairs of a key that more than MANY lines share, but a row (a, key) for each line with it on either side."""
    many = MANY

    def meet(table):
        own = table["own"].to_pylist()
        side = lambda name, which, kind: np.frombuffer(b"".join(x for x, o in zip(table[name].to_pylist(), own, strict=True) if o is which), kind)
        key, line = side("keys", True, np.uint64), side("lines", True, np.int64)
        one = _first_of_each(key, line)
        key, line = key[one], line[one]
        each, first, n = np.unique(key, return_index=True, return_counts=True)
        probe, of = side("keys", False, np.uint64), side("lines", False, np.int64)
        at = np.searchsorted(each, probe)
        hit = np.flatnonzero(at < len(each))
        hit = hit[each[at[hit]] == probe[hit]]
        group, of = np.concatenate([np.repeat(np.arange(len(each)), n), at[hit]]), np.concatenate([line, of[hit]])
        some = np.flatnonzero((n[group] > min(many, 1)) | (of != line[first[group]]))  # not: a line alone with its key
        some = some[_first_of_each(group[some], of[some])]
        group, of = group[some], of[some]
        crowded = n[group] > many
        members = of[crowded], each[group[crowded]].view(np.int64)
        group, of = group[~crowded], of[~crowded]
        size = n[group]
        other = line[np.repeat(first[group], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        of = np.repeat(of, size)
        a, b = np.minimum(of, other), np.maximum(of, other)
        pairs = np.flatnonzero(a != b)
        pairs = pairs[_first_of_each(a[pairs], b[pairs])]
        direct = side("lines", None, np.int64), side("keys", None, np.uint64).view(np.int64)
        found = [a[pairs], b[pairs], None], [members[0], None, members[1]], [direct[0], None, direct[1]]
        return pa.concat_tables([pa.table([pa.nulls(len(x[0]), pa.int64()) if c is None else pa.array(c) for c in x], ["a", "b", "key"]) for x in found])

    return sent.groupBy("part").applyInArrow(meet, "a long, b long, key long")


def _texts_of(docs: DataFrame, wanted: DataFrame, min_chars: int) -> DataFrame:
    """line, id, words: the lines whose 64-bit part is wanted (column v)."""
    marks = _marked(wanted)
    sent = None if marks is None else docs.sparkSession.sparkContext.broadcast(marks)

    def rows(b, at, lines, which, ids):
        keep = _is_set(sent.value, ids[:, 0]) if sent else np.zeros(len(ids), bool)
        which, ids = which[keep], ids[keep]
        if len(which):
            values = [lines.raw[k].decode("utf-8", "surrogatepass") for k in which.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), _binary(ids), pa.array(values, pa.string())], ["line", "id", "words"])

    lines = _scan(docs, min_chars, "line long, id binary, words string", rows)
    return lines.join(wanted.select(F.col("v").alias("line")), "line").dropDuplicates(["id"])


def within(a: str, b: str, edits: int) -> int:
    """Edit distance of two texts, or edits + 1 if it is more: common ends are cut off, then a banded bit-parallel pass.

    A rest of 64 characters or fewer is one word without a band. The band holds the diagonals up to ``edits`` from the main one in one 64-bit word (edits of 31 at most).
    """
    if abs(len(a) - len(b)) > edits:
        return edits + 1
    for reverse in (False, True):
        low, high = 0, min(len(a), len(b))
        while low < high:  # longest common end, by halving
            mid = (low + high + 1) // 2
            same = a[len(a) - mid :] == b[len(b) - mid :] if reverse else a[:mid] == b[:mid]
            low, high = (mid, high) if same else (low, mid - 1)
        a, b = (a[: len(a) - low], b[: len(b) - low]) if reverse else (a[low:], b[low:])
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a) if len(a) <= edits else edits + 1
    full, top = (1 << 64) - 1, 1 << 63
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    if len(a) <= 64:  # the whole column fits the word: no band is needed
        plus, minus, distance, last = full, 0, len(a), 1 << (len(a) - 1)
        for c in b:
            match = masks.get(c, 0)
            zero = ((((match & plus) + plus) & full) ^ plus) | match | minus
            up, down = minus | (full & ~(zero | plus)), zero & plus
            distance += bool(up & last) - bool(down & last)
            up, down = (up << 1 | 1) & full, (down << 1) & full
            plus, minus = down | (full & ~(zero | up)), zero & up
        return min(distance, edits + 1)
    plus, minus, distance = (full << (63 - edits)) & full, 0, edits
    give_up = 2 * edits + len(b) - len(a)
    at, row = edits - 63, top >> 1
    for j, c in enumerate(b):
        mask = masks.get(c, 0)
        match = (mask >> at if at >= 0 else mask << -at) & full
        at += 1
        zero = ((((match & plus) + plus) & full) ^ plus) | match | minus
        up = minus | (full & ~(zero | plus))
        down = zero & plus
        if j < len(a) - edits:  # along the lowest diagonal of the band
            distance += not zero & top
        else:  # along the last row
            distance += bool(up & row) - bool(down & row)
            row >>= 1
        if distance > give_up:
            return edits + 1
        plus = down | (full & ~((zero >> 1) | up))
        minus = (zero >> 1) & up
    return distance if distance <= edits else edits + 1


def _verify(batches):
    """Rows a, b, text_a, text_b, edits: those within the bound, with the distance."""
    for b in batches:
        cols = [b.column(k).to_pylist() for k in range(5)]
        found = [(x, y, d) for x, y, s, t, e in zip(*cols, strict=True) if (d := within(s, t, e)) <= e]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int32()))], ["a", "b", "distance"])


def _decided(pairs: DataFrame, edits: int, name: str) -> DataFrame:
    """a, b, distance of the pairs (a, b, text_a, text_b) within ``edits``."""
    rows = pairs.select("a", "b", "text_a", "text_b", F.lit(edits).alias("edits"))
    return stored(rows.mapInArrow(_verify, "a binary, b binary, distance int"), name)


def _states(line: str, at: int, pivot: str, pivot_at: int, edits: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """(i, j, places edited) wherever ``line``, read from ``at`` along ``pivot`` from ``pivot_at``, deviates from it or ends with it, with up to ``edits`` edits where it deviates."""
    out, seen = [], set()
    open_ = [(at, pivot_at, ())]
    for i, j, edited in open_:
        i, j = _agree(line, i, pivot, j)
        out.append((i, j, edited))
        if len(edited) == edits or (i == len(line) and j == len(pivot)):
            continue
        for di, dj in ((1, 1), (1, 0), (0, 1)):
            step = (i + di, j + dj, (*edited, j))
            if step[0] <= len(line) and step[1] <= len(pivot) and step not in seen:
                seen.add(step)
                open_.append(step)
    return out


def deviations(line: str, pivot: str, edits: int) -> tuple[int | None, set[tuple[int, int]]]:
    """(distance, or None beyond ``edits``; deviations met): ``line`` read along ``pivot``, with up to ``edits`` edits where it deviates.

    A deviation is its place in the pivot and the code of the line's character there (-1 at its end).
    """
    best, met = None, set()
    for i, j, edited in _states(line, 0, pivot, 0, edits):
        if i == len(line) and j == len(pivot):
            best = len(edited) if best is None else min(best, len(edited))
        else:
            met.add((j, ord(line[i]) if i < len(line) else -1))
    return best, met


def _agree(a: str, i: int, b: str, j: int) -> tuple[int, int]:
    """Where two texts first disagree from i and j on."""
    step, most = 16, min(len(a) - i, len(b) - j)
    done = 0
    while done < most:  # ever longer parts, then halves of the one that differs
        n = min(step, most - done)
        if a[i + done : i + done + n] == b[j + done : j + done + n]:
            done += n
            step *= 2
        elif n == 1:
            break
        else:
            most, step = done + n, max(1, n // 2)
    return i + done, j + done


def _central(batches):
    """Rows key, sample (id, at, words): the place (id, at) of the sample that agrees with the others the longest."""
    for b in batches:
        best = []
        for sample in b.column(1).to_pylist():
            rests = sorted((x["words"][x["at"] :], x["id"], x["at"]) for x in sample)
            best.append(max(rests, key=lambda x: sum(_agree(x[0], 0, y[0], 0)[0] for y in rests if y[0] != x[0])))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[1] for x in best], pa.binary()), pa.array([x[2] for x in best], pa.int32())], ["key", "b", "pivot_at"])


def _pivots(members: DataFrame, texts: DataFrame) -> DataFrame:
    """key, b, pivot_at: the pivot of each key (members: key, id, at)."""
    # one line of each of SAMPLE classes, so that no group is gathered; keys of the same lines draw the same ones
    drawn = members.groupBy("key", F.expr(f"pmod(xxhash64(id), {SAMPLE})").alias("class")).agg(F.min(F.struct(F.xxhash64("id"), "id", "at")).alias("x"))
    drawn = drawn.select("key", F.col("x.id").alias("id"), F.col("x.at").alias("at")).join(texts.select("id", "words"), "id")
    return stored(drawn.groupBy("key").agg(F.collect_list(F.struct("id", "at", "words")).alias("sample")).mapInArrow(_central, "key long, b binary, pivot_at int"), "pivots")


def _hashed(kind: str, key: int, place: int, rest: str | int) -> int:
    h = xxhash.xxh3_64_intdigest(f"{kind} {key} {place} {rest}".encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


_STATES = "key long, exact boolean, id binary, at int, used int, edited array<long>"


def _read_on(b: pa.RecordBatch):
    """For each row (id, key, at, used, edited, words, pivot_at, pivot, edits): its id, its key, its edits so far and its new keys, {(key, exact, at): [edits used, their places]}, the line read on from ``at`` along the pivot of its key."""
    for id_, key, at, used, edited, words, pivot_at, pivot, edits in zip(*(c.to_pylist() for c in b.columns), strict=True):
        found: dict[tuple, list] = {}
        for i, j, places in _states(words, at, pivot, pivot_at, edits - used):
            n = used + len(places)
            keys = [(_hashed("rest", key, j, words[i:]), True, 0)]
            if n < edits and (i < len(words) or j < len(pivot)):
                keys.append((_hashed("next", key, j, ord(words[i]) if i < len(words) else -1), False, i))
            for k in keys:
                had = found.setdefault(k, [n, set()])
                had[0] = min(had[0], n)
                had[1].update(places)
        yield id_, key, edited, found


def _packer(size: int):
    def run(batches):
        """Rows part, bits: the bits of the new keys of a batch's lines, packed for each part of the bitmap; the bit of keys that two lines or more make is there twice."""
        for b in batches:
            keys = [k for *_, found in _read_on(b) for k in {k for k, _, _ in found}]
            bit, n = np.unique(np.mod(np.array(keys, np.int64), size), return_counts=True)
            bit = np.repeat(bit, np.minimum(n, 2)).astype(np.uint64)
            part, first = np.unique(bit // np.uint64(PART_BITS), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([pack_sorted(x) for x in np.split(bit, first[1:])][: len(part)], pa.binary())], ["part", "bits"])

    return run


def _set_twice(batches):
    """Rows bits: of rows (part, lists of packed bits) the bits that are there twice, packed."""
    for b in batches:
        out = []
        for lists in b.column(1).to_pylist():
            bit, n = np.unique(np.concatenate([unpack_sorted(x) for x in lists]), return_counts=True)
            out.append(pack_sorted(bit[n > 1]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["bits"])


def _made_twice(rows: DataFrame, edits: int):
    """Broadcast bitmap of the new keys (see ``_read_on``) that two of the rows or more make; most keys are one line's own."""
    size = _bits(rows.count() * sum(3**k for k in range(edits + 1)))
    by_part = rows.mapInArrow(_packer(size), "part int, bits binary").groupBy("part").agg(F.collect_list("bits").alias("lists"))
    bits = np.zeros(size // 8, np.uint8)
    for x in by_part.mapInArrow(_set_twice, "bits binary").toArrow()["bits"].to_pylist():
        bit = unpack_sorted(x)
        np.bitwise_or.at(bits, bit >> np.uint64(3), np.left_shift(1, (bit & np.uint64(7)).astype(np.uint8), dtype=np.uint8))
    return rows.sparkSession.sparkContext.broadcast(bits)


def _along_pivots(rows: DataFrame, edits: int) -> DataFrame:
    """The new keys (_STATES) of the rows, but for those that only one of them makes."""
    twice = _made_twice(rows, edits)

    def run(batches):
        for b in batches:
            out = []
            for id_, key, edited, found in _read_on(b):
                shared = _is_set(twice.value, np.array([k for k, _, _ in found], np.int64))
                for ((k, exact, i), (n, places)), keep in zip(found.items(), shared.tolist(), strict=True):
                    if keep:
                        out.append((k, exact, id_, i, n, sorted({*edited, *(_hashed("edit", key, place, "") for place in places)})))
            types = (pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["key", "exact", "id", "at", "used", "edited"])

    return rows.mapInArrow(run, _STATES)


def _pairs(left: DataFrame, right: DataFrame, on: list[str], which: str = "true") -> DataFrame:
    """a, b: rows of two tables (id, used) that agree in ``on``, a the smaller id."""
    same = " and ".join(f"x.{c} = y.{c}" for c in on)
    return left.alias("x").join(right.alias("y"), F.expr(f"{same} and x.id < y.id and {which}")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _crowded_links(members: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """All links between lines that share a crowded key (members: key, id)."""
    members = stored(members.select("key", "id", F.lit(0).alias("at"), F.lit(0).alias("used"), F.expr("cast(array() as array<bigint>)").alias("edited")).distinct(), "members")
    words, pivot = texts.select("id", "words"), texts.select(F.col("id").alias("b"), F.col("words").alias("pivot"))
    at_first = members.count()
    pairs = []
    for turn in range(ROUNDS + 1):
        left = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0]
        if not left:
            break
        if turn == ROUNDS or left <= at_first:
            pairs.append(_pairs(members, members, ["key"]))
            break
        rows = members.join(_pivots(members, texts), "key")
        if not turn:  # keys with the same pivot are one group: any two of its lines may be near
            rows = rows.withColumn("key", F.xxhash64("b")).dropDuplicates(["key", "id"])
        rows = rows.join(words, "id").join(pivot, "b").select("id", "key", "at", "used", "edited", "words", "pivot_at", "pivot", F.lit(edits).alias("edits"))
        rows = stored(rows, "along")
        states = stored(_along_pivots(rows, edits), "states")
        several = states.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most")
        shared = stored(states.join(several.select("key", (F.col("n") > MANY).alias("crowded")), "key"), "members")
        light, dense, members = (shared.where(x).drop("crowded") for x in ("not crowded", "crowded and exact", "crowded and not exact"))
        pairs.append(_pairs(light, light, ["key"]))
        # the same rest: near if the edits of both are few enough, else only if both have one at the same place
        up_to, own = dense.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(edits) - F.col("used")))), dense.withColumn("v", F.col("used"))
        pairs.append(_pairs(up_to, own, ["key", "v"]))
        places = dense.withColumn("v", F.explode("edited"))
        pairs.append(_pairs(places, places, ["key", "v"], f"x.used + y.used > {edits}"))
    if not pairs:
        return texts.sparkSession.createDataFrame([], "a binary, b binary, distance int")
    every = stored(functools.reduce(DataFrame.unionByName, pairs).distinct(), "pairs")
    x, y = (texts.select(F.col("id").alias(c), F.col("words").alias(f"text_{c}")) for c in "ab")
    return _decided(every.join(x, "a").join(y, "b"), edits, "links")


def line_links(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Places (id, doc_id, text_hash, number, long) of all lines that take part; where each line first stands and its number of places (id, first, n); links (a, b, distance) between different lines.

    ``docs`` has doc_id, text_hash and text. With ``every`` the places of shorter lines are there, too. All
    links are there, in crowded keys as well; equal lines are one line and have none.
    """
    places = stored(_lines(docs, min_chars, every), "lines")
    first = stored(places.groupBy("id").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")), "first")
    keys_each = (edits + 1) * (edits + 2)  # of a line, at most: 12 for two edits
    ranges = max(2 * parts(docs.sparkSession), keys_each * first.count() // KEYS + 1)
    met = stored(_met(_sent_keys(docs, edits, min_chars, ranges, _labels(docs.sparkSession, ranges))), "met")
    pairs = stored(met.where("key is null").select("a", "b").distinct(), "pairs")
    crowded = met.where("key is not null").select("key", F.col("a").alias("line"))
    every_line = [x.select(F.col(c).alias("v")) for x, c in ((pairs, "a"), (pairs, "b"), (crowded, "line"))]
    wanted = stored(functools.reduce(DataFrame.unionByName, every_line).distinct(), "wanted")
    texts = stored(_texts_of(docs, wanted, min_chars), "texts")
    x, y = (texts.select(F.col("line").alias(c), F.col("id").alias(f"id_{c}"), F.col("words").alias(f"text_{c}")) for c in "ab")
    links = _decided(pairs.join(x, "a").join(y, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "text_a", "text_b"), edits, "links")
    if not crowded.isEmpty():
        links = links.unionByName(_crowded_links(crowded.join(texts, "line").select("key", "id"), texts, edits))
        links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").distinct(), "links")
    return places, first, links


def _place():
    """Where a line stands; a null doc_id sorts first."""
    return F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "number", "text_hash")


def _decisions(docs: DataFrame, edits: int, min_chars: int, doc_id: str, text: str, every: bool) -> DataFrame:
    """A row per place of a line that is repeated or linked: doc_id, text_hash, number, n_links, drop, short (a repeat under ``min_chars``), near, first_doc_id, first_number."""
    modest_batches(docs.sparkSession)
    if docs.schema[doc_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{doc_id} must be an integer column")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))
    places, first, links = line_links(base, edits, min_chars, every)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = both.join(first.select(F.col("id").alias("b"), F.col("first").alias("of_b")), "b")
    earlier = named.groupBy("a").agg(F.min("of_b").alias("near_first"), F.count(F.lit(1)).alias("n_links"))
    of_line = first.join(earlier.withColumnRenamed("a", "id"), "id", "left")
    of_line = of_line.withColumn("is_near", F.coalesce(F.col("near_first") < F.col("first"), F.lit(False))).where("n > 1 or n_links is not null").select("id", "first", "near_first", "is_near", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # stored, so that both sides of the next join are fresh exchanges and a hot line's places can be split
    of_line = stored(of_line, "repeated")
    all_of = places.join(of_line, "id").withColumn("is_first", _place() == F.col("first"))
    found = all_of.select("doc_id", "text_hash", "number", "n_links", F.expr("long and (not is_first or is_near)").alias("drop"), F.expr("not long and not is_first").alias("short"), F.expr("is_first and is_near").alias("near"), F.when(F.col("is_near"), F.col("near_first")).otherwise(F.col("first")).alias("of"))
    return stored(found.select("doc_id", "text_hash", "number", "n_links", "drop", "short", "near", F.col("of.doc_id").alias("first_doc_id"), F.col("of.number").alias("first_number")).distinct(), "line-decisions")


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The lines to drop: doc_id, text_hash, number, near, first_doc_id, first_number; and the links of each line (line, n_links)."""
    found = _decisions(docs, edits, min_chars, doc_id, text, False)
    return found.where("drop").drop("drop", "short", "n_links"), found.select("doc_id", "text_hash", "number", "n_links")


def _per_document(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("number")).alias("dropped"), F.count_if("near").alias("n_near"), F.min("first_doc_id").alias("first_doc_id"))


def document_report(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_exact, n_near, n_links, class_id (the smallest doc_id whose line it repeats, or its own), dropped, short_repeats.

    n_exact counts the exact repeats of any length; the numbers of those that stay, as they are short, are in short_repeats.
    """
    found = _decisions(docs, edits, min_chars, "doc_id", "text", True)
    numbers = {c: F.sort_array(F.collect_list(F.when(F.col(flag), F.col("number")))).alias(c) for c, flag in (("dropped", "drop"), ("short_repeats", "short"))}
    per = found.where("drop or short").groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(*numbers.values(), F.count_if("near").alias("n_near"), F.min("first_doc_id").alias("first_doc_id"))
    linked = found.groupBy(F.col("doc_id").alias("d2"), F.col("text_hash").alias("h2")).agg(F.sum("n_links").alias("n_links"))
    every = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    out = every.join(per, every.doc_id.eqNullSafe(F.col("d")) & (every.text_hash == F.col("h")), "left").join(linked, every.doc_id.eqNullSafe(F.col("d2")) & (every.text_hash == F.col("h2")), "left")
    none = F.array().cast("array<int>")
    near = F.coalesce("n_near", F.lit(0))
    gone, short = F.coalesce("dropped", none), F.coalesce("short_repeats", none)
    return out.select("doc_id", "n_lines", (F.size(gone) - near + F.size(short)).cast("long").alias("n_exact"), near.cast("long").alias("n_near"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.least(F.coalesce("first_doc_id", "doc_id"), F.col("doc_id")).alias("class_id"), gone.alias("dropped"), short.alias("short_repeats"))


def deduplicated(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text", short_repeats: bool = False) -> DataFrame:
    """``docs`` without their repeated lines; documents of which no character is left go. Columns stay as they are.

    With ``short_repeats`` exact repeats of lines under ``min_chars`` that are not blank go, too.
    """
    found = _decisions(docs, edits, min_chars, doc_id, text, short_repeats)
    drop = found.where("drop or short" if short_repeats else "drop")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # so no name of theirs meets one of ours
    whole = whole.select("row", F.col("row")[doc_id].cast("long").alias("doc_id"), F.col("row")[text].cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    per = _per_document(drop).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "dropped")
    joined = whole.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, k: ~F.array_contains("dropped", k)), "\n")
    joined = joined.withColumn("new", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept))
    return joined.where("dropped is null or trim(new) <> ''").select(*(F.col("new").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
