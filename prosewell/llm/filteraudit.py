"""Filter interaction audit: which of several filters removes what, in every order in which they can stand.

Fingerprint-routed RDD: a task turns each document into a mask of the filters that it fails, and keeps, by
the xxhash of its text, chains of (full text, smallest id, rows); equal hashes of different texts stay apart in the
chain. Where two rows of one text meet, the one of the larger id is emitted at once, with the mark of a repeat;
what is left at the end (one entry for each text) goes to the partition of its hash, where the chains of all tasks meet
in the same way. So a text that a third of the rows share leaves each task once, and no list of ids is ever
gathered. Filters are only evaluated for an entry's text, masks are then merged by ``combineByKey`` into one
vector of counts for each part: 32 masks by all, good and toxic. All orders of the filters follow from that vector.

Bounds: a map task sends its chains on when they hold ``CHAIN_BYTES`` of text; the number of partitions that meet
follows the bytes of the documents (``PARTITION_BYTES`` each), which a first reading of their lengths gives.

Defined cases: a null text is empty. Ids that repeat: a row is a repeat only if a row of a smaller id has its text, so rows
that share the smallest id are none. A null id is neither smaller nor larger than any: such rows are no repeats and
make none. A null part is the empty string, one part with it. Labels: an id counts as good or toxic if any of its label rows says 1;
a null id has no labels. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewell.llm.common import parts, stored

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
CHAIN_BYTES, PARTITION_BYTES = 32_000_000, 32_000_000
#: Counts of a vector: masks by (all, good, toxic).
_KINDS = 3
_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"


def mask_of(text: bytes) -> int:
    """The filters A to D that a text (UTF-8) fails, as bits."""
    words = text.split()  # bytes are split at 09-0D and 20 only
    n = len(words)
    size = len(text.translate(None, _CONTINUED))
    upper = len(text) - len(text.translate(None, _UPPER))
    return (n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * upper > 10 * size) << 2 | (len(text.translate(None, _MARKS)) < len(text)) << 3


class Chains:
    """Entries [text, mask, id, {part: rows}] by fingerprint; ``meet`` gives the rows that lose to a smaller id.

    Rows with a null id never meet others: they leave as they come.
    """

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.bytes = 0

    def meet(self, key: int, text: bytes, mask: int | None, doc_id: int, rows: dict[str, int]):
        for entry in self.chains.setdefault(key, []):
            if entry[0] == text:
                if doc_id == entry[2]:
                    for part, n in rows.items():
                        entry[3][part] = entry[3].get(part, 0) + n
                    return
                gone_id, gone = doc_id, rows
                if doc_id < entry[2]:
                    gone_id, gone = entry[2], entry[3]
                    entry[2], entry[3] = doc_id, dict(rows)
                for part, n in gone.items():
                    yield gone_id, part, entry[1] | REPEAT, n
                return
        self.chains[key].append([text, mask_of(text) if mask is None else mask, doc_id, dict(rows)])
        self.bytes += len(text) + 200

    def entries(self):
        for key, chain in self.chains.items():
            for entry in chain:
                yield key, entry
        self.chains, self.bytes = {}, 0


def _route(rows):
    """(key, entry) of each text of the task, and (key, row) of what is already known to be a repeat."""
    held, turn = Chains(), 0  # rows that are done are dealt out in turn
    for doc_id, part, text in rows:
        raw, turn = text.encode(), turn + 1
        if doc_id is None:
            yield turn, (None, part, mask_of(raw), 1)
            continue
        for gone in held.meet(xxhash.xxh64_intdigest(raw), raw, None, doc_id, {part: 1}):
            yield turn, gone
        if held.bytes > CHAIN_BYTES:
            for key, entry in held.entries():
                yield key, (entry,)
    for key, entry in held.entries():
        yield key, (entry,)


def _resolve(records):
    """(id, part, mask, rows) of all rows that came to a partition: emitted ones as they are, entries by their chains."""
    held = Chains()
    for key, record in records:
        if len(record) > 1:
            yield record
        else:
            yield from held.meet(key, *record[0])
    for _, (_, mask, doc_id, rows) in held.entries():
        for part, n in rows.items():
            yield doc_id, part, mask, n


def _partition(key: int) -> int:
    return key


_MASKS = "doc_id long, part string, mask int, n long"


def masks(docs: DataFrame, part: str = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, part, mask (bits in the order of ``FILTERS``), n: the documents with the filters that each fails; n equal rows are one."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    size = texts.agg(F.sum(F.octet_length("__text").cast("long") + 200).alias("n")).first().n or 0
    n = max(parts(spark), -(-size // PARTITION_BYTES))
    found = texts.rdd.mapPartitions(_route).partitionBy(n, _partition).mapPartitions(_resolve)
    return spark.createDataFrame(found, _MASKS, verifySchema=False)


def _vector(item) -> np.ndarray:
    return _merge_value(np.zeros((_KINDS, 1 << len(FILTERS)), np.int64), item)


def _merge_value(vector: np.ndarray, item) -> np.ndarray:
    mask, n, good, toxic = item
    vector[0, mask] += n
    vector[1, mask] += n * good
    vector[2, mask] += n * toxic
    return vector


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def orders(vector: np.ndarray):
    """filter_order, step and the counts of every step of every order, from the counts by mask."""
    every = np.arange(1 << len(FILTERS))
    fails = {f: (every >> k & 1).astype(bool) for k, f in enumerate(FILTERS)}
    total, good, toxic = vector
    all_orders = ["".join(p) for p in permutations(FILTERS)]
    steps, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in all_orders:
        gone = np.zeros(len(every), bool)
        for step, f in enumerate(order, 1):
            here = fails[f] & ~gone
            redundant, gone = fails[f] & gone, gone | here
            removed = int(total[here].sum())
            shapley[f] += removed
            steps.append((order, step, int(total[~gone].sum()), removed, int(total[redundant].sum()), int(total[1 << FILTERS.index(f)]), int(good[here].sum()), int(toxic[here].sum())))
    for row in steps:
        yield (*row, shapley[row[0][row[1] - 1]])


_AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each part, order of the filters and step. ``labels`` has (id, quality, toxic)."""
    spark = docs.sparkSession
    rows = stored(masks(docs, part, text, doc_id), "masks").groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    flags = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int").alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int").alias("toxic"))
    flags = flags.where("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    joined = rows.join(flags, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    vectors = joined.rdd.map(lambda r: (r[0], (r[1], r[2], r[3], r[4]))).combineByKey(_vector, _merge_value, _merge, parts(spark))
    found = vectors.flatMap(lambda kv: ((kv[0], *row) for row in orders(kv[1])))
    return spark.createDataFrame(found, _AUDIT, verifySchema=False)
