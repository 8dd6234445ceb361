"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

A code is the signs of a vector under learned rotations (iterative quantisation: alternate between the
sign codes and the rotation that fits them best, on a bounded sample of ``FIT_ROWS`` vectors, chosen by
the hash of the id). One rotation gives as many bits as dimensions; ``rotations`` of them are learned from
different starts and joined. Codes are cut into 16-bit substrings, each with an index of its own (rows by substring
value). If two codes differ in ``radius`` bits at most, some substring differs in radius / substrings bits
at most (pigeonhole), so probing every index with all values that close retrieves every code within the
radius; the full codes then give the radius, and inner products in double precision give the order.

Queries and index are cut into blocks; every pair of blocks is one task of bounded size (a stated query set
against all rows), which returns at most k rows per query, and a last step keeps the k best. No pairs of
vectors are ever rows of a shuffle. A query for which fewer than k rows lie within the radius is searched
again at the full radius, so it gets k rows or all candidates.

Defined cases: rows with a null id, and vectors that are null, empty, zero or hold a null or non-finite component take no part, as
queries or candidates; so do those whose dimension isn't the index's (the most common one, the smaller if
equal; no inner product with the others is defined). Ties in score go to the smaller id. Equal vectors are
separate candidates. Rows that repeat an id are queries and candidates each for itself: a query leaves out its
own row only. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosewell.llm.common import stored

FIT_ROWS = 20_000
SUBSTRING = 16
QUERY_BLOCK, INDEX_BLOCK = 2_048, 16_384
_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


@dataclass(frozen=True)
class Coder:
    mean: np.ndarray
    rotations: np.ndarray  # [rotations, dimension, dimension]

    @property
    def bits(self) -> int:
        return self.rotations.shape[0] * self.rotations.shape[2]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """uint16 substrings [rows, substrings] of the codes; the last is padded with zeros."""
        bits = np.concatenate([(vectors - self.mean) @ r > 0 for r in self.rotations], axis=1)
        pad = -bits.shape[1] % SUBSTRING
        bits = np.concatenate([bits, np.zeros((len(bits), pad), bool)], axis=1)
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


def learn(sample: np.ndarray, rotations: int = 2, rounds: int = 30) -> Coder:
    """Iterative quantisation from ``rotations`` different starts."""
    d = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(d)
    x = sample - mean
    found = []
    for seed in range(rotations):
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
        for _ in range(rounds if len(x) else 0):
            u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ v).T
        found.append(r)
    return Coder(mean, np.array(found).reshape(rotations, d, d))


class BlockIndex:
    """The substring indexes of a block of codes: each one's distinct values, and the rows of each value."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.values, self.value_of, self.rows, self.bounds = [], [], [], []
        for column in codes.T:
            values, value_of = np.unique(column, return_inverse=True)
            order = np.argsort(value_of, kind="stable")
            self.values.append(values)
            self.value_of.append(value_of)
            self.rows.append(order)
            self.bounds.append(np.searchsorted(value_of[order], np.arange(len(values) + 1)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from ``code`` in ``radius`` bits at most.

        Some substring of such a row differs in radius // substrings bits at most. The values that close are
        looked up one by one while they are few, and picked from the index's own values otherwise.
        """
        reach = min(radius // len(code), SUBSTRING)
        seen = np.zeros(len(self.codes), bool)
        masks = _masks(reach)
        for t, sub in enumerate(code):
            values = self.values[t]
            if len(masks) * 8 < len(values):
                probe = np.sort(masks ^ sub)
                at = np.minimum(np.searchsorted(values, probe), len(values) - 1)
                for k in at[values[at] == probe]:
                    seen[self.rows[t][self.bounds[t][k] : self.bounds[t][k + 1]]] = True
            else:
                seen |= (_POP[values ^ sub] <= reach)[self.value_of[t]]
        rows = np.flatnonzero(seen)
        return rows[_POP[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64) <= radius]


_MASKS: dict[int, np.ndarray] = {}


def _masks(reach: int) -> np.ndarray:
    """All 16-bit masks of at most ``reach`` bits."""
    if reach not in _MASKS:
        _MASKS[reach] = np.flatnonzero(_POP <= reach).astype(np.uint16)
    return _MASKS[reach]


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """row (a number of its own), id and vector (double) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    base = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    base = base.where(F.coalesce(good, F.lit(False)))
    common = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    base = base.select(F.monotonically_increasing_id().alias("row"), "id", "v")
    if common is None:
        return base
    return base.where(F.size("v") == common.d)


def _cells(queries: DataFrame, index: DataFrame, n_queries: int, n_index: int):
    """Rows of both sides, copied to every pair of a query block and an index block."""
    q_blocks, i_blocks = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_index // INDEX_BLOCK))
    q = queries.withColumn("qb", F.expr(f"cast(pmod(xxhash64(row), {q_blocks}) as int)")).withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(i_blocks - 1))))
    i = index.withColumn("ib", F.expr(f"cast(pmod(xxhash64(row, 1), {i_blocks}) as int)")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    return q.select("qb", "ib", "row", "id", "v"), i.select("qb", "ib", "row", "id", "v")


_FOUND = "query_row long, query_id long, row long, vec_id long, score double"


def _searcher(sent, k: int, radius: int | None):
    def run(q, i):
        import pandas as pd

        names = [x.split()[0] for x in _FOUND.split(", ")]
        if not len(q) or not len(i):
            return pd.DataFrame({c: np.zeros(0, np.float64 if c == "score" else np.int64) for c in names})
        coder = sent.value
        ids, own = i["id"].to_numpy(np.int64), i["row"].to_numpy(np.int64)
        order = np.lexsort((own, ids))  # equal scores then stand by id
        ids, own, x = ids[order], own[order], np.stack(i["v"].to_numpy())[order]
        y, q_ids, q_rows = np.stack(q["v"].to_numpy()), q["id"].to_numpy(np.int64), q["row"].to_numpy(np.int64)
        index, codes = BlockIndex(coder.encode(x)), coder.encode(y)
        out: list[list[np.ndarray]] = [[] for _ in names]
        for n, query in enumerate(q_rows):
            rows = index.within(codes[n], coder.bits if radius is None else radius)
            rows = rows[own[rows] != query]
            s = np.einsum("ij,j->i", x[rows], y[n])
            best = np.lexsort((rows, -s))[:k] if len(rows) <= 4 * k else _top(s, k)
            for o, values in zip(out, (np.full(len(best), query), np.full(len(best), q_ids[n]), own[rows[best]], ids[rows[best]], s[best]), strict=True):
                o.append(values)
        return pd.DataFrame({c: np.concatenate(o) for c, o in zip(names, out, strict=True)})

    return run


def _top(s: np.ndarray, k: int) -> np.ndarray:
    """The k largest, ties to the earlier row (rows stand by id)."""
    bound = np.partition(s, len(s) - k)[len(s) - k]
    rows = np.flatnonzero(s >= bound)
    return rows[np.lexsort((rows, -s[rows]))[:k]]


def search(vectors: DataFrame, is_query, k: int = 20, radius: int = 58, rotations: int = 2, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row (``is_query``: SQL on ``id``)."""
    spark = vectors.sparkSession
    every = stored(_usable(vectors, vec_id, embedding), "vectors")
    queries = every.where(is_query)
    n_index, n_queries = every.count(), queries.count()
    sample = every.orderBy(F.xxhash64("id", F.lit(7)), "id", "row").limit(FIT_ROWS).select("v").toArrow()["v"].to_pylist() if n_index else [[0.0]]
    sent = spark.sparkContext.broadcast(learn(np.array(sample, float), rotations))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")

    def found(queries: DataFrame, n: int, radius: int | None) -> DataFrame:
        q, i = _cells(queries, every, n, n_index)
        cells = q.groupBy("qb", "ib").cogroup(i.groupBy("qb", "ib")).applyInPandas(_searcher(sent, k, radius), _FOUND)
        return stored(cells.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "neighbours")

    near = found(queries, n_queries, radius)
    enough = near.where(F.col("rank") == min(k, max(n_index - 1, 0))).select(F.col("query_row").alias("row"))
    few = stored(queries.join(enough, "row", "left_anti"), "few")
    n_few = few.count()
    if n_few and n_index > 1:
        near = near.join(few.select(F.col("row").alias("query_row")), "query_row", "left_anti").unionByName(found(few, n_few, None))
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
