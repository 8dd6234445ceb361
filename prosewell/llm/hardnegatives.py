"""Hard-negative mining by a two-dimensional block matrix multiply (SUMMA).

Components become integers, floor(256 * x). Rows are laid out by label and cut into row blocks of a bounded size;
dimensions are cut into chunks. For each anchor block, row block and chunk, one task multiplies the two shards into
a partial tile of int64 scores; partial tiles of a cell are shuffled and added, and the sum is reduced at once to the
few rows that can still be among the first. Two passes: cells of equal labels give each anchor's positives; cells of
different labels give, for each anchor and positive, the best rows inside the window of that positive's score. No score
leaves a cell but those of its first rows, and a last step keeps the first of all cells.

Work and shuffle grow with anchors times rows, a stated query set against all rows, in blocks. As rows lie by label,
the first pass visits only the cells whose labels meet. Partial tiles are shuffled as byte planes of
their zigzag values, of which most are empty and compressed away.

Defined cases: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part;
neither do those whose dimension isn't the most common one (the smaller if equal), as no product with the others is
defined. Ties go to the smaller id. Ids that repeat are rows of their own; an anchor leaves out its own row only. An
anchor without another row of its label, or a positive without a row inside its window, gives no rows. Scores
must fit into 64 bits, 100 times over, or a ValueError is raised. An empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosewell.llm.common import parts, stored

ANCHOR_BLOCK, ROW_BLOCK = 256, 8_192
#: A chunk has so many dimensions at least, and there are so many chunks at most (the partial tiles of a cell that meet in one task).
CHUNK, CHUNKS = 32, 8
SCALE, POSITIVES, NEGATIVES, WINDOW = 256, 5, 5, 80


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """row (a number of its own), id, label and q (array<long>) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    base = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v")).where("id is not null and label is not null and size(v) > 0")
    base = base.where(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)))
    common = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is not None:
        base = base.where(F.size("v") == common.d)
    largest = base.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("x")).first()
    if largest.x is not None and 100.0 * common.d * (largest.x * SCALE + 1) ** 2 >= 2.0**63:
        raise ValueError("scores of these vectors don't fit into 64 bits")
    return base.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("q"))


def laid_out(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``rows`` with ``block``: consecutive rows in the order of label and row, ``size`` to a block; written to the shared folder."""
    sorted_ = stored(rows.repartitionByRange(parts(rows.sparkSession), "label", "row").sortWithinPartitions("label", "row").withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    counts = sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    # one row for each partition of the sort
    placed = sorted_.withColumn("part", part).join(F.broadcast(counts.select("part", F.coalesce("before", F.lit(0)).alias("before"))), "part")
    return placed.withColumn("block", F.floor((F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)) / size).cast("int")).drop("part", "before", "at")


def _planes(tile: np.ndarray) -> bytes:
    """Zigzag values, byte plane by byte plane."""
    z = ((tile << 1) ^ (tile >> 63)).reshape(-1)
    return np.ascontiguousarray(z.view(np.uint8).reshape(-1, 8).T).tobytes()


def _tile(data: bytes) -> np.ndarray:
    z = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)
    return (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64)


_PARTIAL = "ab int, rb int, chunk int, tile binary, a_row array<long>, a_label array<long>, positives array<array<long>>, row array<long>, id array<long>, label array<long>"


def _multiplier(exact: bool):
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in _PARTIAL.split(", ")]
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in names})
        # rows of a shuffled group come in any order: the chunks of a cell must agree on one, or their tiles add up products of different rows
        a, b = a.sort_values("row"), b.sort_values("row")
        x, y = np.stack(a["q"].to_numpy()), np.stack(b["q"].to_numpy())
        # products in double precision are exact below 2**53, and faster
        tile = (x.astype(float) @ y.astype(float).T).astype(np.int64) if exact else x.astype(np.int64) @ y.astype(np.int64).T
        first = int(a["chunk"].iloc[0]) == 0
        told = [list(a["row"]), list(a["label"]), [list(p) for p in a["positives"]], list(b["row"]), list(b["id"]), list(b["label"])]
        return pd.DataFrame([[int(a["ab"].iloc[0]), int(a["rb"].iloc[0]), int(a["chunk"].iloc[0]), _planes(tile), *(told if first else [None] * 6)]], columns=names)

    return run


_BEST = "anchor_row long, positive_at int, row long, id long, score long"


def _reducer(k: int, negatives: bool):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        meta = cell[cell["chunk"] == 0].iloc[0]
        a_row, a_label = np.array(meta["a_row"], np.int64), np.array(meta["a_label"], np.int64)
        row, ids, label = (np.array(meta[c], np.int64) for c in ("row", "id", "label"))
        total = np.zeros(len(a_row) * len(row), np.int64)
        for data in cell["tile"]:
            total += _tile(data)
        total = total.reshape(len(a_row), len(row))
        by_id = np.lexsort((row, ids))
        total, row, ids, label = total[:, by_id], row[by_id], ids[by_id], label[by_id]
        out: list[tuple[np.ndarray, ...]] = []
        for n in range(len(a_row)):
            scores = total[n]
            if negatives:
                other = np.flatnonzero(label != a_label[n])
                s = scores[other]
                for at, positive in enumerate(meta["positives"][n]):
                    fit = np.flatnonzero((WINDOW * positive <= 100 * s) & (s <= positive))
                    best = fit[first_of(s[fit], k)]
                    out.append((np.full(len(best), a_row[n]), np.full(len(best), at), row[other[best]], ids[other[best]], s[best]))
            else:
                same = np.flatnonzero((label == a_label[n]) & (row != a_row[n]))
                best = same[first_of(scores[same], k)]
                out.append((np.full(len(best), a_row[n]), np.zeros(len(best), np.int64), row[best], ids[best], scores[best]))
        return pd.DataFrame({c.split()[0]: np.concatenate([np.zeros(0, np.int64), *(o[i] for o in out)]) for i, c in enumerate(_BEST.split(", "))})

    return run


def first_of(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties to the earlier place."""
    if len(s) > 4 * k:
        bound = np.partition(s, len(s) - k)[len(s) - k]
        some = np.flatnonzero(s >= bound)
        return some[np.argsort(-s[some], kind="stable")[:k]]
    return np.argsort(-s, kind="stable")[:k]


def _shards(rows: DataFrame, dimension: int) -> DataFrame:
    """One row for each row and chunk of dimensions."""
    width = max(CHUNK, -(-dimension // CHUNKS))
    chunks = -(-dimension // width)
    cut = F.explode(F.array(*(F.struct(F.lit(c).alias("chunk"), F.slice("q", c * width + 1, width).alias("q")) for c in range(chunks)))).alias("c")
    return rows.select(*(c for c in rows.columns if c != "q"), cut).select("*", "c.chunk", "c.q").drop("c")


def _spans(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high")).withColumnRenamed("block", name)


def _cells(anchors: DataFrame, rows: DataFrame, negatives: bool) -> DataFrame:
    """Pairs (ab, rb) of blocks with equal labels, or with different ones. Only blocks, not rows, are held against each other."""
    b = _spans(rows, "rb").withColumnsRenamed({"low": "b_low", "high": "b_high"})
    last = rows.agg(F.max("block").alias("n")).first().n
    a = _spans(anchors, "ab").withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(last or 0))))
    apart = (F.col("low") != F.col("high")) | (F.col("b_low") != F.col("b_high")) | (F.col("low") != F.col("b_low"))
    meet = (F.col("low") <= F.col("b_high")) & (F.col("b_low") <= F.col("high"))
    return a.join(b, "rb").where(apart if negatives else meet).select("ab", "rb")


def _best(anchors: DataFrame, rows: DataFrame, dimension: int, exact: bool, k: int, negatives: bool) -> DataFrame:
    """The first k of each anchor (and positive) over all cells, with their rank."""
    cells = stored(_cells(anchors, rows, negatives), "cells")
    a = _shards(anchors, dimension).withColumnRenamed("block", "ab").join(cells, "ab").select("ab", "rb", "chunk", "row", "label", "positives", "q")
    b = _shards(rows, dimension).withColumnRenamed("block", "rb").join(cells, "rb").select("ab", "rb", "chunk", "row", "id", "label", "q")
    key = ["ab", "rb", "chunk"]
    partial = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(_multiplier(exact), _PARTIAL)
    found = partial.groupBy("ab", "rb").applyInPandas(_reducer(k, negatives), _BEST)
    order = Window.partitionBy("anchor_row", "positive_at").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: str, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank. ``is_anchor`` is SQL on ``id``."""
    rows = laid_out(usable(vectors, vec_id, embedding, label), ROW_BLOCK, "rows")
    shape = rows.agg(F.max(F.size("q")).alias("d"), F.max(F.array_max(F.transform("q", F.abs))).alias("m")).first()
    dimension = shape.d or 1
    exact = dimension * float(shape.m or 0) ** 2 < 2.0**53
    anchors = stored(laid_out(rows.where(is_anchor).drop("block"), ANCHOR_BLOCK, "anchors"), "anchors")
    none = F.array().cast("array<long>").alias("positives")
    positives = stored(_best(anchors.select("block", "row", "label", none, "q"), rows, dimension, exact, POSITIVES, False), "positives")
    windows = positives.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("positives"))
    with_windows = anchors.join(windows.withColumnRenamed("anchor_row", "row"), "row").select("block", "row", "label", "positives", "q")
    negatives = _best(with_windows, rows, dimension, exact, NEGATIVES, True)
    named = positives.select("anchor_row", (F.col("rank") - 1).alias("positive_at"), F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(named, ["anchor_row", "positive_at"]).join(anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", "positive_rank")
