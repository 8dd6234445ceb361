"""The order of a report: languages by their first file, then tool, file, and the order in which the tool goes through it."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosewell.schema import TOOLS


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir``, or persisted (memory and disk) where the session has none."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list, position: str = "position", partitions: int | None = None) -> DataFrame:
    """``df`` with its place (from 1) in the total order of ``keys``.

    A range sort deals the rows out, each partition is sorted and kept, and the rows of the partitions before are added
    to the place within it; what is gathered is one count for each partition.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, part, before = "__at", "__part", "__before"
    rows = kept(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), "sorted").withColumn(part, F.shiftright(at, 33))
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(part, F.coalesce(running, F.lit(0)).alias(before))
    place = F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    # one row for each partition of the sort
    return rows.join(F.broadcast(offsets), part).withColumn(position, place).drop(part, before, at)


def ordinals(findings: DataFrame, buckets: DataFrame, tools: list | None = None) -> DataFrame:
    """``findings`` with lang_first (the first file of the language) and tool_ord; both tables have a row for each language or tool."""
    spark = findings.sparkSession
    names = spark.createDataFrame([(t, k) for k, (t, _) in enumerate(TOOLS if tools is None else tools)], "tool string, tool_ord int")
    return findings.join(F.broadcast(buckets.select("lang", F.col("first_file").alias("lang_first"))), "lang", "left").join(F.broadcast(names), "tool", "left")


#: What an order of findings is made of. Findings from outside have no ``seq`` and stand by line, category and quote.
KEYS = ["lang_first", "lang", "tool_ord", "tool", "file", "seq", "line", "category", "quote", "severity"]


def positions(findings: DataFrame, buckets: DataFrame, tools: list | None = None) -> DataFrame:
    """``findings`` with ``position``: their place, from 1, in the order of a report. Equal findings stand side by side."""
    return numbered(ordinals(findings, buckets, tools), [F.col(c).asc_nulls_first() for c in KEYS]).drop("lang_first", "tool_ord")
