"""Parallel reading of small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Rows that come in fewer splits than the session has cores, dealt out to all of them.

    A file of one row group is one split, however many cores there are. Input of as many splits as cores, as
    any large one is, stays as it is and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
