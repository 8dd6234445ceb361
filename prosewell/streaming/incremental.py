"""The audit over files as they arrive: scanning is stateless per document, so each micro-batch is an audit of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prosewell.functions import language
from prosewell.operators.triage import triage
from prosewell.plans.audit import scan
from prosewell.sources.files import excluded, true_path


def watch(spark: SparkSession, path: str) -> DataFrame:
    """New .md files under a folder as a stream of documents (file, content)."""
    reader = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
    rows = reader.text(path, wholetext=True).select(true_path(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("content"))
    return rows.where(~excluded(F.col("file")))


def audit_stream(docs: DataFrame, out: str, checkpoint: str, rules: list[dict] | None = None, langs: list[str] | None = None, once: bool = False) -> StreamingQuery:
    """Appends the triaged findings of each micro-batch to ``out`` as Parquet, one folder per batch.

    A batch that runs again after a failure replaces its own folder, so no finding is written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        found = triage(scan(language.detect(kept), langs), rules, [])
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        kept.unpersist()

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
