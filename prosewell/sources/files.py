"""Markdown files and tables as documents (file, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Path segments whose files are never read.
EXCLUDED = "(^|/)(node_modules|vendors|\\.git|\\.venv)(/|$)"


def excluded(path: Column) -> Column:
    return path.rlike(EXCLUDED)


def true_path(uri: Column) -> Column:
    """The name of a local file as it is, from the encoded form in which Spark gives it; other stores keep their scheme."""
    plain = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))  # a plus sign is no space in a path
    return F.regexp_replace(plain, "^file:/+", "/")


def markdown_files(spark: SparkSession, *paths: str) -> DataFrame:
    """All .md files under the paths (folders or files), each once, as whole texts."""
    frames = []
    for path in paths or (".",):
        reader = spark.read
        if not path.endswith(".md"):
            reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
        frames.append(reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")))
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    out = out.withColumn("file", true_path(F.col("file"))).where(~excluded(F.col("file")))
    return out.dropDuplicates(["file"]) if len(frames) > 1 else out


def table_documents(table: DataFrame, key: str, text: str, prefix: str) -> DataFrame:
    """Rows of a table as documents named <prefix>-<key>.md."""
    return table.select(F.concat(F.lit(f"{prefix}-"), F.col(key).cast("string"), F.lit(".md")).alias("file"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("content"))
