"""Reports of any size as numbered files: nothing but counts reaches the driver, and no task holds a whole report.

Every line of a report is a row (block, at, text). Rows are sorted by range and written in that order, so that the files
by name, put together, are the report; ``_manifest`` beside them lists each file with its first line and number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewell.operators.order import numbered
from prosewell.operators.report import escaped, report_lines

_FIRST, _LAST = -(1 << 62), 1 << 62
SECTIONS = [("P0", "p0", "P0"), ("P1", "p1", "P1"), ("P2", "p2", "P2"), ("suppressed", "fp_suppressed", "Suppressed as documented false positives")]
LINES = "block int, at long, text string"


def _lines(df: DataFrame, block: int, texts: list[str | Column], at: int = 0) -> DataFrame:
    """The texts as lines of a block, for each row of a small table."""
    rows = [F.struct(F.lit(block).alias("block"), F.lit(at + k).cast("long").alias("at"), (F.lit(t) if isinstance(t, str) else t).alias("text")) for k, t in enumerate(texts)]
    return df.select(F.inline(F.array(*rows)))


def markdown_lines(findings: DataFrame, runs: DataFrame, counts: DataFrame, uncertain: DataFrame) -> DataFrame:
    """block, at, text: the lines of ``report.markdown``, of findings with their ``position``, without its bound on a section."""
    n = lambda c: F.col(c).cast("string")
    title = F.concat(F.lit("**P0 (placeholders/broken): "), n("p0"), F.lit(" · P1 (phrase patterns): "), n("p1"), F.lit(" · P2 (structural): "), n("p2"), F.lit(" · FP suppressed: "), n("fp_suppressed"), F.lit(" · tool failures: "), n("tool_failures"), F.lit("**"))
    out = _lines(counts, 0, ["# prosewell report", "", title, ""])
    unsure = uncertain.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    out = out.unionByName(_lines(unsure, 1, [F.concat(F.lit("> ℹ️ Language auto-detect was inconclusive for "), n("n"), F.lit(" file(s); they were scanned with EN tools — use `--lang` to override:"))], _FIRST))
    first = uncertain.orderBy("file").limit(10).select(F.lit(1).alias("block"), F.row_number().over(Window.orderBy("file")).cast("long").alias("at"), F.concat(F.lit("> - "), escaped(F.col("file"))).alias("text"))
    out = out.unionByName(first).unionByName(_lines(unsure, 1, [""], _LAST))
    failed = counts.where("tool_failures > 0")
    out = out.unionByName(_lines(failed, 2, ["> ⚠️ Some scanners failed — this audit is INCOMPLETE (exit 2):"], _FIRST)).unionByName(_lines(failed, 2, [""], _LAST))
    # a row for each tool and language at most
    broken = runs.where("not ok").select(F.lit(2).alias("block"), F.row_number().over(Window.orderBy("tool", "lang")).cast("long").alias("at"), F.concat(F.lit("> - `"), F.col("tool"), F.lit("`: "), F.col("error")).alias("text"))
    out = out.unionByName(broken)
    rows = report_lines(findings)
    block = F.lit(None).cast("int")
    for k, (section, count, name) in enumerate(SECTIONS, 3):
        some = counts.where(F.col(count) > 0)
        out = out.unionByName(_lines(some, k, [F.concat(F.lit(f"## {name} — "), n(count)), ""], _FIRST)).unionByName(_lines(some, k, [""], _LAST))
        block = F.when(F.col("section") == section, k).otherwise(block)
    out = out.unionByName(rows.select(block.alias("block"), F.col("position").cast("long").alias("at"), "text"))
    none = counts.where("p0 + p1 + p2 + fp_suppressed = 0")
    return out.unionByName(_lines(none, 3 + len(SECTIONS), ["No findings. 🎉"]))


#: Fields of a finding in a JSON report.
FIELDS = ["tool", "lang", "file", "line", "severity", "category", "quote", "priority", "fp_suppressed", "fp_reason"]


def json_lines(findings: DataFrame, runs: DataFrame, counts: DataFrame, uncertain: DataFrame) -> DataFrame:
    """block, at, text: the lines of one JSON document, as ``report.as_json`` has it; a comma stands before every item but the first."""

    def items(df: DataFrame, block: int, value: Column, place: Column) -> DataFrame:
        text = F.concat(F.when(place > 1, ",").otherwise(""), value)
        return df.select(F.lit(block).alias("block"), place.cast("long").alias("at"), text.alias("text"))

    value = lambda columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    out = _lines(counts, 0, ['{"schema_version": 1,', '"tool_runs": ['])
    out = out.unionByName(items(runs, 1, value(runs.columns), F.row_number().over(Window.orderBy("tool", "lang"))))
    out = out.unionByName(_lines(counts, 2, ["],", '"findings": [']))
    out = out.unionByName(items(findings, 3, value(FIELDS), F.col("position")))
    out = out.unionByName(_lines(counts, 4, ["],", F.concat(F.lit('"summary": '), value(counts.columns), F.lit(",")), '"language_uncertain": [']))
    quoted = F.substring(F.to_json(F.array(F.col("file"))), 2, 1 << 30)
    unsure = numbered(uncertain.select("file"), [F.col("file")])
    out = out.unionByName(items(unsure, 5, F.regexp_replace(quoted, r"\]\z", ""), F.col("position")))
    return out.unionByName(_lines(counts, 6, ["]", "}"]))


def write_lines(lines: DataFrame, path: str) -> DataFrame:
    """The lines in order as text files under ``path``; returns the manifest (file, first_line, n_lines), which is written, too."""
    spark = lines.sparkSession
    lines.orderBy("block", "at", "text").select("text").write.text(path)
    files = spark.read.text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"))
    # one row for each file; their names begin with their number
    before = F.sum("n_lines").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    manifest = files.select("file", (F.coalesce(before, F.lit(0)) + 1).alias("first_line"), "n_lines")
    manifest.coalesce(1).write.json(f"{path}/_manifest")
    return manifest
