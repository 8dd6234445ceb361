"""Tool runs, summary, exit status and report lines."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewell.schema import EXTERNAL, TOOLS

NOT_AVAILABLE = "scanner not available (its findings come from outside and none were given)"


def dispatch(spark: SparkSession, more: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """tool, lang, tool_ord: which tool reads which language, in order; tools of one's own (``more``) come last."""
    return spark.createDataFrame([(t, lang, k) for k, (t, langs) in enumerate([*TOOLS, *more]) for lang in langs], "tool string, lang string, tool_ord int")


def failed_run(error: Column) -> Column:
    """The error of a run, at most 300 characters."""
    return F.substring(error, 1, 300)


def without_failed(findings: DataFrame, failures: DataFrame) -> DataFrame:
    """Findings without those of the failed runs (tool, lang, error); there are as many runs as tools and languages at most."""
    failed = F.broadcast(failures.select(F.col("tool").alias("failed_tool"), F.col("lang").alias("failed_lang")).distinct())
    return findings.join(failed, (F.col("tool") == F.col("failed_tool")) & (F.col("lang") == F.col("failed_lang")), "left_anti")


def run_states(buckets: DataFrame, given: list[str] = (), failures: DataFrame | None = None, more: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """tool, lang, ok, files, error: the runs of ``tool_runs`` without their findings, which then need not be made."""
    runs = buckets.select("lang", "files").join(F.broadcast(dispatch(buckets.sparkSession, more)), "lang")
    missing = [t for t in EXTERNAL if t not in given]
    error = F.when(F.col("tool").isin(*missing), F.lit(NOT_AVAILABLE)) if missing else F.lit(None).cast("string")
    if failures is not None:
        runs = runs.join(failures.select("tool", "lang", failed_run(F.col("error")).alias("__error")), ["tool", "lang"], "left")
        error = F.coalesce("__error", error)
    return runs.withColumn("error", error).select("tool", "lang", F.col("error").isNull().alias("ok"), F.col("files").cast("long").alias("files"), "error")


def tool_runs(buckets: DataFrame, findings: DataFrame, given: list[str] = (), failures: DataFrame | None = None, more: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """tool, lang, ok, files, findings, error: a run per language of the corpus and tool that reads it.

    Tools from outside that aren't in ``given`` have failed; so has a (tool, lang) with a row in ``failures``
    (tool, lang, error), whose findings then don't count.
    """
    counts = findings.groupBy("tool", "lang").agg(F.count(F.lit(1)).alias("n"))
    runs = run_states(buckets, given, failures, more).join(counts, ["tool", "lang"], "left")
    return runs.select("tool", "lang", "ok", "files", F.when(F.col("ok"), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("findings"), "error")


def summary(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: p0, p1, p2, fp_suppressed, tool_failures, exit_code. Of the runs (``tool_runs`` or ``run_states``) only ``ok`` is read."""
    open_ = ~F.col("fp_suppressed")
    counts = findings.agg(*(F.count_if(open_ & (F.col("priority") == p)).alias(p.lower()) for p in ("P0", "P1", "P2")), F.count_if("fp_suppressed").alias("fp_suppressed"))
    failures = runs.agg(F.count_if(~F.col("ok")).alias("tool_failures"))
    # two single rows side by side
    both = counts.withColumn("__one", F.lit(1)).join(failures.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return both.withColumn("exit_code", exit_code())


def exit_code() -> Column:
    """2 for an incomplete audit, 1 for open P0 or P1 findings, else 0."""
    return F.when(F.col("tool_failures") > 0, 2).when(F.col("p0") + F.col("p1") > 0, 1).otherwise(0)


#: What markdown reads as a mark.
MARKS = "*_`#>|"


def escaped(text: Column) -> Column:
    """Text that markdown shows as it is, on one line. Plain replacements: most texts hold no mark, which is seen without a regex."""
    out = F.coalesce(text, F.lit(""))
    broken = F.contains(out, F.lit("\n")) | F.contains(out, F.lit("\r"))
    out = F.when(broken, F.regexp_replace(out, r"[\n\r]+", " ⏎ ")).otherwise(out)
    for mark in MARKS:
        out = F.replace(out, F.lit(mark), F.lit(f"\\{mark}"))
    return out


def finding_line() -> Column:
    """The report line of an open finding."""
    place = F.concat(escaped(F.col("file")), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))
    severity = F.when(F.coalesce("severity", F.lit("")) != "", F.concat(F.lit(" "), escaped(F.col("severity")))).otherwise("")
    return F.concat(F.lit("- **"), place, F.lit("** [`"), escaped(F.col("tool")), F.lit("`/`"), escaped(F.coalesce("category", F.lit("?"))), F.lit("`"), severity, F.lit("] "), escaped(F.col("quote")))


def suppressed_line() -> Column:
    return F.concat(F.lit("- "), escaped(F.col("file")), F.lit(" [`"), escaped(F.col("tool")), F.lit("`/`"), escaped(F.coalesce("category", F.lit("?"))), F.lit("`]: "), escaped(F.col("fp_reason")))


def report_lines(findings: DataFrame) -> DataFrame:
    """section (P0, P1, P2, suppressed), the sort keys of a report, and text, one row per finding.

    Sorting is left to the sink: by ``position`` (``order.positions``) where it is there, else lang, tool, file, category, line, quote.
    """
    section = F.when(F.col("fp_suppressed"), "suppressed").otherwise(F.col("priority"))
    place = ["position"] if "position" in findings.columns else []
    return findings.select(section.alias("section"), *place, "lang", "tool", "file", "category", "line", "quote", F.when(F.col("fp_suppressed"), suppressed_line()).otherwise(finding_line()).alias("text"))


def _order(findings: DataFrame) -> list[str]:
    return ["position"] if "position" in findings.columns else ["lang", "tool", "file", "line", "category", "quote"]


def write_report(findings: DataFrame, path: str) -> None:
    """The report's lines as sorted text files: a range sort, so no task holds the whole report."""
    rows = report_lines(findings).orderBy("section", *_order(findings))
    rows.select("text").write.text(path)


def write_json(findings: DataFrame, runs: DataFrame, counts: DataFrame, path: str) -> None:
    """The report as JSON lines in three folders: findings, tool_runs, summary."""
    for name, df in (("findings", findings.drop("seq")), ("tool_runs", runs), ("summary", counts)):
        df.write.json(f"{path}/{name}")


def markdown(findings: DataFrame, runs: DataFrame, counts: DataFrame, uncertain: DataFrame, most: int = 1000) -> str:
    """The whole report as one text, for small audits; each section shows ``most`` lines at most and says so.

    ``sinks.markdown_lines`` has no such bound.
    """
    s = counts.first()
    out = ["# prosewell report", ""]
    out += [f"**P0 (placeholders/broken): {s.p0} · P1 (phrase patterns): {s.p1} · P2 (structural): {s.p2} · FP suppressed: {s.fp_suppressed} · tool failures: {s.tool_failures}**", ""]
    n = uncertain.count()
    if n:
        out.append(f"> ℹ️ Language auto-detect was inconclusive for {n} file(s); they were scanned with EN tools — use `--lang` to override:")
        out += [f"> - {r.f}" for r in uncertain.orderBy("file").limit(10).select(escaped(F.col("file")).alias("f")).collect()] + [""]
    if s.tool_failures:
        out.append("> ⚠️ Some scanners failed — this audit is INCOMPLETE (exit 2):")
        out += [f"> - `{r.tool}`: {r.error}" for r in runs.where("not ok").orderBy("tool", "lang").collect()] + [""]
    rows = report_lines(findings)
    for section, title in (("P0", "P0"), ("P1", "P1"), ("P2", "P2"), ("suppressed", "Suppressed as documented false positives")):
        total = {"P0": s.p0, "P1": s.p1, "P2": s.p2, "suppressed": s.fp_suppressed}[section]
        if total:
            shown = rows.where(F.col("section") == section).orderBy(*_order(findings)).limit(most).collect()
            out += [f"## {title} — {total}", "", *(r.text for r in shown), *([f"… and {total - most} more"] if total > most else []), ""]
    if not s.p0 + s.p1 + s.p2 + s.fp_suppressed:
        out.append("No findings. 🎉")
    return "\n".join(out)


def as_json(findings: DataFrame, runs: DataFrame, counts: DataFrame, uncertain: DataFrame) -> str:
    """The whole report as one JSON text, for small audits; ``sinks.json_lines`` has no such bound."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    return json.dumps({"schema_version": 1, "tool_runs": rows(runs), "findings": rows(findings.orderBy(*_order(findings)).drop("position", "seq")), "summary": counts.first().asDict(), "language_uncertain": [r.file for r in uncertain.orderBy("file").collect()]}, ensure_ascii=False, indent=2)
