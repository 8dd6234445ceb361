"""The fixed schemas of the audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "tool string, lang string, file string, line int, severity string, category string, quote string, priority string, fp_suppressed boolean, fp_reason string, seq array<int>"
TOOL_RUN = "tool string, lang string, ok boolean, files long, findings long, error string"

#: Tools in the order in which they run, and the languages that each reads.
TOOLS = [
    ("placeholder", ["en", "ru", "ko", "vi", "ja", "es", "th", "my", "id"]),
    ("phrases", ["en", "ru", "ko", "vi", "ja", "es", "th", "my", "id"]),
    ("avoid-ai-writing", ["en"]),
    ("patterns-en", ["en"]),
    ("metrics", ["en"]),
    ("humanizer-ru", ["ru"]),
    ("im-not-ai", ["ko"]),
    ("natural-japanese", ["ja"]),
    ("viet-lint", ["vi"]),
    ("ja-lint", ["ja"]),
    ("ru-structural", ["ru"]),
    ("es-lint", ["es"]),
    ("th-lint", ["th"]),
    ("my-lint", ["my"]),
    ("id-lint", ["id"]),
]
#: Tools whose findings come from outside, as a table.
EXTERNAL = ["avoid-ai-writing", "humanizer-ru", "im-not-ai", "natural-japanese"]
QUOTE = 200


def finding(df: DataFrame, tool: str | Column, lang: str | Column, line: Column | None = None, severity: Column | None = None, category: Column | None = None, quote: Column | None = None, priority: str | Column | None = None, seq: Column | None = None) -> DataFrame:
    """Rows of the finding schema from a frame with ``file`` and the given columns.

    ``seq`` orders the findings of one tool and file (rule, line and occurrence, as the tool goes through them); it is null
    where a finding comes from outside.
    """
    none = F.lit(None)
    text = lambda c: (none if c is None else c).cast("string")
    return df.select(
        (F.lit(tool) if isinstance(tool, str) else tool).alias("tool"),
        (F.lit(lang) if isinstance(lang, str) else lang).alias("lang"),
        F.col("file"),
        (none if line is None else line).cast("int").alias("line"),
        text(severity).alias("severity"),
        text(category).alias("category"),
        text(quote).alias("quote"),
        (priority if isinstance(priority, Column) else F.lit(priority)).cast("string").alias("priority"),
        F.lit(False).alias("fp_suppressed"),
        none.cast("string").alias("fp_reason"),
        (none if seq is None else seq).cast("array<int>").alias("seq"),
    )


def short(quote: Column) -> Column:
    return F.substring(quote, 1, QUOTE)


def weighted(weight: float, high: float = 4) -> str:
    """Severity of a rule by its weight."""
    return "high" if weight >= high else "medium"
