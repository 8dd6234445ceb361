"""Lines, fences and prose paragraphs of documents (file, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewell.functions.regexes import SPACES, trimmed

_FENCE = f"^[{SPACES}]*```"


def lines(docs: DataFrame, content: str = "content", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """keep, line (from 1), text: cut at line feeds only. A null text has no lines, an empty one has one."""
    return docs.select(*keep, F.posexplode(F.split(content, "\n", -1)).alias("__k", "text")).select(*keep, (F.col("__k") + 1).alias("line"), "text")


#: A fence line of a whole text; ``(?d)``: only a line feed ends a line.
_FENCE_LINE = f"(?md)^[{SPACES.replace('\\n', '')}]*```.*$"


def coded_lines(content: Column) -> Column:
    """array<string> of a text's lines, each behind one more character: ``I`` if inside of a fence, else ``O``.

    A fence line toggles; the opening one is outside, the closing one inside. Linear in the text: it is cut at its
    fence lines, the line feeds of every second piece are coded as inside, and the whole is put together and split again.
    """
    fences = F.regexp_extract_all(content, F.lit(_FENCE_LINE), F.lit(0))
    pieces = F.arrays_zip(F.split(content, _FENCE_LINE, -1).alias("between"), fences.alias("fence"))
    coded = F.transform(pieces, lambda x, k: F.concat(F.replace(x["between"], F.lit("\n"), F.when(k % 2 == 1, "\nI").otherwise("\nO")), F.coalesce(x["fence"], F.lit(""))))
    # texts without a fence are the rule
    whole = F.when(F.contains(content, F.lit("```")), F.array_join(coded, "")).otherwise(F.replace(content, F.lit("\n"), F.lit("\nO")))
    return F.split(F.concat(F.lit("O"), whole), "\n", -1)


def _uncoded(x: Column) -> Column:
    return F.substring(x, 2, 1 << 30)


def fence_states(content: Column) -> Column:
    """array<struct<line, text, fence, inside>> of a text, without a shuffle."""
    return F.transform(coded_lines(content), lambda x, k: F.struct((k + 1).alias("line"), _uncoded(x).alias("text"), _is_fence(x).alias("fence"), F.startswith(x, F.lit("I")).alias("inside")))


def fenced_lines(docs: DataFrame, content: str = "content") -> DataFrame:
    """file, line, text, fence, inside."""
    return docs.select("file", F.inline(fence_states(F.col(content))))


#: Lines that are not prose, after trimming: blank, heading, quote, table, comment, bullets, numbers, breaks, underlines.
STRUCTURAL = [r"^$", r"^#", r"^>", r"^\|", r"^<!--", r"^[-*+] ", rf"^[—–-][{SPACES}]", rf"^[0-9]+[.)][{SPACES}]", r"^={3,}\z"] + [rf"^[{c}][{SPACES}]*([{c}][{SPACES}]*){{2,}}\z" for c in ("—", "–", "_", "*", "-")]


#: What a structural line that is not blank begins with, after trimming; ``rlike`` would try each pattern at every place of the others.
_FIRST = [*"#>|<-*+—–=_0123456789"]


def is_structural(line: Column) -> Column:
    bare = trimmed(line)
    return F.startswith(line, F.lit("    ")) | F.startswith(line, F.lit("\t")) | (bare == "") | (F.substring(bare, 1, 1).isin(*_FIRST) & bare.rlike("|".join(STRUCTURAL)))


def _is_fence(coded: Column) -> Column:
    """Is a line of ``coded_lines`` a fence?"""
    return F.contains(coded, F.lit("```")) & coded.rlike(f"^.[{SPACES}]*```")


#: Digits of a line's number in front of it, while runs are cut.
_PLACES = 10


def prose_runs(content: Column) -> Column:
    """array<struct<start_line, lines, text>>: the maximal runs of prose lines of a text, in order, in linear time.

    A fence line, a fenced line and a structural line each end a run. Such lines become a bare ``S``, prose lines
    get a ``P`` and their number; the text of all is then cut at the ``S`` lines.
    """
    stops = lambda x: F.startswith(x, F.lit("I")) | _is_fence(x) | is_structural(_uncoded(x))
    marked = F.transform(coded_lines(content), lambda x, k: F.when(stops(x), "S").otherwise(F.concat(F.lit("P"), F.lpad((k + 1).cast("string"), _PLACES, "0"), _uncoded(x))))
    runs = F.filter(F.split(F.array_join(marked, "\n"), r"(?:\A|\n)S(?=\n|\z)", -1), lambda x: x != "")
    rows = F.transform(runs, lambda x: F.split(F.when(F.startswith(x, F.lit("\n")), F.substring(x, 2, 1 << 30)).otherwise(x), "\n", -1))
    bare = lambda x: F.substring(x, _PLACES + 2, 1 << 30)
    return F.transform(rows, lambda r: F.struct(F.substring(F.get(r, F.lit(0)), 2, _PLACES).cast("int").alias("start_line"), F.transform(r, bare).alias("lines"), F.array_join(F.transform(r, bare), "\n").alias("text")))


def with_next(runs: Column) -> Column:
    """The runs of a text with ``next_start`` and ``next_text`` of the one behind each."""
    pairs = F.arrays_zip(runs.alias("run"), F.slice(runs, 2, 1 << 30).alias("next"))
    return F.transform(pairs, lambda x: F.struct(x["run"]["start_line"].alias("start_line"), x["run"]["lines"].alias("lines"), x["run"]["text"].alias("text"), x["next"]["start_line"].alias("next_start"), x["next"]["text"].alias("next_text")))


def paragraphs(docs: DataFrame, content: str = "content") -> DataFrame:
    """file, start_line, lines, text, and the next paragraph's start and text: maximal runs of prose lines, without a shuffle."""
    # a generator of one row keeps the runs from being computed again for every use
    once = docs.select("file", prose_runs(F.col(content)).alias("__runs")).select("file", F.explode(F.array("__runs")).alias("__runs"))
    rows = once.select("file", with_next(F.col("__runs")).alias("__runs")).select("file", F.inline_outer("__runs"))
    return rows.where("start_line is not null")  # see textmetrics.each
