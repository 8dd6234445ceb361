"""All built-in tools of a language in one pass over its documents.

A document becomes one row for itself, one for each line and, where a tool asks for them, one for each paragraph. The
hits of every tool are a column expression over such a row, so one read, one generator and one projection give the
findings of all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewell.catalogs import english, others, phrases
from prosewell.catalogs import metrics as M
from prosewell.functions import textmetrics
from prosewell.functions.regexes import masked
from prosewell.operators import scanners as S
from prosewell.operators.lines import fence_states, prose_runs, with_next
from prosewell.schema import finding

DOCUMENT, LINE, PARAGRAPH = 0, 1, 2
#: Columns of a row. ``__low`` is lower-cased, of the masked text where there is one.
_UNIT = "kind int, line int, text string, __low string, __masked string, inside boolean, lines array<string>, next_start int, next_text string"


def _unit(kind: int, **values: Column) -> Column:
    given = {"kind": F.lit(kind), **values}
    fields = (x.split() for x in _UNIT.split(", "))
    return F.struct(*(given.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in fields))


def _catalog(rules: list, prefix: str = "") -> Column:
    return S.catalog_hits(rules, F.col("text"), F.col("__low"), F.col("line"), prefix)


def _english(lang: str) -> Column:
    gate = (F.length("text") > 2) & F.expr(S.english_gate(english.RULES))
    return F.when(gate, S.english_hits(english.RULES)).otherwise(S.no_hits())


def _spanish(lang: str) -> Column:
    free = F.concat(S.mente_hits(F.col("text"), F.col("__low"), F.col("line")), S.inciso_hits(F.col("text"), F.col("line")))
    return F.concat(_catalog(others.SPANISH, "es:"), F.when(F.col("inside"), S.no_hits()).otherwise(free))


#: Hits of each tool by kind of row, over the columns of ``_rows``.
HITS: dict[str, dict[int, Callable[[str], Column]]] = {
    "placeholder": {LINE: lambda lang: S.placeholder_hits(F.col("text"), F.col("__low"), F.col("line"))},
    "phrases": {DOCUMENT: lambda lang: S.phrase_hits("__low", S.phrase_needles(lang))},
    "patterns-en": {LINE: _english, DOCUMENT: lambda lang: S.lexicon_hits("__low")},
    "metrics": {DOCUMENT: lambda lang: S.metric_hits()},
    "viet-lint": {LINE: lambda lang: S.vietnamese_hits(phrases.VIETNAMESE, F.col("text"), F.col("__low"), F.col("line"))},
    "ja-lint": {LINE: lambda lang: S.japanese_hits(others.JAPANESE, F.col("text"), F.col("line"))},
    "ru-structural": {PARAGRAPH: lambda lang: S.paragraph_hits()},
    "es-lint": {LINE: _spanish, DOCUMENT: lambda lang: S.density_hits()},
    "th-lint": {LINE: lambda lang: _catalog(others.THAI)},
    "my-lint": {LINE: lambda lang: _catalog(others.BURMESE)},
    "id-lint": {LINE: lambda lang: _catalog(others.INDONESIAN)},
}


def _rows(docs: DataFrame, tools: list[str]) -> DataFrame:
    """One row for each document, line and paragraph that the tools ask for, with what they need of the document."""
    base = docs.select("file", "content")
    if "metrics" in tools:
        base = textmetrics.signals(textmetrics.analyze(base, names=textmetrics.SCORED)).select("file", "content", "score", *(f"{k}_points" for k in M.WEIGHTS))
    kinds = {kind for tool in tools for kind in HITS[tool]}
    units = [F.array(_unit(DOCUMENT, __low=F.lower("content")))] if DOCUMENT in kinds else []
    if "es-lint" in tools:
        base = textmetrics.fenced_off(base, base.columns, {"__states": fence_states(F.col("content"))})
        base = textmetrics.fenced_off(base, base.columns, S.density_counts(F.col("__states")))
        units.append(F.transform("__states", lambda x: _unit(LINE, line=x["line"], text=x["text"], __low=F.lower(x["text"]), inside=x["inside"])))
    elif LINE in kinds:
        if "patterns-en" in tools:  # a mask leaves line feeds alone, so the whole text is masked once
            pairs = F.arrays_zip(F.split("content", "\n", -1).alias("x"), F.split(masked(F.col("content")), "\n", -1).alias("m"))
            units.append(F.transform(pairs, lambda p, k: _unit(LINE, line=k + 1, text=p["x"], __low=F.lower(p["m"]), __masked=p["m"])))
        else:
            units.append(F.transform(F.split("content", "\n", -1), lambda x, k: _unit(LINE, line=k + 1, text=x, __low=F.lower(x))))
    if PARAGRAPH in kinds:
        base = textmetrics.fenced_off(base, base.columns, {"__runs": prose_runs(F.col("content"))})
        units.append(F.transform(with_next(F.col("__runs")), lambda p: _unit(PARAGRAPH, line=p["start_line"], text=p["text"], lines=p["lines"], next_start=p["next_start"], next_text=p["next_text"])))
    carried = [c for c in base.columns if c not in ("content", "__states", "__runs")]
    rows = textmetrics.each(base, carried, F.concat(*units), "__u").select(*carried, "__u.*")
    if "patterns-en" in tools:
        rows = textmetrics.fenced_off(rows, rows.columns, {"__literals": F.when((F.col("kind") == LINE) & (F.length("text") > 2), S.english_literals(english.RULES))})
    if PARAGRAPH in kinds:
        rows = rows.withColumn("start_line", F.col("line"))
        rows = textmetrics.fenced_off(rows, rows.columns, {k: F.when(F.col("kind") == PARAGRAPH, v) for k, v in S.paragraph_columns().items()})
    return rows


def _named(tool: str) -> Callable[[Column], Column]:
    return lambda h: F.struct(F.lit(tool).alias("tool"), h["category"].alias("category"), h["severity"].alias("severity"), h["quote"].alias("quote"), h["seq"].alias("seq"))


def fused(docs: DataFrame, lang: str, tools: list[str]) -> DataFrame:
    """Findings of the built-in ``tools`` on documents (file, content) of one language, read once."""
    hits = F.array().cast("array<struct<tool string, category string, severity string, quote string, seq array<int>>>")
    for kind in (DOCUMENT, LINE, PARAGRAPH):
        mine = [F.transform(HITS[tool][kind](lang), _named(tool)) for tool in tools if kind in HITS[tool]]
        if mine:
            hits = F.when(F.col("kind") == kind, F.concat(*mine)).otherwise(hits)
    keep = ("file", "kind", "line")
    rows = textmetrics.each(_rows(docs, tools), keep, hits, "__h").select(*keep, "__h.*")
    # the last place of a paragraph's hit is its line
    line = F.when(F.col("kind") == PARAGRAPH, F.get("seq", F.lit(2))).otherwise(F.col("line"))
    priority = F.when(F.col("tool") == "placeholder", "P0")
    return finding(rows, F.col("tool"), lang, line, F.col("severity"), F.col("category"), F.col("quote"), priority, F.col("seq"))
