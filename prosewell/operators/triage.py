"""Triage: priority of each finding, then suppression by the first rule that fits."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosewell.catalogs import triage as T
from prosewell.functions.regexes import general
from prosewell.operators.order import kept
from prosewell.schema import FINDING


def is_placeholder(quote: Column) -> Column:
    """Does the quote hold an unfilled placeholder?"""
    out = F.lit(False)
    for pattern, ignore in T.PLACEHOLDERS:
        found = quote.rlike(general(pattern, ignore))
        # a bracket has no case: a quote without one skips the pattern that begins with it
        out = out | ((F.contains(quote, F.lit("[")) & found) if pattern.startswith(r"\[") else found)
    return out


def with_gate(findings: DataFrame, gated: list[DataFrame] | None = None) -> DataFrame:
    """Adds gate_broken: more findings of the gated tool in the file than the gate allows.

    Only that tool's rows are counted; files are joined back, so a file with very many findings of other
    tools is not gathered in one task. ``gated`` has those of the findings among which that tool's are, where that is
    known; without it all findings are made a second time to be counted.
    """
    if gated is not None and not gated:
        return findings.withColumn("gate_broken", F.lit(False))
    counted = findings if gated is None else reduce(DataFrame.unionByName, gated)
    over = counted.where(F.col("tool") == T.GATED_TOOL).groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > T.GATE).select(F.col("file").alias("__file"))
    return findings.join(over, (F.col("file") == F.col("__file")) & (F.col("tool") == T.GATED_TOOL), "left").withColumn("gate_broken", F.col("__file").isNotNull()).drop("__file")


def priority() -> Column:
    """Priority from tool, category, severity, quote and gate_broken; one that is set stays."""
    category, tool = F.coalesce("category", F.lit("")), F.col("tool")
    prefixed = F.lit(False)
    for p in T.P1_PREFIXES:
        prefixed = prefixed | F.startswith(category, F.lit(p))
    mild = ~F.coalesce("severity", F.lit("")).isin("high", "critical")
    return (
        F.when(F.col("priority").isNotNull(), F.col("priority"))
        .when(is_placeholder(F.coalesce("quote", F.lit(""))), "P0")
        .when(category.isin(*T.P1), "P1")
        .when(category.isin(*T.P2), "P2")
        .when(prefixed, "P1")
        .when((tool == T.GATED_TOOL) & mild & ~F.col("gate_broken"), "P2")
        .when(F.col("severity") == "weak", "P2")
        .otherwise("P1")
    )


def glob_regex(pattern: str) -> str:
    """A path glob as an anchored regex: ** any path, * and ? within a segment, a leading **/ also none."""
    table = {"**": ".*", "*": "[^/]*", "?": "[^/]"}

    def one(glob: str) -> str:
        return "".join(table.get(part) or re.escape(part) for part in re.split(r"(\*\*|\*|\?)", glob) if part)

    options = [pattern] + ([pattern[3:]] if pattern.startswith("**/") else [])
    return r"\A(?s:" + "|".join(one(p) for p in options) + r")\z"


def fits(rule: dict) -> Column:
    """Does a suppression rule fit a finding? All of its selectors must."""
    out = F.lit(True)
    for key in ("tool", "category"):
        if rule.get(key):
            out = out & F.coalesce(F.col(key) == rule[key], F.lit(False))
    if rule.get("file"):
        out = out & F.col("file").rlike(glob_regex(rule["file"]))
    if rule.get("quoteContains"):
        out = out & F.contains(F.lower(F.coalesce("quote", F.lit(""))), F.lit(rule["quoteContains"].lower()))
    return out


def suppressed(findings: DataFrame, rules: list[dict]) -> DataFrame:
    """fp_suppressed and fp_reason by the first rule that fits; rules are literals of the plan."""
    if not rules:
        return findings
    reason = F.when(fits(rules[0]), rules[0]["reason"])
    for rule in rules[1:]:
        reason = reason.when(fits(rule), rule["reason"])
    named = findings.withColumn("__reason", reason)
    return named.withColumns({"fp_suppressed": F.col("fp_suppressed") | F.col("__reason").isNotNull(), "fp_reason": F.coalesce("__reason", "fp_reason")}).drop("__reason")


def triage(findings: DataFrame, rules: list[dict] | DataFrame | None = None, gated: list[DataFrame] | None = None, built_in: DataFrame | None = None) -> DataFrame:
    """Findings with priority and suppression, by the built-in rules where none are given.

    Rules are a list or a table (``RULES``); a long list is treated as a table. ``gated`` as in ``with_gate``. ``built_in`` has more
    findings, none of them of the gated tool; they come behind the others and have no part in the join of the gate.
    """
    asked = with_gate(findings, gated)
    if built_in is not None:
        asked = asked.unionByName(with_gate(built_in, []))
    ranked = asked.withColumn("priority", priority()).drop("gate_broken")
    rules = T.SUPPRESS if rules is None else rules
    if isinstance(rules, list) and len(rules) > LITERAL_RULES:
        rules = rule_table(findings.sparkSession, rules)
    return suppressed(ranked, rules) if isinstance(rules, list) else suppressed_by(ranked, rules)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING)


# -- rules as a table --------------------------------------------------------------------------------

RULES = "ord long, file string, tool string, category string, quoteContains string, reason string"
#: So many rules, at most, are literals of the plan.
LITERAL_RULES = 64
_WILD = r"[*?]"


def glob_regex_of(pattern: Column) -> Column:
    """``glob_regex`` of a column of globs."""

    def one(glob: Column) -> Column:
        plain = F.regexp_replace(glob, r"([\\.+^$()\[\]{}|])", r"\\$1")
        # the two stars wait as a character that no regex has
        for mark, regex in ((r"\*\*", "\u0001"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\u0001", ".*")):
            plain = F.regexp_replace(plain, mark, regex)
        return plain

    inner = F.when(F.startswith(pattern, F.lit("**/")), F.concat(F.lit("|"), one(F.substring(pattern, 4, 1 << 30)))).otherwise("")
    return F.concat(F.lit(r"\A(?s:"), one(pattern), inner, F.lit(r")\z"))


#: The selectors that are compared as a whole, by bit.
_WHOLE = ("tool", "category", "file")
#: So many characters of a literal, at most, are looked up.
_ANCHOR = 32


def _literal_of(glob: Column) -> Column:
    """The longest stretch of a glob without wildcards, which each path that fits must hold."""
    bare = F.when(F.startswith(glob, F.lit("**/")), F.substring(glob, 4, 1 << 30)).otherwise(glob)
    pieces = F.transform(F.split(bare, _WILD), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))
    return F.array_max(pieces)["x"]


def rule_rows(rules: DataFrame) -> DataFrame:
    """Rules as they are looked up: ord, reason, tool, category, file, low, glob, bits, side, anchor.

    A file without a wildcard is compared as a whole, a glob becomes a regex. Rules without a reason or without any selector are
    left out; an empty selector is none. Of rules with the same selectors only the first can win, so only it is kept.

    ``side`` is empty where all selectors are compared as a whole. Else it is ``file`` or ``quote``, and a finding that fits must hold
    ``anchor`` there: of the literals of the glob and the quote's part the longer one.
    """
    given = {c: F.nullif(F.col(c), F.lit("")) for c in ("file", "tool", "category", "quoteContains", "reason")}
    rows = rules.select("ord", *(v.alias(k) for k, v in given.items())).withColumn("low", F.lower("quoteContains"))
    rows = rows.where("reason is not null and coalesce(file, tool, category, quoteContains) is not null")
    # equal selectors and places: the smaller reason, as a place is a number of its own in any list
    rows = rows.groupBy("file", "tool", "category", "low").agg(F.min(F.struct("ord", "reason")).alias("first")).select("file", "tool", "category", "low", "first.*")
    wild = F.coalesce(F.col("file").rlike(_WILD), F.lit(False))
    rows = rows.withColumns({"glob": F.when(wild, glob_regex_of(F.col("file"))), "__piece": F.when(wild, _literal_of(F.col("file"))), "file": F.when(~wild, F.col("file"))})
    rows = rows.withColumn("bits", sum((F.col(name).isNotNull().cast("int") * (1 << k) for k, name in enumerate(_WHOLE)), F.lit(0)))
    longer = F.coalesce(F.length("__piece"), F.lit(-1)) >= F.coalesce(F.length("low"), F.lit(-1))
    side = F.when(F.col("glob").isNull() & F.col("low").isNull(), "").when(longer, "file").otherwise("quote")
    anchor = F.when(side == "file", F.col("__piece")).when(side == "quote", F.col("low"))
    return rows.withColumns({"side": side, "anchor": F.substring(anchor, 1, _ANCHOR)}).drop("__piece")


#: Rules of so many bytes, at most, are broadcast.
_SMALL = 4 << 20


def _sized(rules: DataFrame, size: int) -> DataFrame:
    """Rules with the kind of join their measured size asks for.

    Spark's own estimate of stored findings that are cut into parts is far too low: it would broadcast the parts.
    """
    return F.broadcast(rules) if size <= _SMALL else rules.hint("merge")


def _fitting(found: DataFrame, rules: DataFrame, side: str, shapes: list[tuple[int, int]], value: str, size: int = _SMALL + 1, heads: int = _SMALL + 1) -> DataFrame:
    """tool, category, ``value`` and the rules of a side that fit them: list of (ord, reason, low, glob, file) of what is still to be checked.

    Each different (tool, category, value) is looked up once, by its parts of the lengths that anchors of its tool and category have;
    rows, not lists, meet. A part is two hashes, of what it belongs to and of what is looked up; what has met gets its text back and is
    compared in full. ``size``, ``heads``: bytes of the side's rules, and of their tools and categories.
    """
    keys = ["tool", "category", value]
    text = F.col(value)
    # a selector that a rule hasn't is no part of what is compared
    held = lambda k, name: F.when(F.col("bits").bitwiseAND(1 << k) != 0, F.col(name)).otherwise("")
    index = {f"__{name}": held(k, name) for k, name in enumerate(_WHOLE[:2])}
    key = lambda anchor: F.xxhash64("bits", anchor, *index)
    mine = rules.where(F.col("side") == side).withColumns(index)
    lengths = mine.groupBy("bits", *index).agg(F.collect_set(F.length("anchor")).alias("__n"))
    right = mine.select(key(F.col("anchor")).alias("__key"), "ord", "reason", "low", "glob", *(F.col(c).alias(f"r_{c}") for c in _WHOLE))

    some = found.select(*keys).distinct().withColumn("__v", F.xxhash64(*keys))
    asked = some.withColumn("bits", F.explode(F.array(*map(F.lit, sorted({b for b, _ in shapes}))))).withColumns(index).join(_sized(lengths, heads), ["bits", *index])
    # few bytes that become many rows: they stay dealt out
    asked = asked.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__v")
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: key(F.substring(text, i, n)))
    parts = F.array_distinct(F.flatten(F.transform(F.filter("__n", lambda n: n <= F.length(text)), cut)))
    looked_up = asked.select("__v", F.explode(parts).alias("__key"))
    met = looked_up.join(_sized(right, size), "__key").drop("__key").join(some.hint("merge"), "__v")
    for c in _WHOLE[:2]:
        met = met.where(F.col(f"r_{c}").isNull() | F.coalesce(F.col(f"r_{c}") == F.col(c), F.lit(False)))
    if side == "file":
        met = met.where((F.col("glob").isNull() | F.coalesce(F.rlike(text, F.col("glob")), F.lit(False))) & (F.col("r_file").isNull() | (F.col("r_file") == text)))
        left = ["low"]
    else:
        met = met.where(F.contains(text, F.col("low")))
        left = ["glob", "r_file"]
    # of rules that leave the same to be checked only the first can win
    first = met.groupBy(*keys, *left).agg(F.min(F.struct("ord", "reason")).alias("first"))
    return first.groupBy(*keys).agg(F.collect_list(F.struct("first.ord", "first.reason", *left)).alias(f"__by_{side}"))


def suppressed_by(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """``suppressed`` for rules given as a table (``RULES``), of any number: the first that fits, by ``ord``.

    Rules of whole selectors are joined on these, once for each combination that occurs; there is one rule, at most, for each value.
    Globs and parts of quotes are looked up by a literal that what they fit must hold, and then checked as rows, so the work follows the
    findings, the rules and the pairs of them that share such a literal, and not findings times rules. Findings are not grouped.
    """
    rows = rule_rows(rules)
    long = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("tool", "category", "file", "low", "glob", "reason")), F.lit(100)).cast("long")
    each = rows.groupBy("side", "bits", F.length("anchor").alias("n"), "tool", "category").agg(F.sum(long).alias("size"))
    head = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("tool", "category")), F.lit(100)).cast("long")
    sizes = {(r.side, r.bits, r.n or 0): (r.size, r.heads) for r in each.groupBy("side", "bits", "n").agg(F.sum("size").alias("size"), F.sum(head).alias("heads")).collect()}  # some hundreds at most
    shapes = list(sizes)
    quote = F.lower(F.coalesce("quote", F.lit("")))
    if any(side for side, _, _ in shapes):  # they are read for each side and once more
        findings = kept(findings, "ranked")
    out = findings.withColumn("__quote", quote)
    first = []
    for b in sorted({b for side, b, _ in shapes if side == ""}):
        names = [name for k, name in enumerate(_WHOLE) if b >> k & 1]
        mine = rows.where((F.col("side") == "") & (F.col("bits") == b)).select(*names, F.struct("ord", "reason").alias(f"__whole{b}"))
        out = out.join(_sized(mine, sizes["", b, 0][0]), names, "left")
        first.append(F.col(f"__whole{b}"))
    for side, value in (("file", "file"), ("quote", "__quote")):
        mine = sorted((b, n) for s, b, n in shapes if s == side)
        if not mine:
            continue
        fitting = _fitting(out, rows, side, mine, value, *map(sum, zip(*(sizes[side, b, n] for b, n in mine))))
        keys = ["tool", "category", value]
        there = fitting.select(*(F.col(c).alias(f"__r_{c}") for c in keys), f"__by_{side}")
        out = out.join(there, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys], "left").drop(*(f"__r_{c}" for c in keys))
        if side == "file":
            fits = lambda r: r["low"].isNull() | F.contains(F.col("__quote"), r["low"])
        else:
            fits = lambda r: (r["glob"].isNull() | F.coalesce(F.rlike(F.col("file"), r["glob"]), F.lit(False))) & (r["r_file"].isNull() | F.coalesce(r["r_file"] == F.col("file"), F.lit(False)))
        first.append(F.array_min(F.transform(F.filter(f"__by_{side}", fits), lambda r: F.struct(r["ord"].alias("ord"), r["reason"].alias("reason")))))
    if not first:
        return findings
    reason = (first[0] if len(first) == 1 else F.least(*first))["reason"]
    named = out.withColumn("__reason", reason).select(*findings.columns, "__reason")
    return named.withColumns({"fp_suppressed": F.col("fp_suppressed") | F.col("__reason").isNotNull(), "fp_reason": F.coalesce("__reason", "fp_reason")}).drop("__reason")


def rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules of suppression files as a table, in their order."""
    return spark.createDataFrame([(k, *(r.get(c) for c in ("file", "tool", "category", "quoteContains", "reason"))) for k, r in enumerate(rules)], RULES)
