"""Rule patterns for Spark: boundaries, white space and case as the rules mean them, and literals that a match must hold.

Rules mean ASCII words at ``\\b``, all Unicode spaces at ``\\s`` and full case folding. Spark's regex
engine takes ``\\b`` as Unicode and ``\\s`` as ASCII, so patterns are rewritten once, on the driver:

* English rules run on masked text (see ``masked``), where plain ``\\b`` is right and cheap;
* other rules get ASCII look-arounds for ``\\b``.

``required`` finds substrings of which a match must hold one; a line without any of them skips the regex.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the rules mean it, as the inside of a character class.
SPACES = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Non-ASCII letters, digits and marks would be word characters to Spark.
_MASKED = r"[[^\x00-\x7F\uFE0F]&&[\p{L}\p{N}\p{Mn}]]"
_FLAGS = re.compile(r"\(\?([a-z]+)\)")


def masked(text: Column) -> Column:
    """Text of the same length in which only ASCII characters are word characters."""
    return F.regexp_replace(text, _MASKED, "\uFFFC")


#: The characters of ``SPACES``, one by one.
WHITE = "\t\n\x0B\f\r \u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000\uFEFF"


def trimmed(text: Column) -> Column:
    """Text without white space at its ends; only the ends are looked at, where a regex would be tried at every place."""
    return F.btrim(text, F.lit(WHITE))


def trimmed_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITE))


def collapsed(text: Column) -> Column:
    """Each run of white space as one space; single spaces, the rule, are not replaced by themselves."""
    return F.regexp_replace(text, f"[{SPACES.replace(' ', '')}][{SPACES}]*| [{SPACES}]+", " ")


def flags_of(pattern: str) -> tuple[str, set[str]]:
    """The pattern without its inline flags, and the flags."""
    found = {c for m in _FLAGS.finditer(pattern) for c in m[1]}
    return _FLAGS.sub("", pattern), found


def _spaces(pattern: str) -> str:
    """``\\s`` as the full set, inside and outside of character classes."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out.append(SPACES if inside else f"[{SPACES}]")
            k += 2
            continue
        if two[0] == "\\":
            out.append(two)
            k += 2
            continue
        inside = two[0] == "[" or (inside and two[0] != "]")
        out.append(two[0])
        k += 1
    return "".join(out)


def english(pattern: str) -> str:
    """A rule for masked English lines: any case, the first match on a line counts."""
    body, _ = flags_of(pattern)
    return "(?i)" + body


def general(pattern: str, ignore_case: bool | None = None) -> str:
    """A rule for unmasked lines; ``\\b`` becomes a pair of ASCII look-arounds."""
    body, flags = flags_of(pattern)
    word = "[A-Za-z0-9_]"
    body = body.replace(r"\b", f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))")
    ignore = "i" in flags if ignore_case is None else ignore_case
    return ("(?iu)" if ignore else "") + _spaces(body)


def _sets(tree) -> list[set[str] | None]:
    """For each stretch of a parsed sequence: literals of which a match must hold one, or None."""
    out, run = [], ""

    def close():
        nonlocal run
        if run:
            out.append({run})
        run = ""

    for op, arg in tree:
        if op is sre.LITERAL:
            run += chr(arg).lower()
            continue
        close()
        if op is sre.SUBPATTERN:
            out.append(_best(arg[3]))
        elif op is sre.BRANCH:
            branches = [_best(b) for b in arg[1]]
            out.append(None if any(b is None for b in branches) else set().union(*branches))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            out.append(_best(arg[2]))
    close()
    return out


def _best(tree) -> set[str] | None:
    """The set whose shortest literal is the longest."""
    found = [s for s in _sets(tree) if s]
    return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def required(pattern: str) -> list[str] | None:
    """Lower-case literals of which every match holds one, or None if there are none."""
    body, _ = flags_of(pattern)
    found = _best(_parser.parse(body.replace(r"\z", "$")))
    return sorted(found) if found else None


def holds_one(lowered: Column, literals: list[str] | None) -> Column:
    """Does the lower-cased text hold one of the literals? True where there is nothing to ask."""
    if not literals:
        return F.lit(True)
    if len(literals) > 8:  # a loop over a constant array keeps the generated code small
        return F.exists(F.array(*map(F.lit, literals)), lambda x: F.contains(lowered, x))
    out = F.contains(lowered, F.lit(literals[0]))
    for x in literals[1:]:
        out = out | F.contains(lowered, F.lit(x))
    return out


def literal(text: str) -> str:
    """A text as a Spark SQL literal; catalogs of many rules are built as one SQL expression, which plans far faster."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def holds_one_sql(lowered: str, literals: list[str] | None) -> str:
    """``holds_one`` as SQL."""
    if not literals:
        return "true"
    if len(literals) > 8:
        return f"exists(array({', '.join(map(literal, literals))}), x -> contains({lowered}, x))"
    return "(" + " OR ".join(f"contains({lowered}, {literal(x)})" for x in literals) + ")"


def _trie(literals: list[str], crowded: int = 6) -> str:
    """A regex of the longest of the literals that stand at a place, by their common beginnings."""
    heads: dict[str, list[str]] = {}
    for x in literals:
        if x:
            heads.setdefault(x[0], []).append(x[1:])
    options = [(c, re.escape(c) + (_trie(rest) if rest != [""] else "")) for c, rest in sorted(heads.items())]
    if len(options) > crowded:  # branches are tried one after the other, so many of them stand behind classes
        groups = [options[k : k + crowded] for k in range(0, len(options), crowded)]
        found = [f"(?=[{''.join(re.escape(c) for c, _ in g)}])(?:{'|'.join(x for _, x in g)})" for g in groups]
    else:
        found = [x for _, x in options]
    return f"(?:{'|'.join(found + ([''] if '' in literals else []))})"


def literals_sql(lowered: str, literals: list[str]) -> str:
    """array<string>: at each place of the lower-cased text the longest of the literals that stands there, all in one pass."""
    return f"array_distinct(regexp_extract_all({lowered}, {literal('(?=(' + _trie(literals) + '))')}, 1))"


def holds_one_of_sql(found: str, wanted: list[str], literals: list[str]) -> str:
    """``holds_one_sql`` on the array of ``literals_sql``: a literal is there if one that begins with it was found."""
    return f"arrays_overlap({found}, array({', '.join(literal(x) for x in literals if x.startswith(tuple(wanted)))}))"


def occurrences_sql(text: str, needle: str) -> str:
    """``occurrences`` as SQL."""
    n = literal(needle)
    return f"CASE WHEN contains({text}, {n}) THEN CAST((length({text}) - length(replace({text}, {n}, ''))) / {len(needle)} AS INT) ELSE 0 END"


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return F.when(F.contains(text, F.lit(needle)), ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")).otherwise(0)
