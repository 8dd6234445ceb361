"""Texts that hold several JSON values one after the other, taken apart as column expressions.

In valid JSON nothing but a comma or a closing bracket may follow a closing bracket; so where a value begins right
behind one, outside of strings, the text is cut. A text that is a row of values gives these; one that is broken
inside of a value, or unbalanced, leaves a piece that is no JSON, and the whole text is then broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewell.functions.regexes import SPACES, trimmed

#: Control characters, which no valid JSON holds as they are: a pair of backslashes, an escaped quote, a cut.
_BACKSLASHES, _QUOTE, _CUT = "\u0002", "\u0003", "\u0004"


def pieces(raw: Column) -> Column:
    """array<string>: the text, cut between its values."""
    safe = F.replace(F.replace(raw, F.lit("\\\\"), F.lit(_BACKSLASHES)), F.lit('\\"'), F.lit(_QUOTE))
    parts = F.split(safe, '"', -1)  # every second one is inside of a string
    cut = lambda x: F.regexp_replace(F.regexp_replace(x, rf"([}}\]])[{SPACES}]*(?=[{{\[0-9tfn-])", f"$1{_CUT}"), rf"([}}\]])[{SPACES}]*\z", f"$1{_CUT}")
    marked = F.array_join(F.transform(parts, lambda x, k: F.when(k % 2 == 0, cut(x)).otherwise(x)), '"')
    whole = F.replace(F.replace(marked, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASHES), F.lit("\\\\"))
    return F.filter(F.transform(F.split(whole, _CUT, -1), trimmed), lambda x: x != "")


def strictly(piece: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else, or null.

    The parser stops behind the first value; so the text is parsed as the only item of an array, with a hash of it, which it can't
    foresee, behind.
    """
    mark = F.xxhash64(piece)
    v = F.try_parse_json(F.concat(F.lit("[["), piece, F.lit("],"), mark.cast("string"), F.lit("]")))
    items = F.try_variant_get(v, "$[0]", "array<variant>")
    return F.when((F.try_variant_get(v, "$[1]", "bigint") == mark) & (F.size(items) == 1), F.get(items, F.lit(0)))


def concatenated(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``values`` array<string> and ``error``: broken or null texts give no values, and broken ones say why.

    Arrays at the top are taken apart. Values are compact JSON with the keys of objects in order. A value without brackets
    (a number, a string, a name) can only be the last one. A text with a control character as it is, and an object that
    repeats a key, are broken. Columns of these names are replaced; an empty text has no values.
    """
    kept = [c for c in df.columns if c not in ("values", "error")]
    raw = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    some = ~raw.rlike(f"[{_BACKSLASHES}{_QUOTE}{_CUT}]")
    parsed = F.transform(pieces(raw), strictly)
    # a generator of one row keeps a text from being parsed once for each use
    once = df.select(*(F.col(f"`{c}`") for c in kept), F.inline(F.array(F.struct(F.when(some, parsed).alias("__parsed")))))
    items = lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x))).otherwise(F.array(F.to_json(v)))
    broken = F.col("__parsed").isNull() | F.exists("__parsed", lambda v: v.isNull())
    values = F.when(broken, F.array().cast("array<string>")).otherwise(F.flatten(F.transform("__parsed", items)))
    at = F.array_position(F.transform("__parsed", lambda v: v.isNull()), True)
    error = F.when(F.col("__parsed").isNull(), "unbalanced JSON: a control character").when(broken, F.concat(F.lit("unbalanced JSON: value "), at.cast("string")))
    return once.select(*(F.col(f"`{c}`") for c in kept), values.alias("values"), error.alias("error"))
