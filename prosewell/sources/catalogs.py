"""Rule catalogs read at run time: JSON with a list ``patterns`` of objects ``name``, ``cat``, ``w`` and ``rx``."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import SparkSession

from prosewell.functions.regexes import general, required

#: Rules become literals of the plan, so a catalog is bounded; larger ones are phrase tables (``operators.dictionary``).
MAX_RULES = 5_000


def compiles(spark: SparkSession, pattern: str) -> str | None:
    """Why the executors' regex engine refuses a pattern, or None."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        return str(getattr(e, "java_exception", e)).split("\n")[0][:300]
    return None


def parse(spark: SparkSession, text: str, source: str = "") -> list[tuple[str, str, float, str]]:
    """The rules (name, category, weight, pattern) of a catalog, in order.

    A rule without a pattern or with one that doesn't compile is dropped with a warning; a missing name is the rule's number, a
    missing category the name, a missing weight 1. Text that isn't such JSON raises ValueError, as do more than ``MAX_RULES`` rules.
    """
    value = json.loads(text)
    if not isinstance(value, dict) or not isinstance(value.get("patterns"), list):
        raise ValueError(f"{source}: no list of patterns")
    if len(value["patterns"]) > MAX_RULES:
        raise ValueError(f"{source}: more than {MAX_RULES} rules")
    rules = []
    for k, rule in enumerate(value["patterns"]):
        rx = rule.get("rx") if isinstance(rule, dict) else None
        name = str(rule.get("name", k)) if isinstance(rule, dict) else str(k)
        try:
            wrong = "no pattern" if not isinstance(rx, str) or not rx else compiles(spark, general(rx))
            if wrong is None:
                required(rx)
        except Exception as e:  # the literals that a match must hold are looked for by another parser
            wrong = str(e)
        if wrong is not None:
            warnings.warn(f"{source}: rule {name} skipped ({wrong})", stacklevel=2)
            continue
        rules.append((name, str(rule.get("cat", name)), float(rule.get("w", 1)), rx))
    return rules


def read(spark: SparkSession, path: str) -> list[tuple[str, str, float, str]]:
    """The rules of a catalog file, from any store of the session."""
    jvm = spark._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(file)
    try:
        return parse(spark, jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"), path)
    finally:
        stream.close()
