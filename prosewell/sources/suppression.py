"""Suppression rules from a small YAML subset: a top-level ``suppress:`` list of flat blocks."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import SparkSession

KEYS = ("file", "tool", "category", "quoteContains", "reason")
SELECTORS = KEYS[:4]


def parse(text: str, source: str = "") -> list[dict]:
    """Rules in order. A block without a reason is dropped with a warning, one without a selector silently."""
    rules: list[dict] = []
    block: dict | None = None
    inside = False

    def close() -> None:
        nonlocal block
        done, block = block, None
        if done is None:
            return
        if not done.get("reason"):
            warnings.warn(f"{source}: suppression block without reason skipped ({done})", stacklevel=3)
        elif any(done.get(k) for k in SELECTORS):
            rules.append(done)

    def put(entry: str) -> None:
        found = re.match(r"(\w+)\s*:\s*(.*)$", entry)
        if not found or block is None:
            return
        if found[1] not in KEYS:
            warnings.warn(f'unknown suppression key "{found[1]}" ignored', stacklevel=3)
            return
        block[found[1]] = re.sub(r"^[\"']|[\"']$", "", found[2])

    for raw in text.split("\n"):
        line = raw.removesuffix("\r")
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if not line[0].isspace() and not line.startswith("-"):
            inside = re.match(r"suppress\s*:", line) is not None
        elif inside and bare.startswith("-"):
            close()
            block = {}
            put(bare[1:].strip())
        elif inside:
            put(bare)
    close()
    return rules


def load(*texts: tuple[str, str] | None) -> list[dict]:
    """Rules of several (source, text) pairs in order; a missing one (None) is skipped."""
    return [rule for pair in texts if pair is not None for rule in parse(pair[1], pair[0])]


#: Name of a project's own rules, in the folder that is audited.
PROJECT_FILE = ".prosewell.yaml"


def read(spark: SparkSession, *paths: str) -> list[dict]:
    """Rules of the files that are there, in order, from any store of the session. Rules are small: they become literals of the plan.

    Spark's readers skip names that begin with a dot, so the file is opened through the file system itself.
    """
    jvm, found = spark._jvm, []
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if system.exists(path):
            stream = system.open(path)
            try:
                found.append((name, jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return load(*found)
