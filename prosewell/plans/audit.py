"""The audit: documents to language, findings, triage, runs and summary, as one set of plans."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewell.catalogs.languages import LANGS
from prosewell.functions import language
from prosewell.operators import report
from prosewell.operators.order import positions
from prosewell.operators.registry import Registry
from prosewell.operators.scanners import union
from prosewell.operators.triage import triage
from prosewell.plans.fused import HITS, fused
from prosewell.schema import TOOLS
from prosewell.sources.splits import spread


@dataclass
class Audit:
    """Lazy results: documents with language, triaged findings, runs, summary, uncertain files.

    ``documents`` (unless their language is given) and ``findings`` are stored in a work folder, or persisted (memory
    and disk) where there is none; ``close`` lets persisted ones go.
    """

    documents: DataFrame
    findings: DataFrame
    runs: DataFrame
    summary: DataFrame
    uncertain: DataFrame
    buckets: DataFrame
    tools: list

    def ordered(self) -> DataFrame:
        """The findings with their ``position`` in the order of a report."""
        return positions(self.findings, self.buckets, self.tools)

    def close(self) -> None:
        self.documents.unpersist()
        self.findings.unpersist()


def scan(documents: DataFrame, langs: list[str] | None = None, tools: list[str] | None = None) -> DataFrame:
    """Findings of the built-in scanners on documents (file, content, lang); each document is read once, by all tools of its language."""
    asked = [(lang, [tool for tool, reads in TOOLS if tool in HITS and lang in reads and (tools is None or tool in tools)]) for lang in (LANGS if langs is None else langs)]
    asked = [(lang, mine) for lang, mine in asked if mine]
    # building and analysing a plan of so many rules takes longer than starting it: languages side by side
    with ThreadPoolExecutor(len(asked) or 1) as pool:
        return union(list(pool.map(lambda x: fused(documents.where(F.col("lang") == x[0]), *x), asked)))


def work_path(spark: SparkSession, workdir: str | None = None) -> str | None:
    """A new folder of an audit under ``workdir`` (or ``spark.checkpoint.dir``), or None where neither is set."""
    folder = workdir or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{folder.rstrip('/')}/audit-{uuid.uuid4().hex}" if folder else None


def routed(docs: DataFrame, override: str | None = None, path: str | None = None) -> DataFrame:
    """``docs`` with their language, detected once: written by language to the folder ``path``, or persisted where there is none.

    The scanners of each language then read their own documents; without this, each would detect all of them again. Where
    the language is given, all documents go to its scanners as they are, and ``confident`` is found only if it is read.
    """
    found = language.detect(spread(docs), override=override)
    if override:
        return found
    if not path:
        return found.persist(StorageLevel.MEMORY_AND_DISK)
    found.write.partitionBy("lang").parquet(f"{path}/documents")
    return docs.sparkSession.read.schema(found.schema).parquet(f"{path}/documents")


def audit(docs: DataFrame, override: str | None = None, rules: list[dict] | DataFrame | None = None, external: dict[str, DataFrame] | None = None, langs: list[str] | None = None, workdir: str | None = None, failures: DataFrame | None = None, registry: Registry | None = None) -> Audit:
    """Audit documents (file, content). ``override`` sets the language of all; ``external`` has findings by outside tool.

    ``failures`` (tool, lang, error) has the runs that failed: their findings don't count, and the audit is incomplete.

    ``registry`` has scanners of one's own, which run behind the built-in ones; one that can't run is a failed run.

    ``langs`` limits the plan to languages known to occur. Language is detected once. The documents are written
    by language to ``workdir`` (a folder that all executors share; ``spark.checkpoint.dir`` of the session if none
    is given), and each scanner reads the folders of its own languages only; findings are written beside them.
    Where neither is set (a local session) both are persisted instead. With ``override``, documents are not stored.
    """
    given = external or {}
    others = list(given.values())  # built-in scanners have no findings of the gated tool
    spark = docs.sparkSession
    path = work_path(spark, workdir)
    found = routed(docs, override, path)
    wanted = [override] if override else (langs or LANGS)
    there = wanted
    if path and not override:  # the documents lie by language: plans of those that don't occur need not be built
        known = {r.lang for r in found.select("lang").distinct().collect()}
        there = [x for x in wanted if x in known] or wanted[:1]
    findings = union([scan(found, there), *others])
    if registry is not None:
        own, broken = registry.scan(found, wanted)
        if own is not None:
            findings = findings.unionByName(own)
            others.append(own)
        if broken is not None:
            failures = broken if failures is None else failures.unionByName(broken)
    if failures is not None:
        findings = report.without_failed(findings, failures)
        others = [report.without_failed(x, failures) for x in others]
    triaged = triage(findings, rules, others)
    if path:
        triaged.write.parquet(f"{path}/findings")
        triaged = spark.read.schema(triaged.schema).parquet(f"{path}/findings")
    else:
        triaged = triaged.persist(StorageLevel.MEMORY_AND_DISK)
    buckets = language.buckets(found)
    runs = report.tool_runs(buckets, triaged, list(given), failures, registry.tools() if registry else ())
    unsure = language.uncertain(found) if override is None else language.uncertain(found).limit(0)
    return Audit(found, triaged, runs, report.summary(triaged, runs), unsure, buckets, [*TOOLS, *(registry.tools() if registry else ())])
