"""Scanners of one's own, beside the built-in ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewell.catalogs.languages import LANGS
from prosewell.operators.report import failed_run
from prosewell.operators.scanners import catalog_scan, union
from prosewell.schema import TOOLS


@dataclass(frozen=True)
class Scanner:
    """``scan`` makes findings (``schema.FINDING``) of documents (file, content) of one of ``langs``; ``available`` says whether it can."""

    name: str
    langs: tuple[str, ...]
    scan: Callable[[DataFrame, str], DataFrame]
    available: Callable[[], bool] = lambda: True


def catalog_scanner(name: str, langs: tuple[str, ...], rules: list[tuple[str, str, float, str]], prefix: str = "") -> Scanner:
    """A scanner of a rule catalog (``sources.catalogs``): every match of every rule."""
    return Scanner(name, langs, lambda docs, lang: catalog_scan(docs, name, lang, rules, prefix), lambda: bool(rules))


class Registry:
    """Scanners in the order in which they were added; names are used once and not those of built-in tools."""

    def __init__(self, *scanners: Scanner) -> None:
        self.scanners: list[Scanner] = []
        for scanner in scanners:
            self.add(scanner)

    def add(self, scanner: Scanner) -> Scanner:
        if scanner.name in {t for t, _ in TOOLS} | {s.name for s in self.scanners}:
            raise ValueError(f"a scanner named {scanner.name} is there already")
        unknown = set(scanner.langs) - set(LANGS)
        if unknown:
            raise ValueError(f"unknown languages: {', '.join(sorted(unknown))}")
        self.scanners.append(scanner)
        return scanner

    def tools(self) -> list[tuple[str, list[str]]]:
        """(name, languages) as in ``schema.TOOLS``."""
        return [(s.name, list(s.langs)) for s in self.scanners]

    def scan(self, documents: DataFrame, langs: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
        """Findings, and the runs (tool, lang, error) that failed: the scanner wasn't available, or it could not make a plan."""
        frames, failed = [], []
        for scanner in self.scanners:
            for lang in (x for x in scanner.langs if x in langs):
                try:
                    if not scanner.available():
                        raise RuntimeError("scanner not available")
                    frames.append(scanner.scan(documents.where(F.col("lang") == lang).select("file", "content"), lang))
                except Exception as e:
                    failed.append((scanner.name, lang, str(e) or type(e).__name__))
        return (union(frames) if frames else None), (_failures(documents.sparkSession, failed) if failed else None)


def _failures(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "tool string, lang string, error string").withColumn("error", failed_run(F.col("error")))
