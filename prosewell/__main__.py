"""Command line: ``python -m prosewell [--lang LANG] [--json] [--out FOLDER] [--catalog FILE] [PATH ...]``.

Audits the markdown files under the paths (the current folder if none is given) and prints the report, or writes it
to a folder as numbered files, whatever its size. Rules of
the folder's own ``.prosewell.yaml`` are added to the built-in ones. Exit status: 0 clean, 1 open P0 or P1
findings, 2 an incomplete audit (a tool failed or was missing), 3 wrong usage or no markdown files.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from prosewell.catalogs.languages import LANGS
from prosewell.catalogs.triage import SUPPRESS
from prosewell.operators import report, sinks
from prosewell.operators.registry import Registry, catalog_scanner
from prosewell.plans.audit import audit
from prosewell.sources import catalogs, suppression
from prosewell.sources.files import markdown_files

USAGE, INCOMPLETE = 3, 2


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(USAGE, f"{message}\n")


def main(args: list[str], spark: SparkSession | None = None) -> int:
    parser = _Parser("prosewell", description="Audits markdown files.")
    parser.add_argument("paths", nargs="*", default=["."], help="files and folders")
    parser.add_argument("--lang", choices=LANGS, help="the language of all files")
    parser.add_argument("--json", action="store_true", help="print the report as JSON")
    parser.add_argument("--out", help="write the report to this folder instead of printing it")
    parser.add_argument("--catalog", action="append", default=[], help="a catalog of more rules (JSON), for all languages")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("prosewell").getOrCreate()
    here = lambda path: path if "://" in path else os.path.abspath(path)  # noqa: E731  of this process, not of Spark's
    docs = markdown_files(spark, *map(here, given.paths))
    if docs.isEmpty():
        print("No markdown files found under: " + " ".join(given.paths), file=sys.stderr)
        return USAGE
    more = Registry(*(catalog_scanner(os.path.basename(c).removesuffix(".json"), tuple(LANGS), catalogs.read(spark, here(c))) for c in given.catalog)) if given.catalog else None
    found = audit(docs, override=given.lang, registry=more, rules=[*SUPPRESS, *suppression.read(spark, here(suppression.PROJECT_FILE))])
    try:
        parts = (found.ordered(), found.runs, found.summary, found.uncertain)
        if given.out:
            sinks.write_lines((sinks.json_lines if given.json else sinks.markdown_lines)(*parts), here(given.out))
        else:
            print((report.as_json if given.json else report.markdown)(*parts))
        return found.summary.first().exit_code
    finally:
        found.close()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
