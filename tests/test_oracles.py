"""Every registered audit query against its SQL, on the smallest tables."""

import os

import pytest

from prosewell.plans.oracles import ORACLES
from prosewell.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["lang_detect", "lang_path", "fence_mask", "ru_paragraphs", "p0_placeholders", "phrases_ja", "patterns_en_contrast", "lexicon_en", "es_mente", "id_lint", "ru_fragment_lead", "text_metrics", "score_verdict", "metrics_findings", "ext_ja_errors", "tool_runs_failed", "summary_failed", "triage_priority", "report_summary", "audit_spanish", "phrases_dictionary", "suppression_table", "findings_order", "catalog_runtime", "json_values", "ext_ru_output", "ext_ru_errors", "patterns_en_not_re2"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in got.select(*columns).collect()) == key(tuple(r) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_rules_beyond_sql_equal_python(spark):
    """The three English rules that have no SQL, line by line with Python's own patterns."""
    import re

    from prosewell.catalogs import english
    from prosewell.plans.queries import NOT_RE2, corpus
    from prosewell.schema import weighted

    rules = [r for r in english.RULES if r[0] in NOT_RE2]
    want = []
    for doc in corpus(spark, SF, "en").collect():
        for k, line in enumerate(doc.content.split("\n")):
            for name, category, weight, pattern in rules:
                found = re.search(re.sub(r"\(\?<(\w+)>", r"(?P<\1>", pattern), line, re.IGNORECASE | re.ASCII) if len(line) > 2 else None
                if found and found[0]:
                    want.append((doc.file, k + 1, weighted(weight), f"zs:{category}/{name}", found[0][:200]))
    got = [tuple(r) for r in QUERIES["patterns_en_not_re2"](spark, SF).select("file", "line", "severity", "category", "quote").collect()]
    assert sorted(got) == sorted(want) and {r[3] for r in got} == {f"zs:{r[1]}/{r[0]}" for r in rules}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_the_full_audit_is_the_scanners_of_each_language(spark):
    """Counts of the full audit against each scanner run by itself on the documents of its own languages."""
    from collections import Counter

    from prosewell.functions import language
    from prosewell.operators.scanners import BUILT_IN, placeholders
    from prosewell.operators.triage import triage
    from prosewell.plans.queries import corpus
    from prosewell.schema import TOOLS

    docs = language.detect(corpus(spark, SF, "audit", True)).cache()
    want = Counter()
    for tool, reads in TOOLS:
        if tool not in BUILT_IN:
            continue
        for lang in reads:
            own = docs.where(docs.lang == lang).select("file", "content")
            found = placeholders(own, lang) if tool == "placeholder" else BUILT_IN[tool](own, lang)
            want.update((lang, tool, r.priority) for r in triage(found).select("priority").collect())
    docs.unpersist()
    got = {(r.lang, r.tool, r.priority): r.n for r in QUERIES["audit_full"](spark, SF).collect()}
    assert got == dict(want) and len(got) > 20
