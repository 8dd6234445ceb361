"""Triage, suppression, runs and reports."""

import json
import warnings

from prosewell.operators import report
from prosewell.operators.triage import glob_regex, triage
from prosewell.plans.audit import audit
from prosewell.schema import FINDING
from prosewell.sources import suppression
from prosewell.sources.files import markdown_files
from prosewell.sources.json_values import concatenated


def findings(spark, *rows):
    full = [(tool, "en", file, None, severity, category, quote, None, False, None, None) for tool, file, severity, category, quote in rows]
    return spark.createDataFrame(full, FINDING)


def test_priority_order(spark):
    cases = [
        (("x", "a", None, "tier1", "[your name]"), "P0"),
        (("x", "a", None, "tier1", "q"), "P1"),
        (("x", "a", None, "ru:dash-density", "q"), "P2"),
        (("x", "a", None, "ru:other", "q"), "P1"),
        (("x", "a", None, "zs:lexicon", None), "P1"),
        (("avoid-ai-writing", "a", "medium", "odd", "q"), "P2"),
        (("avoid-ai-writing", "a", "high", "odd", "q"), "P1"),
        (("phrases", "a", "weak", "ai-phrase", "q ×2"), "P2"),
        (("phrases", "a", "high", "ai-phrase", "q ×3"), "P1"),
        (("x", "a", None, "es:unknown", "q"), "P1"),
        (("x", "a", None, None, "q"), "P1"),
    ]
    got = triage(findings(spark, *(c for c, _ in cases)), []).collect()
    assert {(r.tool, r.severity, r.category, r.quote): r.priority for r in got} == {(t, s, c, q): p for (t, _, s, c, q), p in cases}


def test_gate_counts_one_tool_per_file(spark):
    rows = [("avoid-ai-writing", "full", "low", "odd", str(k)) for k in range(7)] + [("avoid-ai-writing", "calm", "low", "odd", str(k)) for k in range(6)] + [("x", "calm", None, "linkedin", str(k)) for k in range(5)]
    got = {(r.file, r.tool): r.priority for r in triage(findings(spark, *rows), []).collect()}
    assert got == {("full", "avoid-ai-writing"): "P1", ("calm", "avoid-ai-writing"): "P2", ("calm", "x"): "P2"}


def test_suppression_first_rule_wins(spark):
    rules = [{"category": "em-dash", "quoteContains": "META", "reason": "one"}, {"tool": "x", "reason": "two"}, {"file": "**/b.md", "reason": "three"}]
    got = triage(findings(spark, ("x", "a.md", None, "em-dash", "a meta b"), ("x", "a.md", None, "em-dash", "c"), ("y", "b.md", None, "q", "d"), ("y", "p/b.md", None, "q", "e"), ("y", "bb.md", None, "q", "f")), rules)
    assert {r.quote: (r.fp_suppressed, r.fp_reason) for r in got.collect()} == {"a meta b": (True, "one"), "c": (True, "two"), "d": (True, "three"), "e": (True, "three"), "f": (False, None)}


def test_globs():
    import re

    for glob, path, ok in [("**/*.md", "a.md", True), ("**/*.md", "x/y/a.md", True), ("*.md", "x/a.md", False), ("a?.md", "ab.md", True), ("a+b.md", "a+b.md", True), ("a+b.md", "aab.md", False)]:
        assert bool(re.match(glob_regex(glob).replace(r"\z", r"\Z"), path)) == ok, (glob, path)


def test_suppression_file():
    text = "# c\nother:\n  - file: no\nsuppress:\n  - file: \"**/*.md\"\n    category: em-dash\n    reason: 'a: b'\n  - tool: x\n  - reason: only\n  - tool: y\n    odd: z\n    reason: r\r\nend: 1\n  - tool: late\n    reason: r\n"
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        rules = suppression.load(("f", text), None)
    assert rules == [{"file": "**/*.md", "category": "em-dash", "reason": "a: b"}, {"tool": "y", "reason": "r"}]
    assert len(seen) == 2


def json_brute_force(raw: str):
    """Values one after the other, as a scan over brackets and quotes; None where the text is broken."""
    spaces = "\t\n\x0b\x0c\r \xa0\ufeff"
    out, s, at = [], raw.strip(spaces), 0
    while at < len(s):
        while s[at] in spaces:
            at += 1
        start, depth, inside, escaped = at, 0, False, False
        while at < len(s):
            c = s[at]
            at += 1
            if inside:
                inside, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
            elif c == '"':
                inside = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if depth == 0:
                    break
        if depth:
            return None
        try:
            value = json.loads(s[start:at])
        except ValueError:
            return None
        out += value if isinstance(value, list) else [value]
    return out


def test_json_values(spark):
    import random

    rng = random.Random(5)
    bits = ['{"a":1}', "[1,[2]]", '{"b":"}{\\"["}', '"x"', "3", "true", "]", "}", "{", ",", " ", "\n", '"\\\\"', '{"k":[{"m":null}]}', '"', "\\", "[]", "-1.5", "\u00a0", ":"]
    texts = ["", " ", '{"a":1}{"b":2}', '{"a":', '3 {"a":1}', '{"a":1} 3', '[{"a":1} {"b":2}]', ' {"a":"}{"} [1,{"b":[2]}]\n3 ', '1,"w":2', "1}]", '{"a":1}]', "[1]]", '{"a":"' + "x\\n" * 30000 + '"} []'] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 6))) for _ in range(600)]
    df = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)] + [(-1, None, "kept")], "k int, raw string, error string")
    got = {r.k: (r["values"], r.error) for r in concatenated(df, "raw").collect()}
    assert got.pop(-1) == ([], None)
    for k, t in enumerate(texts):
        want = json_brute_force(t)
        assert ([json.loads(v) for v in got[k][0]], got[k][1] is not None) == (want or [], want is None), t
    assert concatenated(df.limit(0), "raw").collect() == []


def test_audit_of_files(spark, tmp_path):
    for name, text in {"en/a.md": "[your language]\nIn conclusion, we delve.", "vendors/b.md": "Lorem ipsum", "c.txt": "Lorem ipsum", "ru/d.md": "План → аппрув → внесение."}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    docs = markdown_files(spark, str(tmp_path))
    assert sorted(r.file for r in docs.collect()) == [f"{tmp_path}/en/a.md", f"{tmp_path}/ru/d.md"]
    out = audit(docs, langs=["en", "ru"])
    summary = out.summary.first()
    assert summary.p0 == 1 and summary.p1 >= 3 and summary.exit_code == 2 and summary.tool_failures == 2
    runs = {(r.tool, r.lang): r for r in out.runs.collect()}
    assert runs["placeholder", "en"].findings == 1 and not runs["humanizer-ru", "ru"].ok and ("th-lint", "th") not in runs
    text = report.markdown(out.findings, out.runs, out.summary, out.uncertain)
    assert "## P0 — 1" in text and "INCOMPLETE" in text and "aппрув" not in text
    assert json.loads(report.as_json(out.findings, out.runs, out.summary, out.uncertain))["summary"]["p0"] == 1
    report.write_report(out.findings, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == out.findings.count()
    again = audit(docs, langs=["en", "ru"], workdir=str(tmp_path / "work"))
    assert sorted(map(repr, again.findings.collect())) == sorted(map(repr, out.findings.collect()))
    out.close()
    again.close()


def test_report_escapes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a*b_c`d#e>f|g\r\nh",), (None,)], "t string")
    assert [r.x for r in df.select(report.escaped(F.col("t")).alias("x")).collect()] == ["a\\*b\\_c\\`d\\#e\\>f\\|g ⏎ h", ""]


def test_stream_equals_batch(spark, tmp_path):
    from prosewell.plans.audit import scan
    from prosewell.functions import language
    from prosewell.streaming.incremental import audit_stream, watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("Lorem ipsum. In conclusion, we delve.")
    stream = audit_stream(watch(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), langs=["en"], once=True)
    stream.awaitTermination()
    got = sorted((r.tool, r.quote, r.priority) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = triage(scan(language.detect(markdown_files(spark, str(tmp_path / "in"))), ["en"]))
    assert got == sorted((r.tool, r.quote, r.priority) for r in batch.collect()) and len(got) == 5


def test_outputs_of_the_outside_russian_tool(spark):
    from prosewell.operators import scanners

    rows = [("a", '{"markers":[["k","q",2],["n",null,null]],"hard_bans":[["k",1]]} {"markers":[["x","y",1]]}', 1, ""), ("b", "", 0, ""), ("c", "oops", 0, ""), ("d", "{}", 3, ""), ("e", "{}", 3, "no python"), ("f", "7", 0, None), ("g", None, None, None)]
    results = scanners.russian_results(spark.createDataFrame(rows, "file string, stdout string, code int, stderr string"))
    assert {r.file: r.error for r in results.collect()} == {"a": None, "b": None, "c": "parse error on c: unbalanced JSON: value 1", "d": "exit 3 on d", "e": "no python", "f": None, "g": None}
    assert sorted((r.file, r.severity, r.category, r.quote) for r in scanners.external_russian(results).collect()) == [("a", "hard-ban", "ru:k", "q ×2"), ("a", "marker", "ru:n", "")]
    assert [tuple(r) for r in scanners.russian_failures(results).collect()] == [("humanizer-ru", "ru", "parse error on c: unbalanced JSON: value 1")]
    assert scanners.russian_failures(results.where("file in ('a', 'b')")).count() == 0
