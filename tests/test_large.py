"""What has no bound: long texts, large dictionaries, many rules, reports of any size."""

import json
import os
import random
import re
import time
import warnings

import pytest
from pyspark.sql import functions as F

from prosewell.catalogs.languages import LANGS
from prosewell.functions import language
from prosewell.functions.regexes import SPACES
from prosewell.operators import dictionary, lines, order, report, scanners, sinks, triage
from prosewell.operators.registry import Registry, Scanner, catalog_scanner
from prosewell.plans.audit import audit
from prosewell.plans.fused import HITS, fused
from prosewell.plans.seeds import SEEDS
from prosewell.schema import FINDING, TOOLS
from prosewell.sources import catalogs


def documents(spark, texts):
    return spark.createDataFrame([(f"{k}.md", t) for k, t in enumerate(texts)], "file string, content string")


# -- lines, paragraphs, arrows -----------------------------------------------------------------------


def lines_brute_force(text):
    out, inside = [], False
    for k, line in enumerate(text.split("\n"), 1):
        fence = re.match(f"[{SPACES}]*```", line) is not None
        out.append((k, line, fence, inside))
        inside ^= fence
    return out


def runs_brute_force(text):
    out, run = [], []
    for k, line, fence, inside in lines_brute_force(text):
        bare = line.strip(" \t\r")
        stop = fence or inside or bare == "" or bare[0] in "#>|" or bare.startswith("- ") or line.startswith("    ")
        if stop and run:
            out.append(run)
            run = []
        if not stop:
            run.append((k, line))
    return out + ([run] if run else [])


def test_fences_and_paragraphs_equal_a_loop(spark):
    rng = random.Random(1)
    parts = ["a", "", "```", " ```py", "# h", "b c", "- x", "    code", "I", "O", "S", "P0000000001", "```a```", "x ``` y", "z\r"]
    texts = ["", "\n", "```", "a\n```\nb\n```\nc", "```\n```\n\n```x\ny"] + ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    docs = documents(spark, [*texts, None])
    states, runs = {}, {}
    for r in lines.fenced_lines(docs).collect():
        states.setdefault(r.file, []).append((r.line, r.text, r.fence, r.inside))
    for r in lines.paragraphs(docs).collect():
        runs.setdefault(r.file, []).append((r.start_line, r.lines, r.text, r.next_start, r.next_text))
    for k, text in enumerate(texts):
        assert sorted(states[f"{k}.md"]) == lines_brute_force(text)
        want = runs_brute_force(text)
        joined = ["\n".join(x for _, x in run) for run in want]
        after = [*((run[0][0], j) for run, j in zip(want[1:], joined[1:], strict=True)), (None, None)]
        assert sorted(runs.get(f"{k}.md", [])) == [(run[0][0], [x for _, x in run], j, *a) for run, j, a in zip(want, joined, after, strict=False)]
    assert f"{len(texts)}.md" not in states


def test_segmentation_needs_no_exchange(spark):
    docs = documents(spark, ["a"])
    for df in (lines.fenced_lines(docs), lines.paragraphs(docs), scanners.russian(docs), scanners.spanish(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def arrows_brute_force(line):
    n = 0
    for m in re.finditer("→", line):
        left, right = re.search(r"(\S+)\s*$", line[: m.start()]), re.match(r"\s*(\S+)", line[m.end() :])
        n += not (left and right and re.search("[0-9]", left[1]) and re.search("[0-9]", right[1]))
    return n


def test_arrows_equal_a_loop(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["→", "→", "5", "a", " ", "→ ", "7→"]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", scanners.prose_arrows(F.col("t")).alias("n")).collect():
        assert r.n == arrows_brute_force(r.t), r.t


def test_long_texts_take_linear_time(spark):
    """Four times the text takes less than nine times as long: 200,000 lines with fences, a line of 2.4 million characters."""

    def took(f):
        began = time.time()
        f()
        return time.time() - began

    def text(n):
        return documents(spark, ["\n".join("```" if k % 10 == 0 else f"line {k} of prose" for k in range(n))])

    def line(n):
        return spark.createDataFrame([("a → 5→6 " * n,)], "t string")

    for make, run in ((text, lambda d: lines.paragraphs(d).count()), (line, lambda d: d.select(scanners.prose_arrows(F.col("t"))).collect())):
        small, large = make(50_000 if make is text else 75_000), make(200_000 if make is text else 300_000)
        run(make(10))
        assert took(lambda: run(large)) < 9 * max(took(lambda: run(small)), 0.5)


# -- one pass ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("lang", "seed"), [("en", "en"), ("en", "metrics"), ("ru", "ru"), ("es", "es"), ("vi", "vi"), ("ja", "ja"), ("th", "th"), ("ko", "phrases")])
def test_one_pass_equals_the_single_scanners(spark, lang, seed):
    docs = documents(spark, [*SEEDS[seed], *SEEDS["placeholder"], "", "\n```\n"])
    tools = [t for t, langs in TOOLS if t in HITS and lang in langs]
    alone = scanners.union([scanners.BUILT_IN[t](docs, lang) for t in tools])
    assert sorted(map(repr, fused(docs, lang, tools).collect())) == sorted(map(repr, alone.collect()))


# -- dictionaries ------------------------------------------------------------------------------------


def test_ten_thousand_needles_in_one_pass(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé語 ") for _ in range(rng.randint(1, 9))).strip() or "aa"
    needles = sorted({word() for _ in range(14_000)})[:10_000]
    texts = [" ".join(word() for _ in range(rng.choice([0, 5, 80]))) for _ in range(60)] + ["a" * 300]
    listed = spark.createDataFrame([(x, "weak") for x in needles] + [("AA", "cliche"), ("", "weak"), (None, "weak")], "needle string, kind string")
    docs = documents(spark, [*texts, None])
    want = {(f"{k}.md", x.lower()): t.lower().count(x.lower()) for k, t in enumerate(texts) for x in {*needles, "aa"} if x.lower() in t.lower()}
    for shard_bytes in (dictionary.SHARD_BYTES, 200_000):  # one shard, and several
        got = {(r.file, r.needle.lower()): r.n for r in dictionary.counts(docs, listed, shard_bytes=shard_bytes).collect()}
        assert got == want
    size = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    assert size(dictionary.counts(docs, listed)) == size(dictionary.counts(docs, listed.limit(10)))
    assert dictionary.counts(docs, listed.limit(0)).count() == 0


def test_dictionary_scan_equals_the_literal_phrases(spark):
    docs = documents(spark, SEEDS["phrases"] + [s.upper() * 3 for s in SEEDS["phrases"]])
    for lang in LANGS:
        listed = spark.createDataFrame(scanners.phrase_needles(lang), "needle string, kind string")
        rows = lambda df: sorted((r.file, r.severity, r.category, r.quote) for r in df.collect())
        assert rows(dictionary.dictionary_scan(docs, listed, lang)) == rows(scanners.phrase_scan(docs, lang))


def test_needles_across_slices(monkeypatch):
    monkeypatch.setattr(dictionary, "SLICE", 64)
    rng = random.Random(4)
    needles = sorted({"".join(rng.choice("ab é語") for _ in range(rng.randint(1, 12))) for _ in range(300)})
    texts = ["".join(rng.choice("ab é語") for _ in range(rng.choice([0, 3, 50, 300]))) for _ in range(100)] + ["a" * 500]
    text, which, n = dictionary.NeedleIndex(needles).count(texts)
    assert {(a, needles[b]): c for a, b, c in zip(text.tolist(), which.tolist(), n.tolist(), strict=True)} == {(k, x): t.count(x) for k, t in enumerate(texts) for x in needles if x in t}


# -- catalogs and scanners of one's own --------------------------------------------------------------


def test_catalog_file_with_broken_rules(spark, tmp_path):
    path = tmp_path / "rules.json"
    rules = [{"name": "a", "cat": "c", "w": 4, "rx": r"\bfoo\b"}, {"name": "b", "rx": "(open"}, {"rx": "ba+r"}, {"name": "d"}, 7, {"name": "e", "rx": ""}]
    path.write_text(json.dumps({"patterns": rules}))
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        read = catalogs.read(spark, str(path))
    assert read == [("a", "c", 4.0, r"\bfoo\b"), ("2", "2", 1.0, "ba+r")] and len(seen) == 4
    for text in ("[]", "{}", "no", '{"patterns": 3}'):
        with pytest.raises(ValueError):
            catalogs.parse(spark, text)
    with pytest.raises(ValueError):
        catalogs.parse(spark, json.dumps({"patterns": [{"rx": "a"}] * (catalogs.MAX_RULES + 1)}))
    scanner = catalog_scanner("mine", ("en",), read, "x:")
    found = scanner.scan(documents(spark, ["foo\nbaar foo"]), "en").collect()
    assert sorted((r.line, r.category, r.quote, r.severity, r.seq) for r in found) == [(1, "x:c", "foo", "high", [0, 1, 0]), (2, "x:2", "baar", "medium", [1, 2, 0]), (2, "x:c", "foo", "high", [0, 2, 0])]


def test_scanners_of_ones_own_in_an_audit(spark):
    docs = spark.createDataFrame([("en/a.md", "Lorem ipsum foo"), ("th/b.md", "foo")], "file string, content string")

    def fails(docs, lang):
        raise RuntimeError("no such column")

    own = Registry(catalog_scanner("mine", ("en", "th"), [("foo", "c", 5, "foo")]), Scanner("broken", ("en",), fails), Scanner("away", ("th",), fails, lambda: False))
    for wrong in (Scanner("phrases", ("en",), fails), Scanner("mine", ("en",), fails), Scanner("new", ("xx",), fails)):
        with pytest.raises(ValueError):
            own.add(wrong)
    out = audit(docs, langs=["en", "th"], registry=own)
    assert sorted((r.file, r.quote) for r in out.findings.where("tool = 'mine'").collect()) == [("en/a.md", "foo"), ("th/b.md", "foo")]
    runs = {(r.tool, r.lang): (r.ok, r.findings, r.error) for r in out.runs.collect()}
    assert runs["mine", "en"] == (True, 1, None) and runs["broken", "en"] == (False, 0, "no such column") and runs["away", "th"] == (False, 0, "scanner not available")
    assert [r.tool for r in out.ordered().where("lang = 'en'").orderBy("position").collect()] == ["placeholder", "mine"]


# -- suppression -------------------------------------------------------------------------------------


def test_rules_that_share_a_tool_do_not_meet_in_one_list(spark):
    """500 globs and 500 parts of quotes of one tool; each finding meets those only whose literal it holds."""
    n = 500
    found = spark.createDataFrame([("t", "en", f"doc-{k}.md", None, None, None, f"{k} {k} X", None, False, None, None) for k in range(n)], FINDING)
    rules = [{"reason": f"g{k}", "tool": "t", "file": f"**/doc-{k}?.md"} for k in range(n)] + [{"reason": f"q{k}", "tool": "t", "quoteContains": f"{k} {k} x"} for k in range(n)]
    table = triage.rule_rows(triage.rule_table(spark, rules)).cache()
    given = found.withColumn("__quote", F.lower("quote"))
    for side, value in (("file", "file"), ("quote", "__quote")):
        shapes = [(r.bits, r.n) for r in table.where(F.col("side") == side).select("bits", F.length("anchor").alias("n")).distinct().collect()]
        lists = triage._fitting(given, table, side, shapes, value).select(F.size(f"__by_{side}").alias("n")).collect()
        assert lists and max(r.n for r in lists) <= 3
    want = {f"doc-{k}.md": f"g{k // 10}" if k > 9 else f"q{k}" for k in range(n)}
    got = triage.suppressed_by(found, triage.rule_table(spark, rules)).collect()
    assert {r.file: r.fp_reason for r in got} == want


def test_parts_of_texts_are_not_broadcast(spark, tmp_path, monkeypatch):
    """stored findings look small to Spark; the rows of their parts are not sent through the driver, whatever the size of the rules."""
    spark.createDataFrame([("t", "en", f"doc-{k}.md", None, None, "k", f"{k} {k} X", None, False, None, None) for k in range(40)], FINDING).write.parquet(str(tmp_path / "found"))
    found = spark.read.parquet(str(tmp_path / "found")).withColumn("__quote", F.lower("quote"))
    rules = [{"reason": f"g{k}", "tool": "t", "file": f"**/doc-{k}?.md"} for k in range(400)] + [{"reason": f"q{k}", "category": "k", "quoteContains": f"{k} {k} x"} for k in range(400)]

    def nodes(plan):
        yield plan
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    for small in (0, 1 << 30):
        monkeypatch.setattr(triage, "_SMALL", small, raising=False)
        got = triage.suppressed_by(found.drop("__quote"), triage.rule_table(spark, rules))
        assert {r.file: r.fp_reason for r in got.collect()} == {f"doc-{k}.md": f"g{k // 10}" if k > 9 else f"q{k}" for k in range(40)}
        joins = [x for x in nodes(got._jdf.queryExecution().sparkPlan()) if x.nodeName() == "BroadcastHashJoin"]
        built = [x.left() if x.buildSide().toString() == "BuildLeft" else x.right() for x in joins]
        assert not [x for side in built for x in nodes(side) if x.nodeName() == "Generate"]


def test_a_part_that_meets_by_its_hash_only_is_no_fit(spark, monkeypatch):
    """parts meet by hashes; with a hash that makes all of them meet, tool, category and text still decide."""
    found = spark.createDataFrame([(t, "en", f, None, None, c, q, None, False, None, None) for t in ("t", "u", None) for f in ("a/x1.md", "y.md", None) for c in ("k", None) for q in ("Foo bar", "foo", None)], FINDING)
    rules = [{"reason": "1", "tool": "t", "file": "**/x?.md"}, {"reason": "2", "category": "k", "file": "y*", "quoteContains": "ba"}, {"reason": "3", "tool": "u", "category": "k", "quoteContains": "foo"}, {"reason": "4", "quoteContains": "foo b"}]
    want = sorted(map(repr, triage.suppressed(found, rules).collect()))
    monkeypatch.setattr(triage.F, "xxhash64", lambda *x: F.lit(1).cast("long"))
    assert sorted(map(repr, triage.suppressed_by(found, triage.rule_table(spark, rules)).collect())) == want


def test_rules_as_a_table_equal_the_chain(spark):
    rng = random.Random(6)
    pick = lambda *x: rng.choice(x)
    rows = [(pick("t1", "t2"), "en", pick("a/b.md", "c.md", "x/y/z.md", "a+b(1).md"), None, None, pick("k1", "k2", None), pick("Foo bar", "baz", None, "FOO"), None, False, None, None) for _ in range(400)]
    found = spark.createDataFrame(rows, FINDING)
    rules = [{"reason": f"r{k}", "tool": pick(None, "t1", "t3", ""), "category": pick(None, "k1", "k9"), "file": pick(None, "c.md", "**/*.md", "a/?.md", "*/z.md", "**/z.md", "a+b(1).md"), "quoteContains": pick(None, "foo", "BAR", "q")} for k in range(40)]
    rules = [r for r in rules if any(r[k] for k in ("tool", "category", "file", "quoteContains"))]
    want = sorted(map(repr, triage.suppressed(found, rules).collect()))
    assert sorted(map(repr, triage.suppressed_by(found, triage.rule_table(spark, rules)).collect())) == want
    empty = spark.createDataFrame([(1, "", None, None, "", "r"), (2, "a", None, None, None, None)], triage.RULES)
    assert not triage.suppressed_by(found, empty).where("fp_suppressed").count()
    many = [{"reason": f"n{k}", "file": f"no-{k}.md"} for k in range(triage.LITERAL_RULES)] + rules
    assert sorted(r.fp_reason or "" for r in triage.triage(found, many).collect()) == sorted(r.fp_reason or "" for r in triage.triage(found, rules).collect())


# -- order and sinks ---------------------------------------------------------------------------------


def test_positions_are_the_order_of_the_keys(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["phrases", "th-lint", "ja-lint", "mine"]), rng.choice(["th", "ja"]), f"f{rng.randint(0, 9)}.md", None, None, None, "q", None, False, None, rng.choice([None, [0], [1, 2, 3], [1, 10, 0], [2]])) for _ in range(500)]
    found = spark.createDataFrame(rows, FINDING).repartition(7)
    buckets = spark.createDataFrame([("th", 3, "a.md"), ("ja", 2, "b.md")], "lang string, files long, first_file string")
    tools = [*TOOLS, ("mine", ["th", "ja"])]
    place = {t: k for k, (t, _) in enumerate(tools)}
    key = lambda r: ({"th": 0, "ja": 1}[r[1]], place[r[0]], r[2], r[10] is not None, r[10] or [])
    got = [tuple(r)[:11] for r in order.positions(found, buckets, tools).orderBy("position").collect()]
    assert [key(r) for r in got] == sorted(map(key, rows))
    assert [r.position for r in order.positions(found, buckets, tools).orderBy("position").collect()] == list(range(1, 501))
    assert order.positions(found.limit(0), buckets).collect() == []


@pytest.mark.parametrize("texts", [{"en/a.md": "[your language]\nIn conclusion, we delve.\nLorem ipsum", "ru/d.md": "План → аппрув → внесение.", "x.md": "?"}, {"th/a.md": "a"}])
def test_sinks_equal_the_small_reports(spark, tmp_path, texts):
    out = audit(spark.createDataFrame(list(texts.items()), "file string, content string"))
    parts = (out.ordered(), out.runs, out.summary, out.uncertain)
    for name, lines_of, whole in (("md", sinks.markdown_lines, report.markdown(*parts)), ("json", sinks.json_lines, report.as_json(*parts))):
        path = str(tmp_path / name)
        manifest = {r.file: (r.first_line, r.n_lines) for r in sinks.write_lines(lines_of(*parts), path).collect()}
        files = sorted(f for f in os.listdir(path) if f.startswith("part-") and f in manifest)
        text = "".join((tmp_path / name / f).read_text() for f in files)
        if name == "md":
            assert text.rstrip("\n") == whole.rstrip("\n")
        else:
            a, b = json.loads(text), json.loads(whole)
            assert a["findings"] == b["findings"] and a["summary"] == b["summary"] and a["language_uncertain"] == b["language_uncertain"]
            assert sorted(map(repr, a["tool_runs"])) == sorted(map(repr, b["tool_runs"]))
        first = 1
        for f in files:
            assert manifest[f] == (first, (tmp_path / name / f).read_text().count("\n"))
            first += manifest[f][1]
        assert os.path.isdir(tmp_path / name / "_manifest")


def test_languages_come_by_their_first_file(spark):
    docs = spark.createDataFrame([("b/th/1.md", "Lorem ipsum"), ("a/vi/1.md", "Lorem ipsum"), ("c/th/2.md", "Lorem ipsum")], "file string, content string")
    found = language.detect(docs)
    assert [r.lang for r in order.positions(scanners.placeholders(found.select("file", "content", "lang")), language.buckets(found)).orderBy("position").collect()] == ["vi", "th", "th"]
