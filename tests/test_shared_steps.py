"""Steps that many scanners share, done once for a whole text or line, against the plain way."""

import random
import re

from pyspark.sql import functions as F

from prosewell.catalogs import english
from prosewell.catalogs.languages import LANGS
from prosewell.functions import regexes, textmetrics
from prosewell.operators import dictionary, lines, report, scanners, triage
from prosewell.plans import audit, queries
from prosewell.schema import finding


def test_a_digit_behind_far_white_space_ends_no_sentence(spark):
    """the punctuation is among the first 34 characters, the digit behind it is not among the first 35."""
    body = "ы" * 120
    texts = {
        "digit": "Слово слово слово слово слово сло. 5 " + body,
        "far": "Слово слово слово слово слов." + " " * 9 + "5 " + body,
        "letter": "Слово слово слово слово слово сло. Ы " + body,
        "far-letter": "  Слово слово слово слово слов." + " " * 9 + "ы " + body,
    }
    assert texts["digit"][33] == "." and texts["digit"][35] == "5"
    docs = spark.createDataFrame(list(texts.items()), "file string, content string")
    assert sorted(r.file for r in scanners.fragment_leads(lines.paragraphs(docs)).collect()) == ["far-letter", "letter"]


def test_literals_found_at_once_are_those_found_one_by_one(spark):
    rng = random.Random(5)
    literals = sorted({x for r in english.RULES for x in regexes.required(r[3])})
    texts = ["", "x", "the the", *literals]
    texts += ["".join(rng.choice([*literals, *(x[:-1] for x in literals), " ", "a", "é"]) for _ in range(9)) for _ in range(150)]
    wanted = [regexes.required(r[3]) for r in english.RULES]
    found = F.expr(regexes.literals_sql("low", literals))
    rows = spark.createDataFrame([(t,) for t in texts], "low string").withColumn("found", found)
    got = rows.select("low", F.array(*(F.expr(regexes.holds_one_of_sql("found", w, literals)) for w in wanted)).alias("holds")).collect()
    assert {r.low: r.holds for r in got} == {t: [any(x in t for x in w) for w in wanted] for t in texts}


def test_syllables_of_all_tokens_are_the_sum_over_tokens(spark):
    rng = random.Random(6)
    tokens = ["".join(rng.choice("aeiouylbdcsxe'7") for _ in range(rng.randint(1, 9))) for _ in range(4000)] + ["yxes", "ed", "yed", "breed", "shed", "baled", "yyyy", "'", "7", "1es", "b's"]
    texts = [[], *(tokens[k : k + 40] for k in range(0, len(tokens), 40))]
    rows = spark.createDataFrame([(t,) for t in texts], "tokens array<string>")
    got = rows.select("tokens", textmetrics.total_syllables(F.col("tokens")).alias("n"), F.aggregate("tokens", F.lit(0), lambda a, w: a + textmetrics.syllables(w)).alias("want")).collect()
    assert all(r.n == r.want for r in got) and sum(r.n for r in got) > 4000


def test_white_space_of_every_kind_is_trimmed_and_collapsed(spark):
    rng = random.Random(7)
    white = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF and re.match(f"[{regexes.SPACES}]", chr(c)))
    assert sorted(white) == sorted(regexes.WHITE)
    texts = ["", *white, *("".join(rng.choice(white + "   ab​") for _ in range(12)) for _ in range(400))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", regexes.trimmed(F.col("t")).alias("a"), regexes.trimmed_left(F.col("t")).alias("b"), regexes.collapsed(F.col("t")).alias("c")).collect():
        assert (r.a, r.b, r.c) == (r.t.strip(white), r.t.lstrip(white), re.sub(f"[{regexes.SPACES}]+", " ", r.t))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hits_are_made_once(spark):
    """F5 to F8: below a plain explode, a filter on the array's size made units and hits a second time."""
    docs = spark.createDataFrame([("a.md", "x", lang) for lang in LANGS], "file string, content string, lang string")
    for df in (audit.scan(docs), scanners.english_lexicon(docs), scanners.thai(docs), scanners.russian(docs)):
        filters = [x for x in re.split(r"\n(?=[ :]*\+- )", plan(df)) if x.lstrip(" :+-").startswith("Filter")]
        assert filters and not [x[:200] for x in filters if "size(" in x]


def test_a_given_language_is_not_looked_for(spark):
    """F6, F8: every document was detected, and written, for a language that was given."""
    docs = spark.createDataFrame([("a.md", "x", 1), ("b.md", "이 글은 한국어로 쓰여 있습니다" * 9, 2)], "file string, content string, n int")
    found = audit.audit(docs, override="ru")
    assert "myanmar" not in plan(audit.scan(found.documents, ["ru"])) and "myanmar" not in plan(found.runs)
    assert {r.file: (r.lang, r.confident) for r in found.documents.collect()} == {"a.md": ("ru", False), "b.md": ("ru", True)}
    found.close()


def test_built_in_findings_are_not_made_again_for_the_gate(spark):
    """F5 to F8, F17: the gate of an outside tool read all findings, and so made all of them twice."""
    outside = spark.createDataFrame([("avoid-ai-writing", "en", "a.md", "low", "odd", f"q{k}") for k in range(7)], "tool string, lang string, file string, severity string, category string, quote string")
    outside = finding(outside, F.col("tool"), "en", None, F.col("severity"), F.col("category"), F.col("quote"))
    docs = spark.createDataFrame([("a.md", "In conclusion, [your name]"), ("b.md", "")], "file string, content string")
    built_in = audit.scan(docs.withColumn("lang", F.lit("en")), ["en"])
    assert "Join" not in plan(triage.triage(built_in, [], []))
    both = scanners.union([built_in, outside])
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(triage.triage(both, [], [outside])) == rows(triage.triage(both, []))
    got = audit.audit(docs, override="en", external={"avoid-ai-writing": outside}).findings
    assert [r.priority for r in got.where("tool = 'avoid-ai-writing'").collect()] == ["P1"] * 7
    assert plan(triage.triage(both, [], [outside])).count("Generate explode") == plan(built_in).count("Generate explode")


def test_triads_are_counted_as_by_their_pattern(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "bñ", "É_1", ",", ", ", " y ", " Y\t", " ", " ", ".", "y"]) for _ in range(24)) for _ in range(1500)] + ["a, b y c, d y e", "aa, b y cc, d y e, f y g"]
    one = lambda t: F.array(F.struct(t.alias("text"), F.lit(False).alias("inside")))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scanners.density_counts(one(F.col("t")))["__triads"].alias("n"), F.regexp_count("t", F.lit(scanners.TRIAD)).alias("want")).collect()
    assert all(r.n == r.want for r in rows) and sum(r.n for r in rows) > 50


def test_a_score_needs_no_syllables(spark):
    """all fifteen metrics were computed for a score that is made of five."""
    docs = spark.createDataFrame([("a.md", "Delve into the tapestry. It is a seamless realm, delve deeper. One two three."), ("b.md", ""), ("c.md", None)], "file string, content string")
    scored = textmetrics.signals(textmetrics.analyze(docs, names=textmetrics.SCORED))
    assert "(?![a-z])" not in plan(scored) and "(?![a-z])" not in plan(scanners.metric_findings(docs)) and "(?![a-z])" not in plan(audit.scan(docs.withColumn("lang", F.lit("en")), ["en"], ["metrics"]))
    names = [c for c in scored.columns if c != "content"]
    rows = lambda df: sorted(map(repr, df.select(names).collect()))
    assert rows(scored) == rows(textmetrics.signals(textmetrics.analyze(docs)))


def test_a_text_is_lowered_once_for_all_phrases(spark):
    """each phrase lower-cased the text up to three times."""
    docs = spark.createDataFrame([("a.md", "x")], "file string, content string")
    assert plan(textmetrics.analyze(docs, names=textmetrics.SCORED)).count("lower(") == 1


def test_only_paragraphs_that_may_be_dense_are_cut(spark):
    """F13, F16: all documents were cut for dashes, and every paragraph's first sentence was looked for, which dashes don't read."""
    rng = random.Random(9)
    texts = [None, "", "— a", "a — b — c — d", "a —\n\nb — c — d"] + ["".join(rng.choice(["—", "—", " ", "a", "\n", "\n\n", "# ", "```\n", "é"]) for _ in range(16)) for _ in range(400)]
    docs = spark.createDataFrame([(f"{k}.md", t) for k, t in enumerate(texts)], "file string, content string")
    rows = lambda df: sorted(map(repr, df.collect()))
    got = rows(scanners.dash_density(lines.paragraphs(scanners.holds_dashes(docs))))
    assert got == rows(scanners.dash_density(lines.paragraphs(docs))) and len(got) > 20
    assert scanners.holds_dashes(docs).count() < docs.count()
    assert "__end" not in plan(scanners.dash_density(lines.paragraphs(docs))) and "__end" in plan(scanners.fragment_leads(lines.paragraphs(docs)))


def test_built_in_findings_have_no_part_in_the_join_of_the_gate(spark):
    """F13, F14, F16: findings of all tools were shuffled by file for the gate of one tool."""
    outside = spark.createDataFrame([(f"{k % 3}.md", "odd", f"q{k}", "low") for k in range(17)], "file string, type string, text string, severity string")
    outside = scanners.external_english(outside)
    built_in = scanners.phrase_scan(spark.createDataFrame([("0.md", "In conclusion, moreover and moreover"), ("9.md", "in conclusion")], "file string, content string"), "en")
    rows = lambda df: sorted(map(repr, df.collect()))
    apart = triage.triage(outside, built_in=built_in)
    assert rows(apart) == rows(triage.triage(scanners.union([outside, built_in]))) and apart.count() == 20
    lines_ = plan(apart).split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    at = next(k for k, x in enumerate(lines_) if x.lstrip(" :+-").startswith("Join"))
    below = [x for x in lines_[at + 1 :] if depth(x) > depth(lines_[at])]
    assert "in conclusion" in plan(built_in) and not any("in conclusion" in x for x in below[: next((k for k, x in enumerate(lines_[at + 1 :]) if depth(x) <= depth(lines_[at])), None)])


def test_a_summary_makes_its_findings_once(spark, tmp_path):
    """findings were made a second time to be counted by tool, which a summary doesn't read."""
    spark.createDataFrame([(1, "delve into [your name]"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = plan(queries.QUERIES["report_summary"](spark, str(tmp_path)))
    assert found.count("Generate explode(h#") == 3
    buckets = spark.createDataFrame([("en", 4), ("ru", 1)], "lang string, files long")
    some = scanners.phrase_scan(spark.createDataFrame([("a.md", "in conclusion")], "file string, content string"), "en")
    failed = spark.createDataFrame([("phrases", "ru", "broken")], "tool string, lang string, error string")
    runs = report.tool_runs(buckets, some, ["humanizer-ru"], failed)
    states = report.run_states(buckets, ["humanizer-ru"], failed)
    assert sorted(map(repr, runs.drop("findings").collect())) == sorted(map(repr, states.collect()))
    assert {(r.tool, r.lang): (r.ok, r.findings) for r in runs.where("tool = 'phrases'").collect()} == {("phrases", "en"): (True, 1), ("phrases", "ru"): (False, 0)}


def test_stems_found_at_once_are_counted_as_one_by_one(spark):
    rng = random.Random(10)
    stems = list(english.LEXICON)
    texts = [None, "", *stems] + ["".join(rng.choice([*stems, *(x[:-1] for x in stems), *(x[1:] for x in stems), " ", "é"]) for _ in range(9)) for _ in range(200)]
    docs = spark.createDataFrame([(f"{k}.md", t) for k, t in enumerate(texts)], "file string, content string")
    want = sorted((f"{k}.md", x + (f" ×{n}" if n > 1 else ""), at + len(english.RULES)) for k, t in enumerate(texts) for at, x in enumerate(stems) if (n := (t or "").lower().count(x.lower())))
    assert sorted((r.file, r.quote, r.seq[0]) for r in scanners.english_lexicon(docs).collect()) == want
    assert "contains(" not in plan(scanners.english_lexicon(docs)).lower()


def test_marks_are_escaped_as_by_a_regex(spark):
    rng = random.Random(11)
    texts = [None, ""] + ["".join(rng.choice("*_`#>|\\\n\rab$é") for _ in range(9)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", report.escaped(F.col("t")).alias("e")).collect()
    assert all(r.e == re.sub(r"([*_`#>|])", r"\\\1", re.sub(r"[\n\r]+", " ⏎ ", r.t or "")) for r in rows)


def test_weak_needles_below_their_floor_do_not_leave_the_task(spark):
    """every occurrence of a weak needle was sent to Spark, and those that occur once dropped there."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abé文") for _ in range(rng.randint(1, 12)))
    needles = sorted({word() for _ in range(300)} | {"a" * k for k in range(1, 20)})
    texts = [None, "", "a" * 41] + [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(f"{k}.md", t) for k, t in enumerate(texts)], "file string, content string")
    listed = spark.createDataFrame([(x, "weak" if k % 2 else "cliche") for k, x in enumerate(needles)], "needle string, kind string")
    kinds = {x: "weak" if k % 2 else "cliche" for k, x in enumerate(needles)}
    want = {(f"{k}.md", x): n for k, t in enumerate(texts) for x in needles if (n := (t or "").count(x)) >= (2 if kinds[x] == "weak" else 1)}
    got = dictionary.counts(docs, listed, weak=2)
    assert {(r.file, r.needle): r.n for r in got.collect()} == want and got.count() == len(want)
    assert "Filter" not in plan(dictionary.dictionary_scan(docs, listed, "en"))


def test_occurrences_across_slices_and_wide_keys(monkeypatch):
    """occurrences are sorted as one number each, or by three keys where they don't fit into one."""
    rng = random.Random(13)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 5, 700, 64, 3)]
    needles = ["a", "ab", "aba", "bb", "abab", "aabbaabba", "a" * 9, "b" * 3]
    monkeypatch.setattr(dictionary, "SLICE", 64)
    want = [(t, k, x.count(y)) for t, x in enumerate(texts) for k, y in enumerate(needles) if y in x]
    index = dictionary.NeedleIndex(needles)
    assert list(zip(*(x.tolist() for x in index.count(texts)), strict=True)) == want
    counted = index._counted
    monkeypatch.setattr(index, "_counted", lambda a, b, c, places, n: counted(a, b, c, 1 << 60, n))
    assert list(zip(*(x.tolist() for x in index.count(texts)), strict=True)) == want


def test_only_languages_that_occur_are_planned(spark, tmp_path, monkeypatch):
    """plans of nine languages were built and run for documents of two."""
    asked, scan = [], audit.scan
    monkeypatch.setattr(audit, "scan", lambda docs, langs: (asked.append(list(langs)), scan(docs, langs))[1])
    docs = spark.createDataFrame([("a.md", "In conclusion, [your name]"), ("b.md", "Это текст, который написан по-русски — раз — два — три." * 3), ("c.md", None)], "file string, content string")
    found = audit.audit(docs, workdir=str(tmp_path))
    assert asked == [["en", "ru"]]
    assert {("en", "phrases"), ("en", "placeholder"), ("ru", "ru-structural")} <= {(r.lang, r.tool) for r in found.findings.collect()}
    assert audit.audit(docs.limit(0), workdir=str(tmp_path)).findings.count() == 0
