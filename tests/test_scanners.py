"""Scanners on one-document corpora."""

import pytest

from prosewell.plans.audit import audit
from prosewell.operators import scanners
from prosewell.operators.lines import fenced_lines, paragraphs

BODY = "Потом он долго рассказывал о работе, о людях и о том, как всё это вместе складывалось в одну длинную историю без конца."


def scan(spark, f, *texts):
    docs = spark.createDataFrame([(f"{k:02}", t) for k, t in enumerate(texts)], "file string, content string")
    out = [[] for _ in texts]
    for r in sorted(f(docs).collect(), key=lambda r: (r.file, r.line or 0, r.category, r.quote)):
        out[int(r.file)].append((r.line, r.severity, r.category, r.quote))
    return out


def test_placeholders(spark):
    got = scan(spark, lambda d: scanners.placeholders(d, "en"), "a\nb\n[your language]", "<!-- [your name] -->", "INSERT TITLE now, insert title", "```Lorem ipsum", None, "")
    assert got == [[(3, "critical", "p0-placeholder", "[your language]")], [], [(1, "critical", "p0-placeholder", "INSERT TITLE ")], [], [], []]


def test_phrases_escalate(spark):
    needles = [("in conclusion", "cliche"), ("является", "weak")]
    got = scan(spark, lambda d: scanners.phrase_scan(d, "en", needles), "In conclusion", "in conclusion " * 3, "является", "Является, является", "является " * 3)
    assert got == [[(None, "phrase", "ai-phrase", "in conclusion")], [(None, "high", "ai-phrase", "in conclusion ×3")], [], [(None, "weak", "ai-phrase", "является ×2")], [(None, "high", "ai-phrase", "является ×3")]]
    assert scanners.passes_floor("첫째") and scanners.passes_floor("革命的") and not scanners.passes_floor("abc") and scanners.passes_floor("abcd")


def test_english_rules_give_the_first_match_of_a_line(spark):
    got = scan(spark, lambda d: scanners.english_patterns(d, ["hedging"]), "Arguably so, arguably.\nCafé: it’s worth noting", "nothing")
    assert got == [[(1, "medium", "zs:hedging/arguably", "Arguably"), (2, "high", "zs:hedging/hedge-stem", "it’s worth noting")], []]
    tests = "One becomes two. two becomes three"
    assert scan(spark, scanners.english_patterns, tests)[0] == [(1, "high", "zs:drama/transformation-chain", tests[: tests.index(" three")])]


def test_english_lexicon_counts_substrings(spark):
    assert scan(spark, scanners.english_lexicon, "Delve and DELVE, Fosters")[0] == [(None, "high", "zs:lexicon", "delve ×2"), (None, "medium", "zs:lexicon", "foster")]


def test_spanish(spark):
    assert scan(spark, scanners.spanish_catalog, "En conclusión, sí.\nDijo algo. En síntesis, nada. en síntesis")[0] == [(1, "high", "es:conclusion_announcer", "En conclusión"), (2, "high", "es:conclusion_announcer", "En síntesis"), (2, "high", "es:conclusion_announcer", "en síntesis")]
    one, three = "Pan, vino y queso.", "Pan, vino y queso.\nSol, luna y mar.\nUno, dos y tres."
    fenced = "Pan, vino y queso.\n```\nSol, luna y mar.\n```\nUno, dos y tres."
    assert scan(spark, scanners.spanish_density, one, three, fenced) == [[], [(None, "high", "es:triads", "triads ×3")], []]
    assert scan(spark, scanners.spanish_density, "Puede ayudar. Pueden ayudarnos. Podría vivir.")[0] == [(None, "medium", "es:poder_infinitivo", "poder+infinitivo ×3")]
    assert scan(spark, scanners.spanish_mente, "Fácilmente y rápidamente llegó.", "Fácilmente vino. Rápidamente no.", "La mente demente")[0] == [(1, "medium", "es:mente_adverb_chain", "Fácilmente, rápidamente")]
    assert [len(x) for x in scan(spark, scanners.spanish_inciso, "El plan — así — va.", "—Hola —dijo.", "A — b. C — d.")] == [1, 0, 0]


def test_catalogs_of_other_scripts(spark):
    assert [len(x) for x in scan(spark, scanners.thai, "โดยสรุป ดี", "คำ โดยสรุป")] == [1, 0]
    assert [x[2] for x in scan(spark, scanners.indonesian, "Kesimpulannya, baik. Ringkasnya baik")[0]] == ["id:conclusion_announcer"] * 2
    assert [x[2] for x in scan(spark, scanners.japanese, "- ✅ 完全に完全に")[0]] == ["JA-AI-H01", "JA-AI-H01", "JA-AI-L01"]
    assert scan(spark, scanners.vietnamese, "Vượt trội và tuyệt vời", "Hy vọng bài viết này hữu ích", "có Việc", "Việc này")[1:] == [[(1, "high", "VI-HUM-D02", "hy vọng bài viết này hữu ích")], [], [(1, "medium", "VI-HUM-S01", "Việc ")]]


def test_fences(spark):
    docs = spark.createDataFrame([("a", "x\n```py\ny\n  ```\nz")], "file string, content string")
    rows = fenced_lines(docs).orderBy("line").collect()
    assert [(r.fence, r.inside) for r in rows] == [(False, False), (True, False), (False, True), (True, True), (False, False)]


def test_paragraphs(spark):
    docs = spark.createDataFrame([("a", "one\ntwo\n\n- item\nthree\n# head\nfour"), ("b", ""), ("c", None)], "file string, content string")
    rows = paragraphs(docs).orderBy("file", "start_line").collect()
    assert [(r.file, r.start_line, r.text, r.next_start) for r in rows] == [("a", 1, "one\ntwo", 5), ("a", 5, "three", 7), ("a", 7, "four", None)]


@pytest.mark.parametrize(
    ("text", "lead"),
    [(f"Что делал. {BODY}", "Что делал."), (f"Методика. {BODY}", None), (f"В 2.5 раза и т. д. {BODY}", None), (f"Вот что было.\n\n{BODY}", "Вот что было."), (f"Вот что было.\n\n- пункт\n\n{BODY}", None), ("Что делал. Мало.", None)],
)
def test_russian_leads(spark, text, lead):
    found = [x for x in scan(spark, scanners.russian, text)[0] if x[2] == "ru:fragment-lead"]
    assert found == ([(1, "medium", "ru:fragment-lead", lead)] if lead else [])


def test_russian_dashes_and_arrows(spark):
    got = scan(spark, scanners.russian, "а — б — в", "а — б — в — г", "—а — б — в — г — д — е", "План → аппрув → внесение.", "N5 → N1", "A1→A2→B", "| т → т |")
    assert [[(x[1], x[2], x[3]) for x in g] for g in got] == [
        [],
        [("medium", "ru:dash-density", "×3 а — б — в — г")],
        [("high", "ru:dash-density", "×5 —а — б — в — г — д — е")],
        [("high", "ru:arrow-prose", "План → аппрув → внесение. ×2")],
        [],
        [("medium", "ru:arrow-prose", "A1→A2→B")],
        [],
    ]


def test_outside_findings(spark):
    ko = spark.createDataFrame([("a", "risk_band=high risk_score=7 route_hint=x"), ("b", "risk_band=low"), ("c", "?")], "file string, stdout string")
    assert {r.file: r.quote for r in scanners.external_korean(ko).collect()} == {"a": "risk_band=high risk_score=7 route_hint=x", "c": "risk_band=? risk_score=? route_hint=?"}
    ja = spark.createDataFrame([("a", '{"findings":[{"line":3,"category":"x","excerpt":"y"},{"category":"z"}]}'), ("b", "broken")], "file string, stdout string")
    assert [(r.file, r.line, r.category, r.quote) for r in scanners.external_japanese(ja).collect()] == [("a", 3, "ja:x", "y")]


def test_broken_outside_output_is_a_failed_run(spark):
    rows = [("c", "broken"), ("a", '{"findings":[{"category":"x","excerpt":"y"}]}'), ("b", '{"x":1}'), ("d", None), ("e", '{"findings":null}')]
    ja = spark.createDataFrame(rows, "file string, stdout string")
    errors = {r.file: r.error for r in scanners.japanese_errors(ja).collect()}
    assert errors == {"a": None, "b": "missing findings[] on b", "c": "unparseable lint.py JSON on c", "d": "unparseable lint.py JSON on d", "e": "missing findings[] on e"}
    assert [tuple(r) for r in scanners.japanese_failures(ja).collect()] == [("natural-japanese", "ja", "missing findings[] on b")]
    assert scanners.japanese_failures(ja.where("file = 'a'")).count() == 0

    docs = spark.createDataFrame([("a", "text")], "file string, content string")
    out = audit(docs, override="ja", external={"natural-japanese": scanners.external_japanese(ja)}, failures=scanners.japanese_failures(ja))
    run = out.runs.where("tool = 'natural-japanese'").first()
    assert (run.ok, run.findings, run.error) == (False, 0, "missing findings[] on b")
    assert out.findings.where("tool = 'natural-japanese'").count() == 0 and out.summary.first().exit_code == 2
    out.close()
