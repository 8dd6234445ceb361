"""The registered queries of the audit, over whole tables.

Rule queries read the documents with a seed block appended (``plans.seeds``) and force the language, so
that each scanner has something to find; language and metric queries read the texts with their own seeds.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewell.catalogs import english
from prosewell.functions import language, textmetrics
from prosewell.operators import lines as line_ops
from prosewell.operators import dictionary, order, registry, report, scanners
from prosewell.operators.triage import triage, with_gate
from prosewell.plans.audit import audit, routed, scan, work_path
from prosewell.plans.seeds import SEEDS
from prosewell.sources import catalogs
from prosewell.sources.files import excluded, table_documents
from prosewell.sources.json_values import concatenated
from prosewell.sources.splits import spread

QUERIES = {}
#: English rules that RE2 can't express; they have a query of their own, whose SQL goes another way.
NOT_RE2 = ["transformation-chain", "isocolon-ditransitive", "generic-benefit-stack"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def corpus(spark: SparkSession, sf_dir: str, seed: str, front: bool = False) -> DataFrame:
    """Documents (file, content) with their seed block behind (or before) the text."""
    docs = documents(spark, sf_dir)
    blocks = F.array(*map(F.lit, SEEDS[seed]))
    block = F.get(blocks, (F.col("doc_id") % len(SEEDS[seed])).cast("int"))
    text = F.coalesce("text", F.lit(""))
    content = F.concat(block, text) if front else F.concat(text, F.lit("\n\n"), block)
    return docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), content.alias("content"))


def hits(findings: DataFrame) -> DataFrame:
    return findings.select("file", "line", "severity", "category", "quote")


# -- language ----------------------------------------------------------------------------------------


@query
def lang_markers(spark, sf_dir):
    """Script and function-word counts of every text."""
    return language.with_markers(corpus(spark, sf_dir, "lang", True)).drop("content")


@query
def lang_detect(spark, sf_dir):
    """Language of every document, and whether that is certain."""
    return language.detect(corpus(spark, sf_dir, "lang", True)).select("file", "lang", "confident")


@query
def lang_path(spark, sf_dir):
    """Language named by the segments of every page's url, and whether its path is left out."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", language.path_language(F.coalesce("url", F.lit(""))).alias("lang"), F.coalesce(excluded(F.col("url")), F.lit(False)).alias("excluded"))


@query
def lang_override(spark, sf_dir):
    """A forced language."""
    return language.buckets(language.detect(corpus(spark, sf_dir, "lang", True), override="ja")).select("lang", "files", "first_file")


@query
def lang_buckets(spark, sf_dir):
    """Files of each language, the first of them, and how many are uncertain."""
    return language.buckets(language.detect(corpus(spark, sf_dir, "lang", True)))


@query
def lang_uncertain(spark, sf_dir):
    """Files whose language is a guess."""
    return language.uncertain(language.detect(corpus(spark, sf_dir, "lang", True)))


@query
def lang_conversations(spark, sf_dir):
    """Language counts of all conversation turns."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("conv"), "conv_id", "turn").alias("file"), F.coalesce("text", F.lit("")).alias("content"))
    return language.detect(turns).groupBy("lang", "confident").agg(F.count(F.lit(1)).alias("turns"))


# -- lines and fences --------------------------------------------------------------------------------


@query
def fence_mask(spark, sf_dir):
    """Fence state of every line of every document."""
    return line_ops.fenced_lines(corpus(spark, sf_dir, "es")).select("file", "line", "fence", "inside")


@query
def line_counts(spark, sf_dir):
    """Lines and structural lines of every document."""
    rows = line_ops.lines(corpus(spark, sf_dir, "ru"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(line_ops.is_structural(F.col("text"))).alias("n_structural"))


@query
def ru_paragraphs(spark, sf_dir):
    """Prose paragraphs of every document."""
    return line_ops.paragraphs(corpus(spark, sf_dir, "ru")).select("file", "start_line", F.size("lines").cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"), "next_start")


# -- scanners ----------------------------------------------------------------------------------------


@query
def p0_placeholders(spark, sf_dir):
    """Unfilled placeholders."""
    return scanners.placeholders(corpus(spark, sf_dir, "placeholder"), "en").select("file", "line", "severity", "category", "quote", "priority")


def _phrases(lang):
    def run(spark, sf_dir):
        return hits(scanners.phrase_scan(corpus(spark, sf_dir, "phrases"), lang)).drop("line")

    run.__name__ = f"phrases_{lang}"
    run.__doc__ = f"Phrases of the {lang} dictionary."
    return query(run)


for _lang in ("en", "ru", "ko", "vi", "ja", "es", "th", "my", "id"):
    _phrases(_lang)


@query
def phrases_dictionary(spark, sf_dir):
    """Phrases of a dictionary of any size, given as a table: every word of the conversations and every word pair of the benchmark."""
    words = lambda name: table(spark, sf_dir, name).select(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))
    listed = words("conversations").select(F.explode("w").alias("needle"), F.lit("weak").alias("kind"))
    listed = listed.unionByName(words("benchmark").where("size(w) > 1").select(F.explode(pairs).alias("needle"), F.lit("cliche").alias("kind")))
    return hits(dictionary.dictionary_scan(corpus(spark, sf_dir, "phrases"), listed.distinct(), "en")).drop("line")


def _english(category):
    def run(spark, sf_dir):
        rules = [r for r in english.RULES if r[1] == category and r[0] not in NOT_RE2]
        return hits(scanners.english_patterns(corpus(spark, sf_dir, "en"), rules=rules))

    run.__name__ = f"patterns_en_{category}"
    run.__doc__ = f"English rules of the category {category}."
    return query(run)


for _category in dict.fromkeys(r[1] for r in english.RULES):
    _english(_category)


@query
def patterns_en_not_re2(spark, sf_dir):
    """The three English rules with look-ahead or back references."""
    return hits(scanners.english_patterns(corpus(spark, sf_dir, "en"), rules=[r for r in english.RULES if r[0] in NOT_RE2]))


@query
def patterns_en_counts(spark, sf_dir):
    """The English rules that RE2 can express (all but ``NOT_RE2``) at once, counted by category."""
    found = scanners.english_patterns(corpus(spark, sf_dir, "en"), rules=[r for r in english.RULES if r[0] not in NOT_RE2])
    return found.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


@query
def lexicon_en(spark, sf_dir):
    """English stems."""
    return hits(scanners.english_lexicon(corpus(spark, sf_dir, "en"))).drop("line")


def _scanner(name, seed, scan, doc):
    def run(spark, sf_dir):
        return hits(scan(corpus(spark, sf_dir, seed)))

    run.__name__, run.__doc__ = name, doc
    return query(run)


_scanner("es_catalog", "es", scanners.spanish_catalog, "Spanish rules.")
_scanner("es_density", "es", scanners.spanish_density, "Spanish triads and poder + infinitive by density.")
_scanner("es_mente", "es", scanners.spanish_mente, "Chains of Spanish adverbs in -mente.")
_scanner("es_inciso", "es", scanners.spanish_inciso, "Spanish clauses between spaced dashes.")
_scanner("th_lint", "th", scanners.thai, "Thai rules.")
_scanner("my_lint", "my", scanners.burmese, "Burmese rules.")
_scanner("id_lint", "id", scanners.indonesian, "Indonesian rules.")
_scanner("ja_lint", "ja", scanners.japanese, "Japanese rules.")
_scanner("viet_lint", "vi", scanners.vietnamese, "Vietnamese rules (seed catalog).")
_scanner("ru_fragment_lead", "ru", lambda d: scanners.fragment_leads(line_ops.paragraphs(d)), "Russian stub sentences before a long rest.")
_scanner("ru_stub_paragraph", "ru", lambda d: scanners.stub_paragraphs(line_ops.paragraphs(d)), "Russian stub paragraphs.")
_scanner("ru_dash_density", "ru", lambda d: scanners.dash_density(line_ops.paragraphs(scanners.holds_dashes(d))), "Russian paragraphs dense with dashes.")
_scanner("ru_arrow_prose", "ru", lambda d: scanners.arrow_prose(line_ops.paragraphs(d)), "Arrows in Russian prose.")


# -- metrics -----------------------------------------------------------------------------------------


@query
def sentences_tokens(spark, sf_dir):
    """Sentences, tokens and distinct tokens of every document."""
    d = corpus(spark, sf_dir, "metrics").select("file", textmetrics.sentences(F.col("content")).alias("s"), textmetrics.word_tokens(F.col("content")).alias("t"))
    return d.select("file", F.size("s").cast("long").alias("n_sentences"), F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.length(F.array_join("s", "|")).cast("long").alias("joined"))


@query
def syllable_counts(spark, sf_dir):
    """Syllables of every distinct token of the corpus, with its number of occurrences."""
    d = corpus(spark, sf_dir, "metrics").select(F.explode(textmetrics.word_tokens(F.col("content"))).alias("token"))
    return d.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("syllables", textmetrics.syllables(F.col("token")).cast("long"))


@query
def text_metrics(spark, sf_dir):
    """All metrics of every document."""
    return textmetrics.analyze(corpus(spark, sf_dir, "metrics")).drop("content")


@query
def vocab_tells(spark, sf_dir):
    """Tier words and phrases of every document."""
    d = corpus(spark, sf_dir, "metrics").withColumn("__text", F.col("content"))
    found = textmetrics.vocabulary(d.withColumn("tokens", textmetrics.word_tokens(F.col("content"))))
    return found.select("file", F.col("tier1").cast("long").alias("tier1"), F.col("tier2").cast("long").alias("tier2"), F.col("phrase_tells").cast("long").alias("phrase_tells"))


@query
def score_verdict(spark, sf_dir):
    """Contributors, composite score and verdict of every document."""
    m = textmetrics.signals(textmetrics.analyze(corpus(spark, sf_dir, "metrics"), names=textmetrics.SCORED))
    return m.select("file", *(f"{k}_points" for k in ("burstiness", "diversity", "repetition", "lexical")), "score_raw", "score", "verdict")


@query
def metrics_findings(spark, sf_dir):
    """Documents whose score is a finding."""
    return scanners.metric_findings(corpus(spark, sf_dir, "metrics")).select("file", "severity", "category", "quote")


# -- findings from outside ---------------------------------------------------------------------------


def _outside(spark, sf_dir):
    """Synthetic outside issues by document: eight for every fifth document, two for the others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"))
    n = F.when(F.col("doc_id") % 5 == 0, 8).otherwise(2)
    kinds = F.array(*map(F.lit, ["tier1", "em-dash", "linkedin", "formatting", "odd", "ai-placeholder", "rhythm"]))
    grades = F.array(*map(F.lit, ["high", "medium", "low", "critical"]))
    quotes = F.array(*map(F.lit, ["Remember me", "meta_title — x", "a–b", "plain", "[your name]", "disable-file", "know"]))
    rows = docs.select("doc_id", "file", F.explode(F.sequence(F.lit(1), n)).alias("k"))
    pick = lambda a, m: F.get(a, ((F.col("doc_id") + F.col("k")) % m).cast("int"))
    return rows.select("doc_id", "file", F.col("k"), pick(kinds, 7).alias("type"), pick(quotes, 7).alias("text"), pick(grades, 4).alias("severity"))


@query
def ext_en_adapter(spark, sf_dir):
    """Outside English issues as findings."""
    return scanners.external_english(_outside(spark, sf_dir)).select("tool", "lang", "file", "severity", "category", "quote")


@query
def ext_ru_adapter(spark, sf_dir):
    """Outside Russian results as findings, with the genre asked for."""
    docs = table(spark, sf_dir, "pages").select(F.concat(F.lit("/site/"), F.when(F.col("page_id") % 3 == 0, "docs/").otherwise("blog/"), F.col("page_id").cast("string"), F.lit(".md")).alias("file"), "page_id")
    marker = lambda c, q, n: F.struct(F.lit(c).alias("category"), q.cast("string").alias("quote"), n.cast("int").alias("count"))
    results = docs.select("file", F.array(marker("Тире", F.lit("a — b"), F.col("page_id") % 3), marker("Канцелярит", F.lit(None), F.lit(2))).alias("markers"), F.array(F.struct(F.lit("Тире").alias("category"), F.lit(1).alias("count"))).alias("hard_bans"))
    found = scanners.external_russian(results)
    return found.select("file", scanners.russian_genre(F.col("file")).alias("genre"), "severity", "category", "quote")


def _russian_output(spark, sf_dir):
    """Outputs of the outside Russian tool as it prints them, of which some are broken; some runs end with another code."""
    pages = table(spark, sf_dir, "pages")
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r'["\\\x00-\x1F]', "")
    good = F.concat(F.lit('{"markers":[["Тире","'), url, F.lit('",2],["Канцелярит",null,0]],"hard_bans":[["Тире",1]]}\n{"markers":[["later","x",1]]}'))
    kinds = F.when(F.col("page_id") % 11 == 3, "Traceback").when(F.col("page_id") % 11 == 5, "").when(F.col("page_id") % 11 == 7, '{"markers":[').when(F.col("page_id") % 11 == 9, "[]").otherwise(good)
    code = F.when(F.col("page_id") % 13 == 4, 2).otherwise(F.col("page_id") % 2)
    results = pages.select(F.concat(F.lit("p-"), F.col("page_id").cast("string")).alias("file"), kinds.alias("stdout"), code.alias("code"), F.when(F.col("page_id") % 26 == 4, "no module").otherwise("").alias("stderr"))
    return scanners.russian_results(results)


@query
def ext_ru_output(spark, sf_dir):
    """Findings in the printed results of the outside Russian tool."""
    return scanners.external_russian(_russian_output(spark, sf_dir)).select("file", "severity", "category", "quote")


@query
def ext_ru_errors(spark, sf_dir):
    """Which outputs of the outside Russian tool can't be read, and why."""
    return _russian_output(spark, sf_dir).select("file", "error")


@query
def ext_ko_adapter(spark, sf_dir):
    """Outside Korean output as findings."""
    bands = F.array(*map(F.lit, ["low", "medium", "high"]))
    pages = table(spark, sf_dir, "pages")
    stdout = F.when(F.col("page_id") % 7 == 0, "no output").otherwise(F.concat(F.lit("x risk_band="), F.get(bands, (F.col("page_id") % 3).cast("int")), F.lit(" risk_score="), (F.col("page_id") % 100).cast("string"), F.lit(" route_hint=r1 end")))
    return scanners.external_korean(pages.select(F.concat(F.lit("p-"), F.col("page_id").cast("string")).alias("file"), stdout.alias("stdout"))).select("file", "severity", "category", "quote")


@query
def ext_ja_adapter(spark, sf_dir):
    """Outside Japanese JSON as findings; malformed ones are skipped."""
    pages = table(spark, sf_dir, "pages")
    value = F.concat(F.lit('{"findings":[{"line":'), (F.col("page_id") % 9).cast("string"), F.lit(',"category":"no_chain","excerpt":"x","severity":"warn"},{"category":"broken"},{"category":"kanji_run","excerpt":"'), F.col("page_id").cast("string"), F.lit('"}]}'))
    return scanners.external_japanese(pages.select(F.concat(F.lit("p-"), F.col("page_id").cast("string")).alias("file"), value.alias("stdout"))).select("file", "line", "severity", "category", "quote")


@query
def ext_ja_errors(spark, sf_dir):
    """Which outputs of the outside Japanese tool can't be read, and why."""
    pages = table(spark, sf_dir, "pages")
    kinds = F.array(*map(F.lit, ['{"findings":[]}', "not json", '{"x":1}', '{"findings":{}}', "", '{"findings":[{"category":"a","excerpt":"b"}]} ', '{"findings":[']))
    results = pages.select(F.concat(F.lit("p-"), F.col("page_id").cast("string")).alias("file"), F.get(kinds, (F.col("page_id") % 7).cast("int")).alias("stdout"))
    return scanners.japanese_errors(results).select("file", "error")


def _japanese_results(spark, sf_dir):
    """Synthetic outputs of the outside Japanese tool, of which some are broken."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"))
    stdout = F.when(F.col("doc_id") % 50 == 7, "Traceback").when(F.col("doc_id") % 50 == 9, '{"x":1}').otherwise('{"findings":[{"category":"a","excerpt":"b"}]}')
    return docs.select("file", stdout.alias("stdout"))


def _failed(spark, sf_dir):
    """Findings and runs of a Japanese audit in which the outside tool failed on some files."""
    results = _japanese_results(spark, sf_dir)
    failed = scanners.japanese_failures(results)
    docs = corpus(spark, sf_dir, "placeholder")
    found = report.without_failed(scanners.union([scanners.placeholders(docs, "ja"), scanners.external_japanese(results)]), failed)
    return found, report.tool_runs(language.buckets(language.detect(docs, override="ja")), found, ["natural-japanese"], failed)


@query
def tool_runs_failed(spark, sf_dir):
    """Runs of an audit in which an outside tool gave broken output: it failed, and its findings don't count."""
    return _failed(spark, sf_dir)[1]


@query
def summary_failed(spark, sf_dir):
    """Summary of that audit: it is incomplete, exit code 2."""
    found, runs = _failed(spark, sf_dir)
    return report.summary(triage(found), runs)


@query
def json_values(spark, sf_dir):
    """JSON values written one after the other, taken apart; some texts are broken in one way or another."""
    pages = table(spark, sf_dir, "pages")
    ends = ["3", '{"x":', ' "s}{[" ', "[{\"a\":1} {\"b\":2}]", "3 {\"a\":1}", "[]", '{"q":"\\\\\\"} [{\\\\"}true', " ", "] {}", '"open']
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r'["\\\x00-\x1F]', "")
    raw = F.concat(F.lit(' {"a":"}'), url, F.lit('"} [1,{"b":[2, 3]}]\n'), F.get(F.array(*map(F.lit, ends)), (F.col("page_id") % len(ends)).cast("int")))
    found = concatenated(pages.select("page_id", raw.alias("raw")), "raw")
    return found.select("page_id", F.size("values").cast("long").alias("n_values"), F.col("error").isNotNull().alias("broken"), F.array_join("values", " ").alias("joined"))


# -- triage and report -------------------------------------------------------------------------------


def _triaged(spark, sf_dir, rules=None):
    """Outside issues, English phrases, Russian and Thai findings together, triaged."""
    outside = scanners.external_english(_outside(spark, sf_dir))
    russian = line_ops.paragraphs(scanners.holds_dashes(corpus(spark, sf_dir, "ru")))
    built_in = [scanners.phrase_scan(corpus(spark, sf_dir, "phrases"), "en"), scanners.dash_density(russian), scanners.thai(corpus(spark, sf_dir, "th"))]
    return triage(outside, rules, built_in=scanners.union(built_in))


@query
def aaw_gate(spark, sf_dir):
    """Files over the gate of the outside English tool."""
    return with_gate(scanners.external_english(_outside(spark, sf_dir))).where("gate_broken").groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query
def triage_priority(spark, sf_dir):
    """Priority of every finding."""
    return _triaged(spark, sf_dir, []).select("tool", "file", "line", "severity", "category", "quote", "priority")


@query
def suppression(spark, sf_dir):
    """Findings that the built-in rules suppress, with the reason."""
    return _triaged(spark, sf_dir).where("fp_suppressed").select("tool", "file", "category", "quote", "fp_reason")


def _rule_table(spark, sf_dir):
    """Five suppression rules for each document: by file, by glob, by part of the quote, with tools and categories."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"))
    of = lambda names: F.get(F.array(*map(F.lit, names)), (F.col("d") % len(names)).cast("int"))
    name, text = F.col("d").cast("string"), lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    category = of(["tier1", "em-dash", "ai-phrase", "formatting", "ru:dash-density"])
    rules = [
        {"file": text("doc-", name, ".md"), "category": category},
        {"file": text("**/doc-", name, "?.md"), "tool": F.lit("th-lint")},
        {"file": text("doc-*", name, ".md"), "category": F.lit("odd"), "quoteContains": F.lit("A–")},
        {"tool": F.lit("avoid-ai-writing"), "quoteContains": text(of(["member", "title", "PLAIN", "know"]), of(["", "x", " me", ""]))},
        {"quoteContains": text(name, " ", name)},
    ]
    none = F.lit(None).cast("string")
    row = lambda k, r: F.struct((F.col("d") * len(rules) + k).alias("ord"), *(r.get(c, none).cast("string").alias(c) for c in ("file", "tool", "category", "quoteContains")), text("rule ", name, "/", str(k)).alias("reason"))
    return docs.select(F.inline(F.array(*(row(k, r) for k, r in enumerate(rules)))))


@query
def suppression_table(spark, sf_dir):
    """Findings that a large table of rules suppresses, and the first rule that fits each."""
    return _triaged(spark, sf_dir, _rule_table(spark, sf_dir)).where("fp_suppressed").select("tool", "file", "line", "category", "quote", "fp_reason")


@query
def findings_order(spark, sf_dir):
    """The place of every finding of phrases, Thai and Japanese rules in the order of a report, with detected languages."""
    found = routed(corpus(spark, sf_dir, "audit", True), path=work_path(spark))
    # a range sort reads its input twice, once for the sample of its bounds
    findings = order.kept(scan(found, tools=["phrases", "th-lint", "ja-lint"]), "findings")
    return order.positions(findings, language.buckets(found)).select("position", "lang", "tool", "file", "line", "category", "quote")


@query
def catalog_runtime(spark, sf_dir):
    """Rules of a catalog that is read at run time, two of which are broken and dropped."""
    text = resources.files("prosewell.catalogs").joinpath("sample.json").read_text("utf-8")
    rules = catalogs.parse(spark, text, "sample.json")
    own = registry.Registry(registry.catalog_scanner("sample", ("en",), rules, "own:"))
    docs = corpus(spark, sf_dir, "en").withColumn("lang", F.lit("en"))
    return hits(own.scan(docs, ["en"])[0])


@query
def report_lines(spark, sf_dir):
    """The report's lines."""
    return report.report_lines(_triaged(spark, sf_dir)).select("section", "tool", "file", "line", "text")


@query
def tool_runs(spark, sf_dir):
    """Runs of the Thai and of the Russian audit, the latter with an outside tool that is missing."""
    return scanners.union([audit(corpus(spark, sf_dir, lang), override=lang).runs for lang in ("th", "ru")])


@query
def audit_spanish(spark, sf_dir):
    """The Spanish audit, by tool, priority and suppression."""
    found = audit(corpus(spark, sf_dir, "es"), override="es").findings
    return found.groupBy("lang", "tool", "priority", "fp_suppressed").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


@query
def report_summary(spark, sf_dir):
    """Counts by priority, failures and exit code of an audit with forced language and outside findings."""
    docs = corpus(spark, sf_dir, "en")
    built_in = scanners.union([scanners.english_lexicon(docs), scanners.phrase_scan(docs, "en"), scanners.placeholders(corpus(spark, sf_dir, "placeholder"), "en")])
    found = triage(scanners.external_english(_outside(spark, sf_dir)), built_in=built_in)
    # a summary counts runs that failed, not the findings of each, for which all would be made again
    runs = report.run_states(language.buckets(language.detect(docs, override="en")), ["avoid-ai-writing"])
    return report.summary(found, runs)


@query
def audit_full(spark, sf_dir):
    """The full audit with detected languages, by language, tool and priority."""
    found = audit(corpus(spark, sf_dir, "audit", True)).findings
    return found.groupBy("lang", "tool", "priority").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


def _audit_of(docs: DataFrame) -> DataFrame:
    found = audit(docs).findings
    return found.groupBy("lang", "tool", "category", "priority").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


@query
def audit_conversations(spark, sf_dir):
    """The audit of every turn of every conversation, as it is."""
    turns = spread(table(spark, sf_dir, "conversations"))
    return _audit_of(turns.select(F.concat_ws("-", F.lit("conv"), "conv_id", "turn").alias("file"), F.coalesce("text", F.lit("")).alias("content")))


@query
def audit_pages(spark, sf_dir):
    """The audit of every page's markup, as it is."""
    return _audit_of(table_documents(spread(table(spark, sf_dir, "pages")), "page_id", "html", "page"))
