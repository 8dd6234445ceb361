"""Scanners: documents (file, content) of one language in, findings out.

Each scanner is a projection and an explode, without an exchange; rules are compiled into the plan as literals. The
hits of a scanner are a column expression over a line, a paragraph or a document, so that ``plans.fused`` can put
those of all scanners of a language into one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewell.catalogs import english, others, phrases, triage
from prosewell.catalogs import metrics as M
from prosewell.functions import textmetrics
from prosewell.functions.regexes import SPACES, collapsed, general, holds_one, holds_one_of_sql, literal, literals_sql, masked, occurrences, occurrences_sql, required, trimmed, trimmed_left
from prosewell.functions.regexes import english as english_rule
from prosewell.operators.lines import fence_states, fenced_lines, lines, paragraphs
from prosewell.schema import QUOTE, finding, short, weighted
from prosewell.sources.json_values import concatenated


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _together(hits: list[Column]) -> Column:
    return hits[0] if len(hits) == 1 else F.flatten(F.array(*hits))


def _exploded(base: DataFrame, hits: Column, keep: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """One row per entry of an array of hits."""
    return textmetrics.each(base, keep, hits, "h").select(*keep, "h.category", "h.severity", "h.quote", "h.seq")


def _line_findings(base: DataFrame, hits: Column, tool: str, lang: str) -> DataFrame:
    rows = _exploded(base, hits)
    return finding(rows, tool, lang, F.col("line"), F.col("severity"), F.col("category"), F.col("quote"), seq=F.col("seq"))


def _all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Non-empty matches of a pattern in a text."""
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda q: q != "")


def _seq(*places: int | Column) -> Column:
    return F.array(*((F.lit(x) if isinstance(x, int) else x).cast("int") for x in places))


def _hit(category: str | Column, severity: str | Column | None, quote: Column, *places: int | Column) -> Column:
    """A hit, and its place in the order in which its tool goes through a document."""
    text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return F.struct(text(category).alias("category"), text(severity).alias("severity"), quote.alias("quote"), _seq(*places).alias("seq"))


_NO_HITS = "array<struct<category string, severity string, quote string, seq array<int>>>"


def no_hits() -> Column:
    return F.array().cast(_NO_HITS)


def _when_possible(lowered: Column, pattern: str, hits: Column) -> Column:
    """The hits, looked for only where a literal that every match holds is there."""
    literals = required(pattern)
    return hits if not literals else F.when(holds_one(lowered, literals), hits).otherwise(no_hits())


# -- all languages -----------------------------------------------------------------------------------


def placeholder_hits(text: Column, low: Column, line: Column) -> Column:
    hits = []
    for n, (pattern, ignore) in enumerate(triage.PLACEHOLDERS):
        q = F.transform(_all_matches(text, general(pattern, ignore)), _numbered("p0-placeholder", "critical", lambda m: m, n, line))
        hits.append(_when_possible(low, pattern, q))
    shown = ~(F.contains(text, F.lit("<!--")) & text.rlike(f"^[{SPACES}]*<!--")) & ~F.contains(text, F.lit("```"))
    return F.when(shown, _together(hits)).otherwise(no_hits())


def _numbered(category: str, severity: str | None, cut, *places: int | Column):
    """A match and its number as a hit."""
    return lambda m, k: _hit(category, severity, cut(m), *places, k)


def placeholders(docs: DataFrame, lang: str | None = None) -> DataFrame:
    """Unfilled placeholders, outside of comment lines and code fences; priority P0 from the start.

    Without ``lang``, documents of all languages are read in one pass and their column ``lang`` is taken.
    """
    keep = ("file",) if lang else ("file", "lang")
    found = lines(docs, keep=keep).withColumn("__low", F.lower("text"))
    rows = _exploded(found, placeholder_hits(F.col("text"), F.col("__low"), F.col("line")), (*keep, "line"))
    return finding(rows, "placeholder", lang or F.col("lang"), F.col("line"), F.col("severity"), F.col("category"), F.col("quote"), "P0", F.col("seq"))


def passes_floor(needle: str) -> bool:
    """Latin and Cyrillic needles need four characters; denser scripts none."""
    dense = any(0xAC00 <= ord(c) <= 0xD7AF or 0x1EA0 <= ord(c) <= 0x1EF9 or c.lower() in "ăâêôơưđ" or 0x3040 <= ord(c) <= 0x30FF or 0x4E00 <= ord(c) <= 0x9FFF or 0x0E00 <= ord(c) <= 0x0E7F or 0x1000 <= ord(c) <= 0x109F for c in needle)
    return dense or len(needle) >= 4


def phrase_needles(lang: str) -> list[tuple[str, str]]:
    """(needle, kind) of a language; a cliché outranks a weak phrase of the same words."""
    out: dict[str, str] = {}
    for kind, lists in (("cliche", (phrases.SEED_CLICHES, phrases.CLICHES)), ("weak", (phrases.SEED_WEAK, phrases.WEAK))):
        for table in lists:
            for needle in table.get(lang, []):
                if passes_floor(needle):
                    out.setdefault(needle, kind)
    return list(out.items())


def phrase_hits(low: str, needles: list[tuple[str, str]]) -> Column:
    """Hits on the column ``low`` of lower-cased texts, in the order of the needles."""
    if not needles:
        return no_hits()
    found = ", ".join(f"named_struct('needle', {literal(needle)}, 'kind', {literal(kind)}, 'at', {at}, 'n', {occurrences_sql(low, needle.lower())})" for at, (needle, kind) in enumerate(needles))
    severity = lambda h: F.when(h["n"] >= 3, "high").when(h["kind"] == "cliche", "phrase").otherwise("weak")
    counts = F.expr(f"filter(array({found}), h -> h.n > 0 AND (h.n > 1 OR h.kind <> 'weak'))")
    return F.transform(counts, lambda h: _hit("ai-phrase", severity(h), counted(h["needle"], h["n"]), h["at"]))


def phrase_scan(docs: DataFrame, lang: str, needles: list[tuple[str, str]] | None = None) -> DataFrame:
    """Counted phrases of a document: clichés from one, weak phrases from two, three or more are high."""
    low = docs.select("file", F.lower("content").alias("__low"), F.lit(None).cast("int").alias("line"))
    found = phrase_needles(lang) if needles is None else needles
    if not found:
        return finding(docs.limit(0), "phrases", lang)
    return _line_findings(low, phrase_hits("__low", found), "phrases", lang)


def counted(quote: Column, n: Column) -> Column:
    """The quote, with its count where that is over one."""
    return F.concat(quote, F.when(n > 1, F.concat(F.lit(" ×"), n.cast("string"))).otherwise(""))


# -- English -----------------------------------------------------------------------------------------


def _english_literals(rules: list) -> list[str]:
    return sorted({x for r in rules for x in required(r[3]) or []})


def english_literals(rules: list) -> Column:
    """The literals that rules need and that a line's lower-cased masked text ``__low`` holds; looked for at once, not one by one."""
    literals = _english_literals(rules)
    return F.expr(literals_sql("__low", literals)) if literals else F.array().cast("array<string>")


def english_gate(rules: list) -> str:
    """Does a line with its ``__literals`` hold anything that a rule needs?"""
    return "size(__literals) > 0" if all(required(r[3]) for r in rules) else "true"


def english_hits(rules: list) -> Column:
    """Hits on the columns text, __masked, __literals and line."""
    hits, literals = [], _english_literals(rules)
    for n, (name, cat, w, rx) in enumerate(rules):
        pattern = literal(english_rule(rx))
        found = f"regexp_extract(__masked, {pattern}, 0)"
        quote = f"substring(text, regexp_instr(__masked, {pattern}), length({found}))"
        hits.append(f"CASE WHEN {holds_one_of_sql('__literals', required(rx), literals) if required(rx) else 'true'} AND {found} <> '' THEN named_struct('category', {literal(f'zs:{cat}/{name}')}, 'severity', '{weighted(w)}', 'quote', substring({quote}, 1, {QUOTE}), 'seq', array({n}, line)) END")
    return F.expr(f"filter(array({', '.join(hits)}), h -> h is not null)")


def english_patterns(docs: DataFrame, categories: list[str] | None = None, rules: list | None = None) -> DataFrame:
    """The first non-empty match of each rule on each line, found on masked text and quoted from the line itself."""
    rules = [r for r in (english.RULES if rules is None else rules) if categories is None or r[1] in categories]
    base = lines(docs).where(F.length("text") > 2).withColumn("__m", masked(F.col("text")))
    base = textmetrics.fenced_off(base, ["file", "line"], {"text": F.col("text"), "__masked": F.col("__m"), "__low": F.lower("__m")})
    base = textmetrics.fenced_off(base, ["file", "line", "text", "__masked"], {"__literals": english_literals(rules)})
    return _line_findings(base.where(F.expr(english_gate(rules))), english_hits(rules), "patterns-en", "en")


def lexicon_hits(low: str) -> Column:
    """Hits on the column ``low`` of lower-cased texts. Which stems a text holds is found in one pass; only those are counted."""
    first = len(english.RULES)  # stems come behind the rules
    stems = [(stem.lower(), stem, w) for stem, w in english.LEXICON.items()]
    listed = ", ".join(f"named_struct('low', {literal(x)}, 'stem', {literal(stem)}, 'severity', '{weighted(w, 5)}', 'at', {first + at})" for at, (x, stem, w) in enumerate(stems))
    # at each place the longest stem is found, so a shorter one is there if one that begins with it was
    found = literals_sql(low, sorted({x for x, _, _ in stems}))
    held = f"transform(array({found}), f -> filter(array({listed}), s -> exists(f, x -> startswith(x, s.low))))[0]"
    counts = F.transform(F.expr(held), lambda s: F.struct(s["stem"].alias("stem"), s["severity"].alias("severity"), s["at"].alias("at"), ((F.length(low) - F.length(F.replace(F.col(low), s["low"], F.lit("")))) / F.length(s["low"])).cast("int").alias("n")))
    return F.transform(counts, lambda h: _hit("zs:lexicon", h["severity"], counted(h["stem"], h["n"]), h["at"]))


def english_lexicon(docs: DataFrame) -> DataFrame:
    """Stems counted over the whole document, one finding per stem."""
    low = docs.select("file", F.lower("content").alias("__low"), F.lit(None).cast("int").alias("line"))
    return _line_findings(low, lexicon_hits("__low"), "patterns-en", "en")


def metric_hits() -> Column:
    """The hit of a document with the columns of ``textmetrics.signals``, if its score reaches the bound."""
    quote = F.concat(F.lit("score="), F.col("score").cast("string"), F.lit("/100"), *(F.concat(F.lit(f" {k}="), F.expr(f"format_number({k}_points, '0.###')")) for k in M.WEIGHTS))
    hit = _hit("humanizer-score", F.when(F.col("score") >= M.HIGH, "high").otherwise("medium"), short(quote), 0)
    return F.when(F.col("score") >= M.FINDING, F.array(hit)).otherwise(no_hits())


def metric_findings(docs: DataFrame) -> DataFrame:
    """Documents whose composite score reaches the bound, with the points of each contributor."""
    scored = textmetrics.signals(textmetrics.analyze(docs.select("file", "content"), names=textmetrics.SCORED)).where(F.col("score") >= M.FINDING)
    return _line_findings(scored.withColumn("line", F.lit(None).cast("int")), metric_hits(), "metrics", "en")


# -- rule catalogs -----------------------------------------------------------------------------------


def catalog_hits(rules: list, text: Column, low: Column, line: Column, prefix: str = "") -> Column:
    hits = []
    for n, (_, cat, w, rx) in enumerate(rules):
        q = F.transform(_all_matches(text, general(rx)), _numbered(prefix + cat, weighted(w), lambda m: short(trimmed(m)), n, line))
        hits.append(_when_possible(low, rx, q))
    return _together(hits) if hits else no_hits()


def catalog_scan(docs: DataFrame, tool: str, lang: str, rules: list, prefix: str = "") -> DataFrame:
    """Every match of every rule. No rule matches across lines, so lines are scanned and give the line number."""
    base = textmetrics.fenced_off(lines(docs), ["file", "line"], {"text": F.col("text"), "__low": F.lower("text")})
    return _line_findings(base, catalog_hits(rules, F.col("text"), F.col("__low"), F.col("line"), prefix), tool, lang)


def thai(docs: DataFrame) -> DataFrame:
    return catalog_scan(docs, "th-lint", "th", others.THAI)


def burmese(docs: DataFrame) -> DataFrame:
    return catalog_scan(docs, "my-lint", "my", others.BURMESE)


def indonesian(docs: DataFrame) -> DataFrame:
    return catalog_scan(docs, "id-lint", "id", others.INDONESIAN)


def japanese_hits(rules: list, text: Column, line: Column) -> Column:
    hits = []
    for n, (rule, severity, patterns, needles) in enumerate(rules):
        for at, rx in enumerate(patterns):
            hits.append(F.transform(_all_matches(text, general(rx, False)), _numbered(rule, severity, trimmed, line, n, at)))
        for at, needle in enumerate(needles, len(patterns)):
            times = F.array_repeat(F.lit(needle), occurrences(text, needle))
            hits.append(F.transform(times, _numbered(rule, severity, lambda m: m, line, n, at)))
    return _together(hits)


def japanese(docs: DataFrame, rules: list | None = None) -> DataFrame:
    """Every match of a rule's patterns and every occurrence of its phrases, line by line."""
    return _line_findings(lines(docs), japanese_hits(others.JAPANESE if rules is None else rules, F.col("text"), F.col("line")), "ja-lint", "ja")


def vietnamese_hits(rules: list, text: Column, low: Column, line: Column) -> Column:
    hits = []
    for n, (rule, severity, patterns, needles) in enumerate(rules):
        if not rule.startswith("VI-HUM"):
            continue
        quotes = F.array().cast("array<string>")
        if patterns:
            quotes = F.flatten(F.array(*(_all_matches(text, general(rx)) for rx in patterns)))
        if needles:
            first = F.coalesce(*(F.when(F.contains(low, F.lit(x.lower())), x.lower()) for x in needles))
            quotes = F.when(F.size(quotes) > 0, quotes).otherwise(F.filter(F.array(first), lambda q: q.isNotNull()))
        hits.append(F.transform(quotes, _numbered(rule, severity, short, n, line)))
    return _together(hits) if hits else no_hits()


def vietnamese(docs: DataFrame, rules: list | None = None) -> DataFrame:
    """Matches of a rule's patterns; only where there is none, the first of its phrases that the line holds."""
    base = lines(docs).withColumn("__low", F.lower("text"))
    return _line_findings(base, vietnamese_hits(phrases.VIETNAMESE if rules is None else rules, F.col("text"), F.col("__low"), F.col("line")), "viet-lint", "vi")


# -- Spanish -----------------------------------------------------------------------------------------

_LETTERS = "A-Za-z0-9_áéíóúñüÁÉÍÓÚÑÜ"
#: Patterns that must match as they are (TRIAD, PODER, INCISO).
TRIAD = rf"[{_LETTERS}]+,[{SPACES}]+[{_LETTERS}]+[{SPACES}]+[yY][{SPACES}]+[{_LETTERS}]+"
PODER = r"\b(?:puedo|puedes|puede|podemos|podáis|pueden|podría|podrías|podríamos|podrían|podré|podrás|podréis|podremos|podrán)\s+[\wáéíóúñü]+(?:ar|er|ir)(?:lo|la|le|los|las|nos|se)?\b"
INCISO = " — [^—\n.!?]+? — "
DENSE = 3


def spanish_catalog(docs: DataFrame) -> DataFrame:
    return catalog_scan(docs, "es-lint", "es", others.SPANISH, "es:")


def density_counts(states: Column) -> dict[str, Column]:
    """Triads and poder + infinitive on the lines outside of fences."""
    free = F.filter(states, lambda x: ~x["inside"])
    # the last letter in front of the comma stands for its word, which no match before it can share in part
    triad = TRIAD.replace("]+,", "],", 1)
    total = lambda count: F.aggregate(F.transform(free, lambda x: count(x["text"])), F.lit(0).cast("long"), lambda a, n: a + n)
    triads = total(lambda t: F.when(F.contains(t, F.lit(",")), F.regexp_count(t, F.lit(triad))).otherwise(0))
    poder = total(lambda t: F.when(holds_one(F.lower(t), ["pued", "pod"]), F.regexp_count(t, F.lit(general(PODER, True)))).otherwise(0))
    return {"__triads": triads, "__poder": poder}


def density_hits() -> Column:
    """Hits of a document with the columns of ``density_counts``; three or more are a finding."""
    first = len(others.SPANISH)  # behind the rules
    times = lambda what, n: F.concat(F.lit(what), F.lit(" ×"), n.cast("string"))
    triads = F.when(F.col("__triads") >= DENSE, _hit("es:triads", "high", times("triads", F.col("__triads")), first))
    poder = F.when(F.col("__poder") >= DENSE, _hit("es:poder_infinitivo", "medium", times("poder+infinitivo", F.col("__poder")), first + 1))
    return F.filter(F.array(triads, poder), lambda h: h.isNotNull())


def mente_hits(text: Column, low: Column, line: Column) -> Column:
    adverbs = lambda s: F.filter(F.regexp_extract_all(s, F.lit(f"[{_LETTERS}]+"), F.lit(0)), lambda w: F.lower(w).rlike(r"...mente\z"))
    chains = F.filter(F.transform(F.split(text, f"[.!?][{SPACES}]", -1), adverbs), lambda a: F.size(a) >= 2)
    hits = F.transform(F.slice(chains, 1, 1), lambda a: _hit("es:mente_adverb_chain", "medium", short(F.array_join(F.slice(a, 1, 3), ", ")), len(others.SPANISH) + 2, line))
    return F.when(F.contains(low, F.lit("mente")), hits).otherwise(no_hits())


def inciso_hits(text: Column, line: Column) -> Column:
    return F.when(F.contains(text, F.lit(" — ")) & text.rlike(INCISO), F.array(_hit("es:em_dash_inciso", "medium", short(trimmed(text)), len(others.SPANISH) + 3, line))).otherwise(no_hits())


def spanish_density(docs: DataFrame) -> DataFrame:
    """Triads and poder + infinitive, counted per document outside of fences; three or more are a finding."""
    counts = textmetrics.fenced_off(docs, ["file"], density_counts(fence_states(F.col("content"))))
    return _line_findings(counts.withColumn("line", F.lit(None).cast("int")), density_hits(), "es-lint", "es")


def spanish_mente(docs: DataFrame) -> DataFrame:
    """A line's first sentence with two adverbs in -mente or more; it quotes the first three."""
    return _line_findings(fenced_lines(docs).where("not inside"), mente_hits(F.col("text"), F.lower("text"), F.col("line")), "es-lint", "es")


def spanish_inciso(docs: DataFrame) -> DataFrame:
    """Lines with a clause between spaced dashes."""
    return _line_findings(fenced_lines(docs).where("not inside"), inciso_hits(F.col("text"), F.col("line")), "es-lint", "es")


def spanish(docs: DataFrame) -> DataFrame:
    return union([spanish_catalog(docs), spanish_density(docs), spanish_mente(docs), spanish_inciso(docs)])


# -- Russian -----------------------------------------------------------------------------------------

# Lengths, counts, and abbreviations that do not end a sentence.
LEAD, BODY, LEAD_WORDS, DASHES, MANY_DASHES = 35, 100, 2, 3, 5
ABBREVIATIONS = ["т", "и", "д", "п", "г", "ч", "к", "у", "об", "н", "о", "см", "рис", "стр", "вв", "тыс", "млн", "млрд", "пр", "др", "пп", "ул"]


#: What hits read of a paragraph besides its text and lines.
PARAGRAPH = ("__start", "__end", "__trimmed", "__dashes")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != ""))


def is_boundary(text: Column, at: Column) -> Column:
    """Does the punctuation at position ``at`` (from 1) end a sentence?"""
    rest = F.substring(text, at + 1, F.length(text))
    before = F.regexp_extract(F.substring(text, F.lit(1), at - 1), f"([^{SPACES}]+)\\z", 1)
    free = (rest == "") | rest.rlike(f"^[{SPACES}]")
    return free & ~rest.rlike(f"^[{SPACES}]+[0-9]") & (F.length(before) > 1) & ~F.lower(before).isin(*ABBREVIATIONS)


def first_sentence_end(text: Column, within: int | None = None) -> Column:
    """Position (from 1) of the first punctuation that ends a sentence, or null; only the first ``within`` are tried."""
    size = F.length(text) if within is None else F.least(F.length(text), F.lit(within))
    at = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(text, i, F.lit(1)).isin(".", "!", "?", "…"))
    return F.get(F.filter(at, lambda i: is_boundary(text, i)), F.lit(0))


def paragraph_columns(names: tuple[str, ...] = PARAGRAPH) -> dict[str, Column]:
    """What the hits of a paragraph (start_line, lines, text) ask for, or those of ``names``."""
    start = trimmed_left(F.col("text"))
    # a stub ends before position 35 of the left-trimmed text; later ends cannot give one. A digit behind the white space after the
    # punctuation tells that it ends nothing, so the first character behind that space is looked at, too, wherever it stands.
    behind = F.substring(trimmed_left(F.substring(start, LEAD + 1, 1 << 30)), 1, 1)
    head = F.array(F.concat(F.substring(start, 1, LEAD), behind))
    end = F.get(F.transform(head, lambda h: F.when(h.rlike("[.!?…]"), first_sentence_end(h, LEAD - 1))), F.lit(0))
    per_line = lambda x: F.when(F.contains(x, F.lit("—")), F.length(F.regexp_replace(F.regexp_replace(x, f"^[{SPACES}]*—", ""), "[^—]", ""))).otherwise(0)
    dashes = F.aggregate(F.transform("lines", per_line), F.lit(0), lambda a, n: a + n)
    found = {"__start": start, "__end": end, "__trimmed": trimmed(F.col("text")), "__dashes": dashes}
    return {k: found[k] for k in names}


def _in_paragraph(category: str, severity: str | Column, quote: Column, detector: int, line: Column | None = None) -> Column:
    """A hit whose last place is its line."""
    first = F.col("start_line")
    return _hit(category, severity, short(quote), first, detector, first if line is None else line)


def _if(condition: Column, hit: Column) -> Column:
    return F.when(condition, F.array(hit)).otherwise(no_hits())


def lead_hits() -> Column:
    stub = trimmed(F.substring(F.col("__start"), F.lit(1), F.col("__end")))
    rest = trimmed(F.substring(F.col("__start"), F.col("__end") + 1, F.length("__start")))
    fits = F.col("__end").isNotNull() & (F.length(stub) < LEAD) & (F.length(stub) > 0) & (word_count(stub) >= LEAD_WORDS) & (F.length(rest) >= BODY)
    return _if(fits, _in_paragraph("ru:fragment-lead", "medium", stub, 0))


def stub_hits() -> Column:
    t = F.col("__trimmed")
    near = F.col("next_start") - (F.col("start_line") + F.size("lines") - 1) == 2
    fits = (F.length(t) < LEAD) & t.rlike(r"[.!?…]\z") & (word_count(t) >= LEAD_WORDS) & near & (F.length(trimmed(F.col("next_text"))) >= BODY)
    return _if(fits, _in_paragraph("ru:fragment-lead", "medium", t, 1))


def dash_hits() -> Column:
    n = F.col("__dashes")
    quote = F.concat(F.lit("×"), n.cast("string"), F.lit(" "), trimmed(collapsed(F.col("text"))))
    return _if(n >= DASHES, _in_paragraph("ru:dash-density", F.when(n >= MANY_DASHES, "high").otherwise("medium"), quote, 2))


def arrow_hits() -> Column:
    counts = F.filter(F.transform("lines", lambda x, k: F.struct(x.alias("x"), k.alias("k"), prose_arrows(x).alias("n"))), lambda c: c["n"] > 0)
    severity = lambda n: F.when(n >= 2, "high").otherwise("medium")
    hits = F.transform(counts, lambda c: _in_paragraph("ru:arrow-prose", severity(c["n"]), counted(trimmed(c["x"]), c["n"]), 3, F.col("start_line") + c["k"]))
    return F.when(F.contains("text", F.lit("→")), hits).otherwise(no_hits())


def _paragraph_findings(paras: DataFrame, hits: Column, names: tuple[str, ...] = PARAGRAPH) -> DataFrame:
    # a struct is made as a whole, so it has nothing that the hits don't read
    base = textmetrics.fenced_off(paras, paras.columns, paragraph_columns(names)) if names else paras
    rows = textmetrics.each(base, ["file"], hits, "h").select("file", "h.*")
    return finding(rows, "ru-structural", "ru", F.get("seq", F.lit(2)), F.col("severity"), F.col("category"), F.col("quote"), seq=F.col("seq"))


def fragment_leads(paras: DataFrame) -> DataFrame:
    """Paragraphs that open with a stub sentence of a few words before a long rest."""
    return _paragraph_findings(paras, lead_hits(), ("__start", "__end"))


def stub_paragraphs(paras: DataFrame) -> DataFrame:
    """Stub paragraphs with a long one right after a single line between."""
    return _paragraph_findings(paras, stub_hits(), ("__trimmed",))


def holds_dashes(docs: DataFrame) -> DataFrame:
    """The documents with as many em-dashes as ``dash_density`` asks of one paragraph; no other has a finding of it, so it need not be cut."""
    content = F.col("content")
    return docs.where(F.contains(content, F.lit("—")) & (F.length(content) - F.length(F.replace(content, F.lit("—"), F.lit(""))) >= DASHES))


def dash_density(paras: DataFrame) -> DataFrame:
    """Paragraphs of three em-dashes or more; one that opens a line does not count."""
    return _paragraph_findings(paras, dash_hits(), ("__dashes",))


def prose_arrows(line: Column) -> Column:
    """Arrows of a line that don't stand between two tokens with digits, in one pass over its tokens.

    A token is what stands between white space. The left token of an arrow is the part of its own token before
    it or, if there is none, the token before; the right one likewise. So of a token's arrows those between its first and its
    last digit are flanked by digits, and its first and last character, if they are arrows, ask the neighbours.
    """
    digit = lambda x: F.coalesce(x.rlike("[0-9]"), F.lit(False))
    arrows = lambda x: F.regexp_count(x, F.lit("→"))
    tokens = F.filter(F.split(line, f"[{SPACES}]+", -1), lambda t: t != "")
    near = F.arrays_zip(tokens.alias("t"), F.concat(F.array(F.lit("")), tokens).alias("before"), F.slice(tokens, 2, 1 << 30).alias("after"))
    near = F.filter(near, lambda x: F.coalesce(F.contains(x["t"], F.lit("→")), F.lit(False)))

    def flanked(x: Column) -> Column:
        t, own = x["t"], digit(x["t"])
        first, last = F.startswith(t, F.lit("→")), F.endswith(t, F.lit("→"))
        alone = t == "→"
        between = F.when(own, arrows(t) - arrows(F.regexp_extract(t, "^[^0-9]*", 0)) - arrows(F.regexp_extract(t, r"[0-9]([^0-9]*+)\z", 1))).otherwise(0)
        at_start = first & digit(x["before"]) & F.when(alone, digit(x["after"])).otherwise(own)
        at_end = last & ~alone & own & digit(x["after"])
        return between + at_start.cast("int") + at_end.cast("int")

    exempt = F.aggregate(F.transform(near, flanked), F.lit(0), lambda a, n: a + n)
    return F.when(F.contains(line, F.lit("→")), arrows(line) - exempt).otherwise(0)


def arrow_prose(paras: DataFrame) -> DataFrame:
    return _paragraph_findings(paras, arrow_hits(), ())


def paragraph_hits() -> Column:
    return _together([lead_hits(), stub_hits(), dash_hits(), arrow_hits()])


def russian(docs: DataFrame) -> DataFrame:
    return _paragraph_findings(paragraphs(docs), paragraph_hits())


# -- findings from outside ---------------------------------------------------------------------------


def external_english(issues: DataFrame) -> DataFrame:
    """Issues (file, type, text, severity) of the outside English detector."""
    return finding(issues, "avoid-ai-writing", "en", None, F.col("severity"), F.col("type"), short(F.col("text")))


def russian_genre(file: Column) -> Column:
    """The genre that the outside Russian detector is asked for."""
    return F.when(F.lower(file).rlike("/(docs?|documentation|guides)/"), "academic").otherwise("marketing")


def external_russian(results: DataFrame) -> DataFrame:
    """Results (file, markers array<struct<category, quote, count>>, hard_bans array<struct<category, count>>)."""
    rows = results.select("file", "hard_bans", F.explode("markers").alias("m"))
    banned = F.coalesce(F.exists("hard_bans", lambda b: b["category"] == F.col("m.category")), F.lit(False))
    count = F.when(F.coalesce(F.col("m.count"), F.lit(0)) != 0, F.concat(F.lit(" ×"), F.col("m.count").cast("string"))).otherwise("")
    quote = F.concat(F.coalesce("m.quote", F.lit("")), count)
    return finding(rows, "humanizer-ru", "ru", None, F.when(banned, "hard-ban").otherwise("marker"), F.concat(F.lit("ru:"), F.col("m.category")), short(quote))


def russian_results(results: DataFrame) -> DataFrame:
    """Results (file, stdout, and ``code`` and ``stderr`` if they are there) of the outside Russian detector, read: file, markers, hard_bans, error.

    The first JSON value of the output counts; no output is no result. Output that is no JSON is an error, and so is an
    exit code other than 0 (clean) and 1 (findings).
    """
    read = concatenated(results.withColumnRenamed("error", "__given") if "error" in results.columns else results, "stdout")
    value = F.from_json(F.get("values", F.lit(0)), "markers array<array<string>>, hard_bans array<array<string>>")
    item = lambda a, k: F.get(a, F.lit(k))
    markers = F.transform(value["markers"], lambda m: F.struct(item(m, 0).alias("category"), item(m, 1).alias("quote"), item(m, 2).cast("int").alias("count")))
    bans = F.transform(value["hard_bans"], lambda b: F.struct(item(b, 0).alias("category"), item(b, 1).cast("int").alias("count")))
    error = F.when(F.col("error").isNotNull(), F.concat(F.lit("parse error on "), F.col("file"), F.lit(": "), F.col("error")))
    if "code" in results.columns:
        said = F.nullif(F.col("stderr"), F.lit("")) if "stderr" in results.columns else F.lit(None).cast("string")
        error = F.when(~F.col("code").isin(0, 1), F.coalesce(said, F.concat(F.lit("exit "), F.col("code").cast("string"), F.lit(" on "), F.col("file")))).otherwise(error)
    return read.select("file", F.when(error.isNull(), markers).alias("markers"), F.when(error.isNull(), bans).alias("hard_bans"), error.alias("error"))


def russian_failures(results: DataFrame) -> DataFrame:
    """The failed run of the outside Russian tool, if any of its outputs (``russian_results``) is broken."""
    return failures(results, "humanizer-ru", "ru")


def external_korean(results: DataFrame) -> DataFrame:
    """Results (file, stdout): the risk band, score and route printed there; a band other than low is a finding."""
    part = lambda name, chars: F.coalesce(F.nullif(F.regexp_extract("stdout", f"{name}=({chars})", 1), F.lit("")), F.lit("?"))
    rows = results.withColumns({"__band": part("risk_band", r"\S+"), "__score": part("risk_score", r"\d+"), "__route": part("route_hint", r"\S+")}).where("__band <> 'low'")
    quote = F.concat(F.lit("risk_band="), F.col("__band"), F.lit(" risk_score="), F.col("__score"), F.lit(" route_hint="), F.col("__route"))
    return finding(rows, "im-not-ai", "ko", None, F.col("__band"), F.lit("ko:risk_band"), quote)


def external_japanese(results: DataFrame) -> DataFrame:
    """Results (file, stdout): JSON with findings[]; those without a category or excerpt are skipped. ``japanese_failures`` tells broken ones."""
    parsed = F.from_json("stdout", "findings array<struct<line int, category string, excerpt string, severity string>>")
    rows = results.select("file", F.explode(parsed["findings"]).alias("v")).where("v.category is not null and v.excerpt is not null")
    return finding(rows, "natural-japanese", "ja", F.col("v.line"), F.col("v.severity"), F.concat(F.lit("ja:"), F.col("v.category")), F.col("v.excerpt"))


def japanese_errors(results: DataFrame) -> DataFrame:
    """Results (file, stdout) with ``error``: why the output of the outside Japanese tool can't be read, or null."""
    value = F.try_parse_json(F.coalesce("stdout", F.lit("")))
    error = F.when(value.isNull(), F.concat(F.lit("unparseable lint.py JSON on "), F.col("file")))
    return results.withColumn("error", error.when(F.try_variant_get(value, "$.findings", "array<variant>").isNull(), F.concat(F.lit("missing findings[] on "), F.col("file"))))


def failures(results: DataFrame, tool: str, lang: str) -> DataFrame:
    """tool, lang, error of the run: that of the first file (by name) with an ``error``; no row if none has one."""
    first = results.where("error is not null").agg(F.min_by("error", "file").alias("error")).where("error is not null")
    return first.select(F.lit(tool).alias("tool"), F.lit(lang).alias("lang"), "error")


def japanese_failures(results: DataFrame) -> DataFrame:
    """The failed run of the outside Japanese tool, if any of its outputs is broken."""
    return failures(japanese_errors(results), "natural-japanese", "ja")


#: Built-in scanners by tool: (languages, function of documents and language).
BUILT_IN = {
    "placeholder": placeholders,
    "phrases": phrase_scan,
    "patterns-en": lambda docs, lang: english_patterns(docs).unionByName(english_lexicon(docs)),
    "metrics": lambda docs, lang: metric_findings(docs),
    "viet-lint": lambda docs, lang: vietnamese(docs),
    "ja-lint": lambda docs, lang: japanese(docs),
    "ru-structural": lambda docs, lang: russian(docs),
    "es-lint": lambda docs, lang: spanish(docs),
    "th-lint": lambda docs, lang: thai(docs),
    "my-lint": lambda docs, lang: burmese(docs),
    "id-lint": lambda docs, lang: indonesian(docs),
}
