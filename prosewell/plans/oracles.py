"""DuckDB SQL of the registered queries, built from the same rules and seeds."""

from __future__ import annotations

import re

from prosewell.catalogs import english, others, phrases
from prosewell.catalogs import languages as L
from prosewell.catalogs import metrics as M
from prosewell.catalogs import triage as T
from prosewell.functions.language import certain_sql, ladder_sql
from prosewell.functions.regexes import flags_of
from prosewell.operators import scanners as S
from prosewell.operators.report import NOT_AVAILABLE
from prosewell.operators.triage import glob_regex
from prosewell.plans.queries import NOT_RE2
from prosewell.plans.seeds import SEEDS
from prosewell.schema import weighted

ORACLES: dict[str, str] = {}
#: White space for RE2.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def re2(pattern: str, ignore: bool | None = None) -> str:
    """A rule's pattern for RE2, whose word boundary is ASCII as the rules mean it."""
    body, flags = flags_of(pattern)
    body = re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", body)
    out, inside, k = "", False, 0
    while k < len(body):
        if body[k : k + 2] == r"\s":
            out += WS if inside else f"[{WS}]"
            k += 2
        elif body[k] == "\\":
            n = body.index("}", k) + 1 - k if body[k : k + 3] == r"\x{" else 2
            out += body[k : k + n]
            k += n
        else:
            inside = body[k] == "[" or (inside and body[k] != "]")
            out += body[k]
            k += 1
    return ("(?i)" if ("i" in flags if ignore is None else ignore) else "") + out


def seeded(seed: str, front: bool = False) -> str:
    cases = " ".join(f"WHEN {k} THEN {q(s)}" for k, s in enumerate(SEEDS[seed]))
    block = f"CASE doc_id % {len(SEEDS[seed])} {cases} END"
    content = f"{block} || coalesce(text, '')" if front else f"coalesce(text, '') || chr(10) || chr(10) || {block}"
    return f"corpus AS (SELECT 'doc-' || doc_id || '.md' AS file, {content} AS content FROM documents)"


LINES = "lines AS (SELECT file, CAST(i AS INTEGER) AS line, l[i] AS text FROM (SELECT file, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT file, string_split(content, chr(10)) AS l FROM corpus)))"
FENCE = f"regexp_matches(text, {q(f'^[{WS}]*```')})"
FENCED = f"fenced AS (SELECT file, line, text, fence, (coalesce(sum(CAST(fence AS INTEGER)) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2) = 1 AS inside FROM (SELECT *, {FENCE} AS fence FROM lines))"


def with_corpus(seed: str, body: str, *more: str, front: bool = False) -> str:
    return "WITH " + ", ".join([seeded(seed, front), *more]) + " " + body


# -- language ----------------------------------------------------------------------------------------

_RANGES = {"hangul": r"\x{AC00}-\x{D7AF}", "cyrillic": r"\x{0400}-\x{04FF}", "kana": r"\x{3040}-\x{30FF}", "thai": r"\x{0E00}-\x{0E7F}", "myanmar": r"\x{1000}-\x{109F}", "vi_marks": r"\x{1EA0}-\x{1EF9}" + L.SCRIPTS["vi_letters"], "vi_letters": L.SCRIPTS["vi_letters"], "latin": "a-zA-Z", "es_strong": "ñ¿¡"}


def _markers(source: str) -> str:
    counts = [f"CAST(length(regexp_replace(s, {q(f'[^{r}]')}, '', 'g')) AS INTEGER) AS {k}" for k, r in _RANGES.items()]
    for k, (letters, words) in L.WORDS.items():
        counts.append(f"CAST(len(list_filter(regexp_extract_all(lower(s), {q(f'[{letters}]+')}), lambda w: w IN ({', '.join(map(q, words))}))) AS INTEGER) AS {k}")
    return f"marks AS (SELECT file, {', '.join(counts)} FROM (SELECT file, substr(content, 1, {L.SAMPLE}) AS s FROM {source}))"


def _path(column: str) -> str:
    names = ", ".join(map(q, L.ALIASES))
    cases = " ".join(f"WHEN {q(a)} THEN {q(lang)}" for a, lang in L.ALIASES.items())
    return f"CASE list_filter(regexp_split_to_array(lower({column}), '[/\\\\._-]+'), lambda s: s IN ({names}))[1] {cases} END"


_DETECTED = f"detected AS (SELECT file, coalesce({_path('file')}, {ladder_sql()}) AS lang, ({_path('file')} IS NOT NULL OR {certain_sql()}) AS confident FROM marks)"
_LANG = (_markers("corpus"), _DETECTED)
ORACLES["lang_markers"] = with_corpus("lang", "SELECT * FROM marks", _LANG[0], front=True)
ORACLES["lang_detect"] = with_corpus("lang", "SELECT file, lang, confident FROM detected", *_LANG, front=True)
ORACLES["lang_path"] = f"SELECT page_id, {_path('url')} AS lang, regexp_matches(url, '(^|/)(node_modules|vendors|\\.git|\\.venv)(/|$)') AS excluded FROM pages"
ORACLES["lang_override"] = with_corpus("lang", "SELECT 'ja' AS lang, count(*) AS files, min(file) AS first_file FROM corpus", front=True)
ORACLES["lang_buckets"] = with_corpus("lang", "SELECT lang, count(*) AS files, min(file) AS first_file, count(*) FILTER (NOT confident) AS uncertain FROM detected GROUP BY lang", *_LANG, front=True)
ORACLES["lang_uncertain"] = with_corpus("lang", "SELECT file, lang FROM detected WHERE NOT confident", *_LANG, front=True)
ORACLES["lang_conversations"] = "WITH corpus AS (SELECT 'conv-' || conv_id || '-' || turn AS file, coalesce(text, '') AS content FROM conversations), " + ", ".join(_LANG) + " SELECT lang, confident, count(*) AS turns FROM detected GROUP BY ALL"

# -- lines -------------------------------------------------------------------------------------------

_STRUCTURAL = ["^$", "^#", "^>", r"^\|", "^<!--", "^[-*+] ", f"^[—–-][{WS}]", f"^[0-9]+[.)][{WS}]", "^={3,}$"] + [f"^[{c}][{WS}]*([{c}][{WS}]*){{2,}}$" for c in "—–_*-"]
_IS_STRUCTURAL = f"(starts_with(text, '    ') OR starts_with(text, chr(9)) OR regexp_matches({trim('text')}, {q('|'.join(_STRUCTURAL))}))"
_PARAGRAPHS = f"""stops AS (SELECT *, (fence OR inside OR {_IS_STRUCTURAL}) AS stop FROM fenced),
runs AS (SELECT *, sum(CAST(stop AS INTEGER)) OVER (PARTITION BY file ORDER BY line) AS run FROM stops),
grouped AS (SELECT file, run, min(line) AS start_line, list(text ORDER BY line) AS ls, string_agg(text, chr(10) ORDER BY line) AS text FROM runs WHERE NOT stop GROUP BY file, run),
paras AS (SELECT file, start_line, ls, text, lead(start_line) OVER (PARTITION BY file ORDER BY start_line) AS next_start, lead(text) OVER (PARTITION BY file ORDER BY start_line) AS next_text FROM grouped)"""
_RU = (LINES, FENCED, _PARAGRAPHS)
ORACLES["fence_mask"] = with_corpus("es", "SELECT file, line, fence, inside FROM fenced", LINES, FENCED)
ORACLES["line_counts"] = with_corpus("ru", f"SELECT file, count(*) AS n_lines, count(*) FILTER ({_IS_STRUCTURAL}) AS n_structural FROM lines GROUP BY file", LINES)
ORACLES["ru_paragraphs"] = with_corpus("ru", "SELECT file, start_line, CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(text) AS BIGINT) AS n_chars, next_start FROM paras", *_RU)

# -- scanners ----------------------------------------------------------------------------------------


def all_matches(rules: list[tuple[str, str, str, int]], cut: str = "substr({0}, 1, 200)") -> str:
    """Every match of (category, severity, RE2 pattern, group) on each line, trimmed and cut."""
    quote = cut.format(trim("m"))
    one = [f"SELECT file, line, {q(sev) if sev else 'CAST(NULL AS VARCHAR)'} AS severity, {q(cat)} AS category, {quote} AS quote FROM (SELECT file, line, unnest(regexp_extract_all(text, {q(rx)}, {group})) AS m FROM lines) WHERE m <> ''" for cat, sev, rx, group in rules]
    return " UNION ALL ".join(one)


_P0 = [("p0-placeholder", "critical", re2(p, i), 0) for p, i in T.PLACEHOLDERS]
_SHOWN = f"shown AS (SELECT * FROM lines WHERE NOT regexp_matches(text, {q(f'^[{WS}]*<!--')}) AND NOT contains(text, '```'))"
ORACLES["p0_placeholders"] = with_corpus("placeholder", "SELECT *, 'P0' AS priority FROM (" + all_matches(_P0, "m").replace("FROM lines)", "FROM shown)") + ")", LINES, _SHOWN)


def occurrences(text: str, needle: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, {q(needle)}, ''))) / {len(needle)} AS INTEGER)"


def phrase_sql(needles: list[tuple[str, str]], columns: str = "file, severity, category, quote") -> str:
    rows = " UNION ALL ".join(f"SELECT file, {q(n)} AS needle, {q(kind)} AS kind, {occurrences('low', n.lower())} AS n FROM lows WHERE contains(low, {q(n.lower())})" for n, kind in needles)
    return f"SELECT {columns} FROM (SELECT file, CASE WHEN n >= 3 THEN 'high' WHEN kind = 'cliche' THEN 'phrase' ELSE 'weak' END AS severity, 'ai-phrase' AS category, needle || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END AS quote FROM ({rows}) WHERE n >= CASE kind WHEN 'weak' THEN 2 ELSE 1 END)"


LOWS = "lows AS (SELECT file, lower(content) AS low FROM corpus)"
for _lang in L.LANGS:
    ORACLES[f"phrases_{_lang}"] = with_corpus("phrases", phrase_sql(S.phrase_needles(_lang)), LOWS)

ORACLES["phrases_dictionary"] = with_corpus(
    "phrases",
    f"""SELECT file, CASE WHEN n >= 3 THEN 'high' WHEN kind = 'cliche' THEN 'phrase' ELSE 'weak' END AS severity, 'ai-phrase' AS category, needle || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END AS quote
    FROM (SELECT file, needle, kind, CAST((length(low) - length(replace(low, needle, ''))) / length(needle) AS BIGINT) AS n FROM lows JOIN dict ON contains(low, needle)) WHERE n >= CASE kind WHEN 'weak' THEN 2 ELSE 1 END""",
    LOWS,
    r"""w AS (SELECT regexp_extract_all(lower(text), '\p{L}+') AS w FROM benchmark)""",
    r"""listed AS (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS needle, 'weak' AS kind FROM conversations UNION ALL SELECT w[i] || ' ' || w[i + 1], 'cliche' FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w))""",
    f"dict AS (SELECT needle, min(kind) AS kind FROM listed WHERE length(needle) >= 4 OR regexp_matches(needle, '[가-\\x{{D7AF}}\\x{{1EA0}}-\\x{{1EF9}}ăâêôơưđ]') GROUP BY needle)",
)


def english_sql(rules: list) -> str:
    one = [f"SELECT file, line, {q(weighted(w))} AS severity, {q(f'zs:{cat}/{name}')} AS category, substr(regexp_extract(text, {q(re2(rx, True))}), 1, 200) AS quote FROM lines" for name, cat, w, rx in rules]
    return "SELECT * FROM (" + " UNION ALL ".join(one) + ") WHERE quote <> ''"


_BEYOND = {r[0]: r for r in english.RULES if r[0] in NOT_RE2}


def _beyond_re2() -> str:
    """The three rules without look-ahead and back references: their places are tried one by one, or their branches one by one."""

    def rows(name: str, source: str) -> str:
        _, cat, w, _ = _BEYOND[name]
        return f"SELECT file, line, {q(weighted(w))} AS severity, {q(f'zs:{cat}/{name}')} AS category, substr(quote, 1, 200) AS quote FROM ({source}) WHERE quote IS NOT NULL"

    starts = "list_filter(range(1, length(text) + 1), lambda i: (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[A-Za-z0-9_]')) AND {0})"
    chain = r"(?i)^(\w+) becomes (\w+)\. (\w+) becomes\b"
    part = lambda k: f"lower(regexp_extract(substr(text, i), {q(chain)}, {k}))"
    at = starts.format(f"regexp_matches(substr(text, i), {q(chain)}) AND {part(2)} = {part(3)}")
    first = f"SELECT file, line, regexp_extract(substr(text, spot), {q(chain)}) AS quote FROM (SELECT file, line, text, {at}[1] AS spot FROM lines WHERE contains(lower(text), 'becomes')) WHERE spot IS NOT NULL"
    rx = _BEYOND["isocolon-ditransitive"][3]
    verbs = rx[rx.index("(") + 1 : rx.index(")")].split("|")
    tail = rx[rx.index(")") + 1 :]
    found = ", ".join(f"regexp_extract(text, {q(re2(f'{chr(92)}b{v}{tail}'.replace(chr(92) + '1', v), True))})" for v in verbs)
    second = f"SELECT file, line, list_sort(list_transform(list_filter([{found}], lambda m: m <> ''), lambda m: {{'at': strpos(text, m), 'm': m}}))[1].m AS quote FROM lines WHERE contains(lower(text), ' you')"
    rx = _BEYOND["generic-benefit-stack"][3].replace("(?is)", "")
    word = rx[: rx.index("(?=")].removeprefix("\\b")
    needs = [x.removesuffix(")") for x in re.split(r"\(\?=", rx[rx.index("(?=") :].removesuffix(".{0,260}"))[1:]]
    head = q("(?is)^" + re2(word))
    rest = f"substr(text, i + length(regexp_extract(substr(text, i), {head})))"
    at = starts.format(f"regexp_matches(substr(text, i), {head}) AND " + " AND ".join(f"regexp_matches({rest}, {q('(?is)^' + re2(n))})" for n in needs))
    third = f"SELECT file, line, regexp_extract(substr(text, spot), {q('(?is)^' + re2(word) + '.{0,260}')}) AS quote FROM (SELECT file, line, text, {at}[1] AS spot FROM lines WHERE regexp_matches(text, {q('(?i)' + re2(word))})) WHERE spot IS NOT NULL"
    return " UNION ALL ".join(rows(n, s) for n, s in zip(NOT_RE2, (first, second, third), strict=True))


ORACLES["patterns_en_not_re2"] = with_corpus("en", _beyond_re2(), LINES)
_RE2_RULES = [r for r in english.RULES if r[0] not in NOT_RE2]
for _category in dict.fromkeys(r[1] for r in _RE2_RULES):
    ORACLES[f"patterns_en_{_category}"] = with_corpus("en", english_sql([r for r in _RE2_RULES if r[1] == _category]), LINES)
ORACLES["patterns_en_counts"] = with_corpus("en", f"SELECT category, severity, count(*) AS n, count(DISTINCT file) AS files FROM ({english_sql(_RE2_RULES)}) GROUP BY ALL", LINES)


def lexicon_sql(columns: str = "file, severity, category, quote") -> str:
    rows = " UNION ALL ".join(f"SELECT file, {q(weighted(w, 5))} AS severity, {q(s)} AS stem, {occurrences('low', s.lower())} AS n FROM lows WHERE contains(low, {q(s.lower())})" for s, w in english.LEXICON.items())
    return f"SELECT {columns} FROM (SELECT file, severity, 'zs:lexicon' AS category, stem || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END AS quote FROM ({rows}))"


ORACLES["lexicon_en"] = with_corpus("en", lexicon_sql(), LOWS)


def catalog(rules: list, prefix: str = "") -> list[tuple[str, str, str, int]]:
    """A look-behind for . ; : becomes a consumed character before group 1."""
    out = []
    for _, cat, w, rx in rules:
        behind = "(?<=[.;:])"
        pattern = re2(rx.replace("(?m)", "").replace("(?mi)", "(?i)"))
        out.append((prefix + cat, weighted(w), pattern.replace(behind, "[.;:](") + ")" if behind in pattern else pattern, 1 if behind in pattern else 0))
    return out


ORACLES["es_catalog"] = with_corpus("es", all_matches(catalog(others.SPANISH, "es:")), LINES)
ORACLES["th_lint"] = with_corpus("th", all_matches(catalog(others.THAI)), LINES)
ORACLES["my_lint"] = with_corpus("my", all_matches(catalog(others.BURMESE)), LINES)
ORACLES["id_lint"] = with_corpus("id", all_matches(catalog(others.INDONESIAN)), LINES)

_W = "0-9A-Za-z_áéíóúñüÁÉÍÓÚÑÜ"
_TRIAD = f"[{_W}]+,[{WS}]+[{_W}]+[{WS}]+[yY][{WS}]+[{_W}]+"
_FREE = "free AS (SELECT * FROM fenced WHERE NOT inside)"
_ES = (LINES, FENCED, _FREE)
ORACLES["es_density"] = with_corpus(
    "es",
    f"""SELECT file, CAST(NULL AS INTEGER) AS line, severity, category, quote FROM (
    SELECT file, 'high' AS severity, 'es:triads' AS category, 'triads ×' || CAST(sum(len(regexp_extract_all(text, {q(_TRIAD)}))) AS BIGINT) AS quote, sum(len(regexp_extract_all(text, {q(_TRIAD)}))) AS n FROM free GROUP BY file
    UNION ALL SELECT file, 'medium', 'es:poder_infinitivo', 'poder+infinitivo ×' || CAST(sum(len(regexp_extract_all(text, {q(re2(S.PODER, True))}))) AS BIGINT), sum(len(regexp_extract_all(text, {q(re2(S.PODER, True))}))) FROM free GROUP BY file) WHERE n >= 3""",
    *_ES,
)
ORACLES["es_mente"] = with_corpus(
    "es",
    f"""SELECT file, line, 'medium' AS severity, 'es:mente_adverb_chain' AS category, substr(array_to_string(chain[1:3], ', '), 1, 200) AS quote FROM (
    SELECT file, line, list_filter(list_transform(regexp_split_to_array(text, {q(f'[.!?][{WS}]')}), lambda s: list_filter(regexp_extract_all(s, {q(f'[{_W}]+')}), lambda w: regexp_matches(lower(w), '...mente$'))), lambda a: len(a) >= 2)[1] AS chain FROM free) WHERE chain IS NOT NULL""",
    *_ES,
)
ORACLES["es_inciso"] = with_corpus("es", f"SELECT file, line, 'medium' AS severity, 'es:em_dash_inciso' AS category, substr({trim('text')}, 1, 200) AS quote FROM free WHERE regexp_matches(text, {q(S.INCISO)})", *_ES)


def _japanese() -> str:
    parts = []
    for rule, severity, patterns, needles in others.JAPANESE:
        for rx in patterns:
            if "(?=" in rx:  # the look-ahead branch ends in a space that is not part of the match
                head = re2(rx[: rx.index("(?:\\s*[:")], False)
                parts.append(f"SELECT file, line, {q(severity)} AS severity, {q(rule)} AS category, {trim('m')} AS quote FROM (SELECT file, line, CASE WHEN regexp_extract(text, {q(head + f'[{WS}]*[:：]')}) <> '' THEN regexp_extract(text, {q(head + f'[{WS}]*[:：]')}) ELSE regexp_extract(text, {q('(' + head + f'[{WS}]+[-—–])[{WS}]')}, 1) END AS m FROM lines) WHERE m <> ''")
            else:
                parts.append(all_matches([(rule, severity, re2(rx, False), 0)], "{0}"))
        for needle in needles:
            parts.append(f"SELECT file, line, {q(severity)} AS severity, {q(rule)} AS category, {q(needle)} AS quote FROM (SELECT file, line, unnest(range({occurrences('text', needle)})) FROM lines WHERE contains(text, {q(needle)}))")
    return " UNION ALL ".join(parts)


ORACLES["ja_lint"] = with_corpus("ja", _japanese(), LINES)


def _vietnamese() -> str:
    parts = []
    for rule, severity, patterns, needles in phrases.VIETNAMESE:
        found = " || ".join(f"list_filter(regexp_extract_all(text, {q(re2(p.replace('(?m)', '')))}), lambda m: m <> '')" for p in patterns) or "CAST([] AS VARCHAR[])"
        first = "CASE " + " ".join(f"WHEN contains(lower(text), {q(n.lower())}) THEN [{q(n.lower())}]" for n in needles) + " ELSE [] END" if needles else "CAST([] AS VARCHAR[])"
        parts.append(f"SELECT file, line, {q(severity)} AS severity, {q(rule)} AS category, substr(m, 1, 200) AS quote FROM (SELECT file, line, unnest(CASE WHEN len({found}) > 0 THEN {found} ELSE {first} END) AS m FROM lines)")
    return " UNION ALL ".join(parts)


ORACLES["viet_lint"] = with_corpus("vi", _vietnamese(), LINES)

# -- Russian -----------------------------------------------------------------------------------------

_NOT = f"[^{WS}]"


def _words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, {q(f'[{WS}]+')}), lambda w: w <> ''))"


_ABBR = ", ".join(map(q, S.ABBREVIATIONS))
ORACLES["ru_fragment_lead"] = with_corpus(
    "ru",
    f"""SELECT file, start_line AS line, 'medium' AS severity, 'ru:fragment-lead' AS category, substr(stub, 1, 200) AS quote FROM (
    SELECT file, start_line, {trim('substr(t, 1, e)')} AS stub, {trim('substr(t, e + 1)')} AS rest FROM (
      SELECT file, start_line, t, list_filter(range(1, {S.LEAD}), lambda i: i <= length(t) AND substr(t, i, 1) IN ('.', '!', '?', '…')
        AND (i = length(t) OR regexp_matches(substr(t, i + 1, 1), {q(f'[{WS}]')})) AND NOT regexp_matches(substr(t, i + 1), {q(f'^[{WS}]+[0-9]')})
        AND length(regexp_extract(substr(t, 1, i - 1), {q(f'({_NOT}+)$')}, 1)) > 1 AND lower(regexp_extract(substr(t, 1, i - 1), {q(f'({_NOT}+)$')}, 1)) NOT IN ({_ABBR}))[1] AS e
      FROM (SELECT file, start_line, regexp_replace(text, {q(f'^[{WS}]+')}, '') AS t FROM paras)) WHERE e IS NOT NULL)
    WHERE length(stub) BETWEEN 1 AND {S.LEAD - 1} AND {_words('stub')} >= {S.LEAD_WORDS} AND length(rest) >= {S.BODY}""",
    *_RU,
)
ORACLES["ru_stub_paragraph"] = with_corpus(
    "ru",
    f"""SELECT file, start_line AS line, 'medium' AS severity, 'ru:fragment-lead' AS category, substr(t, 1, 200) AS quote FROM (SELECT *, {trim('text')} AS t FROM paras)
    WHERE length(t) < {S.LEAD} AND regexp_matches(t, '[.!?…]$') AND {_words('t')} >= {S.LEAD_WORDS} AND next_start - (start_line + len(ls) - 1) = 2 AND length({trim('next_text')}) >= {S.BODY}""",
    *_RU,
)


def _dashes(columns: str = "file, line, severity, category, quote") -> str:
    n = f"list_sum(list_transform(ls, lambda x: length(regexp_replace(regexp_replace(x, {q(f'^[{WS}]*—')}, ''), '[^—]', '', 'g'))))"
    collapsed = f"regexp_replace(text, {q(f'[{WS}]+')}, ' ', 'g')"
    return f"SELECT {columns} FROM (SELECT file, start_line AS line, CASE WHEN n >= {S.MANY_DASHES} THEN 'high' ELSE 'medium' END AS severity, 'ru:dash-density' AS category, substr('×' || CAST(n AS BIGINT) || ' ' || {trim(collapsed)}, 1, 200) AS quote FROM (SELECT *, {n} AS n FROM paras) WHERE n >= {S.DASHES})"


ORACLES["ru_dash_density"] = with_corpus("ru", _dashes(), *_RU)
_LEFT, _RIGHT = f"regexp_extract(substr(text, 1, i - 1), {q(f'({_NOT}+)[{WS}]*$')}, 1)", f"regexp_extract(substr(text, i + 1), {q(f'^[{WS}]*({_NOT}+)')}, 1)"
ORACLES["ru_arrow_prose"] = with_corpus(
    "ru",
    f"""SELECT file, CAST(line AS INTEGER) AS line, CASE WHEN n >= 2 THEN 'high' ELSE 'medium' END AS severity, 'ru:arrow-prose' AS category, substr({trim('text')} || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END, 1, 200) AS quote FROM (
    SELECT file, line, text, len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 1) = '→' AND NOT (regexp_matches({_LEFT}, '[0-9]') AND regexp_matches({_RIGHT}, '[0-9]')))) AS n
    FROM (SELECT file, start_line + k - 1 AS line, ls[k] AS text FROM (SELECT file, start_line, ls, unnest(range(1, len(ls) + 1)) AS k FROM paras)) WHERE contains(text, '→')) WHERE n > 0""",
    *_RU,
)

# -- metrics -----------------------------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9'']*')"
_COLLAPSED = trim(f"regexp_replace(content, {q(f'[{WS}]+')}, ' ', 'g')")
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace({_COLLAPSED}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda s: {trim('s')}), lambda s: regexp_matches(lower(s), '[a-z0-9]'))"
ORACLES["sentences_tokens"] = with_corpus("metrics", f"SELECT file, len(s) AS n_sentences, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, length(array_to_string(s, '|')) AS joined FROM (SELECT file, {_SENTENCES} AS s, {_TOKENS.format('content')} AS t FROM corpus)")
_LETTERS = "regexp_replace({0}, '[^a-z]', '', 'g')"


def _syllables(w: str) -> str:
    letters = _LETTERS.format(w)
    stem = f"regexp_replace(regexp_replace({letters}, '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', '')"
    return f"CASE WHEN {letters} = '' THEN 0 WHEN length({letters}) <= 3 THEN 1 ELSE greatest(len(regexp_extract_all({stem}, '[aeiouy]{{1,2}}')), 1) END"


ORACLES["syllable_counts"] = with_corpus("metrics", f"SELECT token, count(*) AS n, CAST({_syllables('token')} AS BIGINT) AS syllables FROM (SELECT unnest({_TOKENS.format('content')}) AS token FROM corpus) GROUP BY token")


def _tier(words: list[str]) -> str:
    return f"len(list_filter(t, lambda w: w IN ({', '.join(map(q, words))})))"


_PHRASES = " + ".join(occurrences("low", p) for p in M.PHRASES)
ORACLES["vocab_tells"] = with_corpus("metrics", f"SELECT file, {_tier(M.TIER1)} AS tier1, {_tier(M.TIER2)} AS tier2, CAST({_PHRASES} AS BIGINT) AS phrase_tells FROM (SELECT file, lower(content) AS low, {_TOKENS.format('content')} AS t FROM corpus)")


def _rounded(x: str, places: int) -> str:
    f = f"{10**places}.0::DOUBLE"
    return f"floor(({x}) * {f} + 0.5::DOUBLE) / {f}"


_BASE = f"""base AS (SELECT file, lower(content) AS low, {_TOKENS.format('content')} AS t, list_transform({_SENTENCES}, lambda s: len({_TOKENS.format('s')})) AS l FROM corpus),
b2 AS (SELECT *, len(t) AS n, len(l) AS k, coalesce(list_sum(list_transform(t, lambda w: {_syllables('w')})), 0)::DOUBLE AS syl, CASE WHEN len(l) > 0 THEN list_sum(l)::DOUBLE / len(l) ELSE 0.0::DOUBLE END AS m, {_tier(M.TIER1)} AS t1, {_tier(M.TIER2)} AS t2, {_PHRASES} AS ph FROM base),
b3 AS (SELECT *, CASE WHEN k >= 2 THEN sqrt(list_sum(list_transform(l, lambda x: (x - m) * (x - m))) / k) ELSE 0.0::DOUBLE END AS s, CASE WHEN k > 0 THEN n::DOUBLE / k ELSE 0.0::DOUBLE END AS wps, CASE WHEN n > 0 THEN syl / n ELSE 0.0::DOUBLE END AS spw,
  CASE WHEN n > 0 THEN len(list_distinct(t))::DOUBLE / n ELSE 0.0::DOUBLE END AS ttr FROM b2),
metrics AS (SELECT file, CAST(n AS INTEGER) AS word_count, CAST(k AS INTEGER) AS sentence_count, {_rounded('m', 2)} AS mean_sentence_length, {_rounded('s', 2)} AS sentence_length_stdev,
  {_rounded('CASE WHEN m <> 0 THEN s / m ELSE 0.0::DOUBLE END', 3)} AS sentence_length_cov, {_rounded('CASE WHEN m <> 0 THEN s / m ELSE 0.0::DOUBLE END', 3)} AS burstiness,
  {_rounded('CASE WHEN s + m <> 0 THEN (s - m) / (s + m) ELSE 0.0::DOUBLE END', 3)} AS burstiness_gb, {_rounded('ttr', 3)} AS type_token_ratio,
  {_rounded(f"CASE WHEN n <= {M.WINDOW} THEN ttr ELSE list_sum(list_transform(range(1, n - {M.WINDOW} + 2), lambda i: len(list_distinct(t[i:i + {M.WINDOW} - 1]))))::DOUBLE / ({M.WINDOW} * (n - {M.WINDOW - 1}))::DOUBLE END", 3)} AS mattr,
  {_rounded("CASE WHEN n >= 3 THEN 1::DOUBLE - len(list_distinct(list_transform(range(1, n - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])))::DOUBLE / (n - 2) ELSE 0.0::DOUBLE END", 3)} AS trigram_repetition,
  {_rounded('CASE WHEN n > 0 THEN 0.39::DOUBLE * wps + 11.8::DOUBLE * spw - 15.59::DOUBLE ELSE 0.0::DOUBLE END', 1)} AS fk_grade, {_rounded('CASE WHEN n > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * wps - 84.6::DOUBLE * spw ELSE 0.0::DOUBLE END', 1)} AS fk_ease,
  CAST(t1 + t2 + ph AS INTEGER) AS vocab_tells, {_rounded('CASE WHEN n > 0 THEN (t1 * 1.0::DOUBLE + t2 * 0.6::DOUBLE + ph * 1.0::DOUBLE) / n ELSE 0.0::DOUBLE END', 4)} AS vocab_tell_density, n < {M.SHORT} AS short_sample FROM b3)"""
ORACLES["text_metrics"] = with_corpus("metrics", "SELECT * FROM metrics", _BASE)
_NORMS = {
    "burstiness": f"({M.COV_HUMAN}::DOUBLE - burstiness) / {M.COV_HUMAN}::DOUBLE",
    "diversity": f"({M.TTR_HIGH}::DOUBLE - mattr) / ({M.TTR_HIGH}::DOUBLE - {M.TTR_LOW}::DOUBLE)",
    "repetition": f"trigram_repetition / {M.REP_MAX}::DOUBLE",
    "lexical": f"vocab_tell_density / {M.VOCAB_MAX}::DOUBLE",
}
_SIGNALS = "signals AS (SELECT *, " + ", ".join(f"CASE WHEN word_count > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x})) ELSE 0.0::DOUBLE END AS {k}_norm" for k, x in _NORMS.items()) + " FROM metrics)"
_TOTAL = "100 * (0.0::DOUBLE + " + " + ".join(f"{w}::DOUBLE * {k}_norm" for k, w in M.WEIGHTS.items()) + ")"
_SCORED = f"scored AS (SELECT *, {_TOTAL} AS raw, CAST(floor({_TOTAL} + 0.5::DOUBLE) AS BIGINT) AS score FROM signals)"
_VERDICT = f"CASE WHEN word_count = 0 THEN {q(M.NO_TEXT)} " + " ".join(f"WHEN score <= {b} THEN {q(n)}" for b, n in M.VERDICTS) + f" ELSE {q(M.LAST_VERDICT)} END"
_SCORE = (_BASE, _SIGNALS, _SCORED)
ORACLES["score_verdict"] = with_corpus("metrics", "SELECT file, " + ", ".join(f"{_rounded(f'{w}::DOUBLE * {k}_norm * 100', 3)} AS {k}_points" for k, w in M.WEIGHTS.items()) + f", {_rounded('raw', 6)} AS score_raw, score, {_VERDICT} AS verdict FROM scored", *_SCORE)
_POINTS = " || ".join(f"' {k}=' || regexp_replace(printf('%.3f', {_rounded(f'{w}::DOUBLE * {k}_norm * 100', 3)}), '\\.?0+$', '')" for k, w in M.WEIGHTS.items())
ORACLES["metrics_findings"] = with_corpus("metrics", f"SELECT file, CASE WHEN score >= {M.HIGH} THEN 'high' ELSE 'medium' END AS severity, 'humanizer-score' AS category, substr('score=' || score || '/100' || {_POINTS}, 1, 200) AS quote FROM scored WHERE score >= {M.FINDING}", *_SCORE)

# -- findings from outside ---------------------------------------------------------------------------

_OUTSIDE = """outside AS (SELECT 'doc-' || doc_id || '.md' AS file, ['tier1', 'em-dash', 'linkedin', 'formatting', 'odd', 'ai-placeholder', 'rhythm'][CAST((doc_id + k) % 7 AS INTEGER) + 1] AS category,
  ['Remember me', 'meta_title — x', 'a–b', 'plain', '[your name]', 'disable-file', 'know'][CAST((doc_id + k) % 7 AS INTEGER) + 1] AS quote, ['high', 'medium', 'low', 'critical'][CAST((doc_id + k) % 4 AS INTEGER) + 1] AS severity
  FROM (SELECT doc_id, unnest(range(1, CASE WHEN doc_id % 5 = 0 THEN 9 ELSE 3 END)) AS k FROM documents))"""
ORACLES["ext_en_adapter"] = f"WITH {_OUTSIDE} SELECT 'avoid-ai-writing' AS tool, 'en' AS lang, file, severity, category, quote FROM outside"
_SITE = "SELECT page_id, '/site/' || CASE WHEN page_id % 3 = 0 THEN 'docs/' ELSE 'blog/' END || page_id || '.md' AS file, CASE WHEN page_id % 3 = 0 THEN 'academic' ELSE 'marketing' END AS genre FROM pages"
ORACLES["ext_ru_adapter"] = f"WITH p AS ({_SITE}) SELECT file, genre, 'hard-ban' AS severity, 'ru:Тире' AS category, 'a — b' || CASE WHEN page_id % 3 <> 0 THEN ' ×' || (page_id % 3) ELSE '' END AS quote FROM p UNION ALL SELECT file, genre, 'marker', 'ru:Канцелярит', ' ×2' FROM p"
_PRINTED = """printed AS (SELECT page_id, 'p-' || page_id AS file, regexp_replace(coalesce(url, ''), '["\\\\\\x00-\\x1F]', '', 'g') AS u,
  CASE WHEN page_id % 13 = 4 THEN CASE WHEN page_id % 26 = 4 THEN 'no module' ELSE 'exit 2 on p-' || page_id END
       WHEN page_id % 11 IN (3, 7) THEN 'parse error on p-' || page_id || ': unbalanced JSON: value 1' END AS error FROM pages)"""
ORACLES["ext_ru_errors"] = f"WITH {_PRINTED} SELECT file, error FROM printed"
ORACLES["ext_ru_output"] = f"WITH {_PRINTED}, good AS (SELECT * FROM printed WHERE error IS NULL AND page_id % 11 NOT IN (5, 9)) SELECT file, 'hard-ban' AS severity, 'ru:Тире' AS category, substr(u || ' ×2', 1, 200) AS quote FROM good UNION ALL SELECT file, 'marker', 'ru:Канцелярит', '' FROM good"
ORACLES["ext_ko_adapter"] = "SELECT 'p-' || page_id AS file, band AS severity, 'ko:risk_band' AS category, 'risk_band=' || band || ' risk_score=' || s || ' route_hint=' || r AS quote FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '?' ELSE ['low', 'medium', 'high'][CAST(page_id % 3 AS INTEGER) + 1] END AS band, CASE WHEN page_id % 7 = 0 THEN '?' ELSE CAST(page_id % 100 AS VARCHAR) END AS s, CASE WHEN page_id % 7 = 0 THEN '?' ELSE 'r1' END AS r FROM pages) WHERE band <> 'low'"
ORACLES["ext_ja_adapter"] = "SELECT 'p-' || page_id AS file, CAST(page_id % 9 AS INTEGER) AS line, 'warn' AS severity, 'ja:no_chain' AS category, 'x' AS quote FROM pages UNION ALL SELECT 'p-' || page_id, NULL, NULL, 'ja:kanji_run', CAST(page_id AS VARCHAR) FROM pages"

_BROKEN = "page_id % 10 IN (1, 3, 4, 8, 9)"
ORACLES["json_values"] = f"""SELECT page_id, CAST(CASE WHEN {_BROKEN} THEN 0 ELSE 3 + [1, 0, 1, 0, 0, 0, 2, 0, 0, 0][CAST(page_id % 10 AS INTEGER) + 1] END AS BIGINT) AS n_values, {_BROKEN} AS broken,
  CASE WHEN {_BROKEN} THEN '' ELSE '{{"a":"}}' || regexp_replace(coalesce(url, ''), '["\\\\\\x00-\\x1F]', '', 'g') || '"}} 1 {{"b":[2,3]}}' || CASE page_id % 10 WHEN 0 THEN ' 3' WHEN 2 THEN ' "s}}{{["' WHEN 6 THEN ' {{"q":"\\\\\\"}} [{{\\\\"}} true' ELSE '' END END AS joined FROM pages"""

# -- triage and report -------------------------------------------------------------------------------

_IS_P0 = "(" + " OR ".join(f"regexp_matches(coalesce(quote, ''), {q(re2(p, i))})" for p, i in T.PLACEHOLDERS) + ")"
_PREFIXED = "(" + " OR ".join(f"starts_with(category, {q(p)})" for p in T.P1_PREFIXES) + ")"
_PRIORITY = f"""CASE WHEN preset IS NOT NULL THEN preset WHEN {_IS_P0} THEN 'P0' WHEN category IN ({', '.join(map(q, T.P1))}) THEN 'P1' WHEN category IN ({', '.join(map(q, T.P2))}) THEN 'P2' WHEN {_PREFIXED} THEN 'P1'
  WHEN tool = {q(T.GATED_TOOL)} AND coalesce(severity, '') NOT IN ('high', 'critical') AND NOT broken THEN 'P2' WHEN severity = 'weak' THEN 'P2' ELSE 'P1' END"""


def _fits(rule: dict) -> str:
    parts = [f"{k} = {q(rule[k])}" for k in ("tool", "category") if rule.get(k)]
    if rule.get("file"):
        parts.append(f"regexp_matches(file, {q(glob_regex(rule['file']))})")
    if rule.get("quoteContains"):
        parts.append(f"contains(lower(coalesce(quote, '')), {q(rule['quoteContains'].lower())})")
    return " AND ".join(parts)


_REASON = "CASE " + " ".join(f"WHEN {_fits(r)} THEN {q(r['reason'])}" for r in T.SUPPRESS) + " END"
_TRIAGED = f"""gated AS (SELECT *, tool = {q(T.GATED_TOOL)} AND count(*) FILTER (tool = {q(T.GATED_TOOL)}) OVER (PARTITION BY file) > {T.GATE} AS broken FROM found),
triaged AS (SELECT tool, lang, file, line, severity, category, quote, {_PRIORITY} AS priority, {_REASON} AS reason FROM gated)"""


def _named(tool: str, lang: str, body: str, ctes: list[str], preset: str = "NULL") -> str:
    inner = f"WITH {', '.join(ctes)} {body}" if ctes else body
    return f"SELECT {q(tool)} AS tool, {q(lang)} AS lang, file, CAST(line AS INTEGER) AS line, severity, category, quote, CAST({preset} AS VARCHAR) AS preset FROM ({inner})"


_OUT = f"SELECT 'avoid-ai-writing' AS tool, 'en' AS lang, file, CAST(NULL AS INTEGER) AS line, severity, category, quote, CAST(NULL AS VARCHAR) AS preset FROM (WITH {_OUTSIDE} SELECT * FROM outside)"
_FOUND = (
    "found AS ("
    + " UNION ALL ".join(
        [
            _OUT,
            _named("phrases", "en", phrase_sql(S.phrase_needles("en"), "file, NULL AS line, severity, category, quote"), [seeded("phrases"), LOWS]),
            _named("ru-structural", "ru", _dashes(), [seeded("ru"), *_RU]),
            _named("th-lint", "th", all_matches(catalog(others.THAI)), [seeded("th"), LINES]),
        ]
    )
    + ")"
)
ORACLES["aaw_gate"] = f"WITH {_OUTSIDE} SELECT file, count(*) AS n FROM outside GROUP BY file HAVING count(*) > {T.GATE}"
ORACLES["triage_priority"] = f"WITH {_FOUND}, {_TRIAGED} SELECT tool, file, line, severity, category, quote, priority FROM triaged"
ORACLES["suppression"] = f"WITH {_FOUND}, {_TRIAGED} SELECT tool, file, category, quote, reason AS fp_reason FROM triaged WHERE reason IS NOT NULL"


def _rule_rows() -> str:
    of = lambda names: f"[{', '.join(map(q, names))}][CAST(doc_id % {len(names)} AS INTEGER) + 1]"
    rules = [
        ("'doc-' || doc_id || '.md' = file", "NULL", of(["tier1", "em-dash", "ai-phrase", "formatting", "ru:dash-density"]), "NULL"),
        ("regexp_full_match(file, '(.*/)?doc-' || doc_id || '[^/][.]md')", "'th-lint'", "NULL", "NULL"),
        ("regexp_full_match(file, 'doc-[^/]*' || doc_id || '[.]md')", "NULL", "'odd'", "'a–'"),
        ("true", "'avoid-ai-writing'", "NULL", f"lower({of(['member', 'title', 'PLAIN', 'know'])} || {of(['', 'x', ' me', ''])})"),
        ("true", "NULL", "NULL", "doc_id || ' ' || doc_id"),
    ]
    parts = []
    for k, (on_file, tool, category, part) in enumerate(rules):
        parts.append(f"SELECT n, doc_id * {len(rules)} + {k} AS ord, 'rule ' || doc_id || '/{k}' AS reason FROM numbered JOIN documents ON coalesce({tool}, tool) = tool AND coalesce({category}, category) = category AND contains(lower(coalesce(quote, '')), coalesce({part}, '')) AND {on_file}")
    return " UNION ALL ".join(parts)


ORACLES["suppression_table"] = f"WITH {_FOUND}, numbered AS (SELECT *, row_number() OVER () AS n FROM found), fit AS (SELECT n, min_by(reason, ord) AS reason FROM ({_rule_rows()}) GROUP BY n) SELECT tool, file, line, category, quote, reason AS fp_reason FROM numbered JOIN fit USING (n)"


def _ordered() -> str:
    parts = []
    for lang in L.LANGS:
        for k, (needle, kind) in enumerate(S.phrase_needles(lang)):
            n = occurrences("low", needle.lower())
            parts.append(f"SELECT lang, 'phrases' AS tool, 1 AS tool_ord, file, CAST(NULL AS INTEGER) AS line, 'ai-phrase' AS category, {q(needle)} || CASE WHEN {n} > 1 THEN ' ×' || {n} ELSE '' END AS quote, {k} AS s1, 0 AS s2, 0 AS s3, 0 AS s4 FROM their_lows WHERE lang = {q(lang)} AND {n} >= {2 if kind == 'weak' else 1}")
    each = "FROM (SELECT lang, file, line, m, unnest(range(1, len(m) + 1)) AS k FROM (SELECT lang, file, line, {0} AS m FROM their_lines WHERE lang = {1}))"
    for k, (cat, _, rx, _) in enumerate(catalog(others.THAI)):
        found = f"list_filter(regexp_extract_all(text, {q(rx)}), lambda x: x <> '')"
        parts.append(f"SELECT lang, 'th-lint', 12, file, line, {q(cat)}, substr({trim('m[k]')}, 1, 200), {k}, line, k, 0 " + each.format(found, "'th'"))
    for k, (rule, _, patterns, needles) in enumerate(others.JAPANESE):
        for at, rx in enumerate(patterns):
            if "(?=" in rx:
                head = re2(rx[: rx.index("(?:\\s*[:")], False)
                found = f"list_filter([CASE WHEN regexp_extract(text, {q(head + f'[{WS}]*[:：]')}) <> '' THEN regexp_extract(text, {q(head + f'[{WS}]*[:：]')}) ELSE regexp_extract(text, {q('(' + head + f'[{WS}]+[-—–])[{WS}]')}, 1) END], lambda x: x <> '')"
            else:
                found = f"list_filter(regexp_extract_all(text, {q(re2(rx, False))}), lambda x: x <> '')"
            parts.append(f"SELECT lang, 'ja-lint', 9, file, line, {q(rule)}, {trim('m[k]')}, line, {k}, {at}, k " + each.format(found, "'ja'"))
        for at, needle in enumerate(needles, len(patterns)):
            times = f"list_transform(range({occurrences('text', needle)}), lambda x: {q(needle)})"
            parts.append(f"SELECT lang, 'ja-lint', 9, file, line, {q(rule)}, m[k], line, {k}, {at}, k " + each.format(times, "'ja'"))
    return " UNION ALL ".join(parts)


ORACLES["findings_order"] = with_corpus(
    "audit",
    "SELECT row_number() OVER (ORDER BY first_file, lang, tool_ord, file, s1, s2, s3, s4) AS position, lang, tool, file, line, category, quote FROM ordered JOIN (SELECT lang, min(file) AS first_file FROM named GROUP BY lang) USING (lang)",
    *_LANG,
    LINES,
    LOWS,
    "named AS MATERIALIZED (SELECT file, lang FROM detected)",
    "their_lows AS MATERIALIZED (SELECT lang, file, low FROM lows JOIN named USING (file))",
    "their_lines AS MATERIALIZED (SELECT lang, file, line, text FROM lines JOIN named USING (file) WHERE lang IN ('th', 'ja'))",
    f"ordered AS ({_ordered()})",
    front=True,
)
#: The rules of the sample catalog that compile, as they are for RE2.
_SAMPLE = [
    ("own:boilerplate", "high", r"\bLicensed under the \w+ License\b", 0),
    ("own:contact", "medium", r"\+[0-9]{1,3} \([0-9]{3}\)", 0),
    ("own:repetition", "medium", r"(?i)\b(?:the the|and and|very very)\b", 0),
    ("own:markup", "high", r"\|[ \t]*[0-9]+[ \t]*\|", 0),
    ("own:contact", "high", r"[A-Za-z0-9.]+@[A-Za-z0-9]+\.[a-z]+", 0),
]
ORACLES["catalog_runtime"] = with_corpus("en", all_matches(_SAMPLE), LINES)


def _esc(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), '[\\n\\r]+', ' ⏎ ', 'g'), '([*_`#>|])', '\\\\\\1', 'g')"


ORACLES["report_lines"] = f"""WITH {_FOUND}, {_TRIAGED} SELECT CASE WHEN reason IS NOT NULL THEN 'suppressed' ELSE priority END AS section, tool, file, line,
  CASE WHEN reason IS NOT NULL THEN '- ' || {_esc('file')} || ' [`' || {_esc('tool')} || '`/`' || {_esc("coalesce(category, '?')")} || '`]: ' || {_esc('reason')}
  ELSE '- **' || {_esc('file')} || coalesce(':' || line, '') || '** [`' || {_esc('tool')} || '`/`' || {_esc("coalesce(category, '?')")} || '`' || CASE WHEN coalesce(severity, '') <> '' THEN ' ' || {_esc('severity')} ELSE '' END || '] ' || {_esc('quote')} END AS text FROM triaged"""
_P0_ROWS = all_matches(_P0, "m").replace("FROM lines)", "FROM shown)")
_SUMMARY = (
    "found AS ("
    + " UNION ALL ".join(
        [
            _OUT,
            _named("patterns-en", "en", lexicon_sql("file, NULL AS line, severity, category, quote"), [seeded("en"), LOWS]),
            _named("phrases", "en", phrase_sql(S.phrase_needles("en"), "file, NULL AS line, severity, category, quote"), [seeded("en"), LOWS]),
            _named("placeholder", "en", _P0_ROWS, [seeded("placeholder"), LINES, _SHOWN], "'P0'"),
        ]
    )
    + ")"
)
ORACLES["report_summary"] = f"""WITH {_SUMMARY}, {_TRIAGED}, counts AS (SELECT count(*) FILTER (reason IS NULL AND priority = 'P0') AS p0, count(*) FILTER (reason IS NULL AND priority = 'P1') AS p1, count(*) FILTER (reason IS NULL AND priority = 'P2') AS p2, count(*) FILTER (reason IS NOT NULL) AS fp_suppressed FROM triaged)
SELECT *, CAST(0 AS BIGINT) AS tool_failures, CAST(CASE WHEN p0 + p1 > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM counts"""


def _counted(tool: str, lang: str, seed: str, body: str, *ctes: str) -> str:
    return f"SELECT {q(tool)} AS tool, {q(lang)} AS lang, TRUE AS ok, (SELECT count(*) FROM documents) AS files, (WITH {', '.join([seeded(seed), *ctes])} SELECT count(*) FROM ({body})) AS findings, CAST(NULL AS VARCHAR) AS error"


_RUSSIAN = "SELECT (SELECT count(*) FROM (" + ") ) + (SELECT count(*) FROM (".join(ORACLES[k] for k in ("ru_fragment_lead", "ru_stub_paragraph", "ru_dash_density", "ru_arrow_prose")) + "))"
ORACLES["tool_runs"] = " UNION ALL ".join(
    [
        _counted("placeholder", "th", "th", _P0_ROWS, LINES, _SHOWN),
        _counted("phrases", "th", "th", phrase_sql(S.phrase_needles("th")), LOWS),
        _counted("th-lint", "th", "th", all_matches(catalog(others.THAI)), LINES),
        _counted("placeholder", "ru", "ru", _P0_ROWS, LINES, _SHOWN),
        _counted("phrases", "ru", "ru", phrase_sql(S.phrase_needles("ru")), LOWS),
        f"SELECT 'ru-structural', 'ru', TRUE, (SELECT count(*) FROM documents), ({_RUSSIAN}), NULL",
        f"SELECT 'humanizer-ru', 'ru', FALSE, (SELECT count(*) FROM documents), 0, {q(NOT_AVAILABLE)}",
    ]
)
_JA_KINDS = """['{"findings":[]}', 'not json', '{"x":1}', '{"findings":{}}', '', '{"findings":[{"category":"a","excerpt":"b"}]} ', '{"findings":[']"""
ORACLES["ext_ja_errors"] = f"""SELECT file, CASE WHEN NOT json_valid(stdout) THEN 'unparseable lint.py JSON on ' || file WHEN json_type(TRY_CAST(stdout AS JSON), '$.findings') IS DISTINCT FROM 'ARRAY' THEN 'missing findings[] on ' || file END AS error
FROM (SELECT 'p-' || page_id AS file, {_JA_KINDS}[CAST(page_id % 7 AS INTEGER) + 1] AS stdout FROM pages)"""
_JA_FAILED = """(SELECT CASE WHEN doc_id % 50 = 7 THEN 'unparseable lint.py JSON on ' ELSE 'missing findings[] on ' END || 'doc-' || doc_id || '.md' FROM documents WHERE doc_id % 50 IN (7, 9) ORDER BY 'doc-' || doc_id || '.md' LIMIT 1)"""
_JA_RUN = "SELECT {0} AS tool, 'ja' AS lang, {1} AS ok, (SELECT count(*) FROM documents) AS files, CAST(0 AS BIGINT) AS findings, CAST({2} AS VARCHAR) AS error"
ORACLES["tool_runs_failed"] = " UNION ALL ".join(
    [
        _counted("placeholder", "ja", "placeholder", _P0_ROWS, LINES, _SHOWN),
        _JA_RUN.format("'phrases'", "TRUE", "NULL"),
        _JA_RUN.format("'ja-lint'", "TRUE", "NULL"),
        _JA_RUN.format("'natural-japanese'", "FALSE", _JA_FAILED),
    ]
)
ORACLES["summary_failed"] = f"SELECT n AS p0, CAST(0 AS BIGINT) AS p1, CAST(0 AS BIGINT) AS p2, CAST(0 AS BIGINT) AS fp_suppressed, CAST(1 AS BIGINT) AS tool_failures, CAST(2 AS INTEGER) AS exit_code FROM (WITH {', '.join([seeded('placeholder'), LINES, _SHOWN])} SELECT count(*) AS n FROM ({_P0_ROWS}))"
_SPANISH = (
    "found AS ("
    + " UNION ALL ".join(
        [_named("placeholder", "es", _P0_ROWS, [seeded("es"), LINES, _SHOWN], "'P0'"), _named("phrases", "es", phrase_sql(S.phrase_needles("es"), "file, NULL AS line, severity, category, quote"), [seeded("es"), LOWS])]
        + [_named("es-lint", "es", ORACLES[k], []) for k in ("es_catalog", "es_density", "es_mente", "es_inciso")]
    )
    + ")"
)
ORACLES["audit_spanish"] = f"WITH {_SPANISH}, {_TRIAGED} SELECT lang, tool, priority, reason IS NOT NULL AS fp_suppressed, count(*) AS n, count(DISTINCT file) AS files FROM triaged GROUP BY ALL"


def _audited() -> str:
    """All built-in tools on the documents of their own languages, from the SQL of each."""

    def own(tool: str, lang: str, name: str, seed: str, preset: str = "NULL") -> str:
        body = ORACLES[name].removeprefix("WITH " + seeded(seed))
        return f"SELECT {q(tool)} AS tool, {q(lang)} AS lang, file, CAST(NULL AS INTEGER) AS line, severity, category, quote, CAST({preset} AS VARCHAR) AS preset FROM (WITH corpus AS (SELECT file, content FROM whole WHERE lang = {q(lang)}){body})"

    parts = []
    for lang in L.LANGS:
        parts += [own("placeholder", lang, "p0_placeholders", "placeholder", "'P0'"), own("phrases", lang, f"phrases_{lang}", "phrases")]
    parts += [own("patterns-en", "en", f"patterns_en_{c}", "en") for c in [*dict.fromkeys(r[1] for r in _RE2_RULES), "not_re2"]]
    parts += [own("patterns-en", "en", "lexicon_en", "en"), own("metrics", "en", "metrics_findings", "metrics"), own("viet-lint", "vi", "viet_lint", "vi"), own("ja-lint", "ja", "ja_lint", "ja")]
    parts += [own("ru-structural", "ru", f"ru_{x}", "ru") for x in ("fragment_lead", "stub_paragraph", "dash_density", "arrow_prose")]
    parts += [own("es-lint", "es", f"es_{x}", "es") for x in ("catalog", "density", "mente", "inciso")]
    parts += [own(f"{lang}-lint", lang, f"{lang}_lint", lang) for lang in ("th", "my", "id")]
    return " UNION ALL ".join(parts)


ORACLES["audit_full"] = with_corpus(
    "audit",
    "SELECT lang, tool, priority, count(*) AS n, count(DISTINCT file) AS files FROM triaged GROUP BY ALL",
    *_LANG,
    "whole AS MATERIALIZED (SELECT lang, file, content FROM corpus JOIN detected USING (file))",
    f"found AS ({_audited()})",
    _TRIAGED,
    front=True,
)
for _name, _corpus in (
    ("audit_conversations", "SELECT 'conv-' || conv_id || '-' || turn AS file, coalesce(text, '') AS content FROM conversations"),
    ("audit_pages", "SELECT 'page-' || page_id || '.md' AS file, coalesce(html, '') AS content FROM pages"),
):
    ORACLES[_name] = ORACLES["audit_full"].replace(seeded("audit", True), f"corpus AS ({_corpus})", 1).replace("SELECT lang, tool, priority, count", "SELECT lang, tool, category, priority, count")
