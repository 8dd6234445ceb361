"""Language routing: path segments, script and function-word counts, the decision ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewell.catalogs.languages import ALIASES, CERTAIN, LANGS, SAMPLE, SCRIPTS, WORDS
from prosewell.functions.textmetrics import fenced_off


def path_language(path: Column) -> Column:
    """Language named by the first path segment that is an alias, else null."""
    table = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    named = F.filter(F.split(F.lower(path), r"[/\\._-]+"), lambda s: s.isin(*ALIASES))
    return F.element_at(table, F.get(named, F.lit(0)))


def sample(content: Column) -> Column:
    return F.substring(content, 1, SAMPLE)


def _count(text: Column, letters: str) -> Column:
    return F.when(text == "", 0).otherwise(F.length(F.regexp_replace(text, f"[^{letters}]+", "")))


def _is_one_of(words: list[str]):
    return lambda w: w.isin(*words)


def with_markers(docs: DataFrame, content: str = "content", if_read: bool = False) -> DataFrame:
    """``docs`` with one count per script and word list, over the sample of each text. A null text counts as empty.

    All scripts but the Latin letters lie outside of ASCII, so they are counted in what is left without it. A
    word is a maximal run of its list's letters, so membership equals a guarded match; lists over the same
    letters share their words. With ``if_read``, counts that nothing reads are not made, and those that are read twice may be
    made twice.
    """
    text = sample(F.coalesce(F.col(content), F.lit("")))
    named = docs.withColumn("__sample", text)
    named = named.withColumns({"__lower": F.lower("__sample"), "__foreign": F.regexp_replace("__sample", r"[\x00-\x7F]+", "")})
    runs = {letters: f"__words_{k}" for k, letters in enumerate(dict.fromkeys(letters for letters, _ in WORDS.values()))}
    named = named.withColumns({c: F.regexp_extract_all("__lower", F.lit(f"[{letters}]+"), F.lit(0)) for letters, c in runs.items()})
    counts = {k: _count(F.col("__sample" if k == "latin" else "__foreign"), v) for k, v in SCRIPTS.items()}
    counts |= {k: F.size(F.filter(runs[letters], _is_one_of(words))) for k, (letters, words) in WORDS.items()}
    return named.select(*docs.columns, *(v.alias(k) for k, v in counts.items())) if if_read else fenced_off(named, docs.columns, counts)


#: The decision ladder, in order: condition on the counts, language.
LADDER = [
    ("hangul > 10 AND hangul * 3 > cyrillic", "ko"),
    ("cyrillic > 10 AND cyrillic > hangul * 3", "ru"),
    ("kana > 10 AND kana * 3 > cyrillic", "ja"),
    ("thai > 10 AND thai * 3 > cyrillic", "th"),
    ("myanmar > 10 AND myanmar * 3 > cyrillic", "my"),
    ("es_strong > 5 AND es_strong * 5 > en", "es"),
    ("es_stop > 40 AND es_stop > pt * 3 AND es_stop > en * 2", "es"),
    ("vi_marks > 8 AND vi_marks * 5 > latin", "vi"),
    ("vi_marks > 20 AND latin > vi_marks * 3", "vi"),
    ("id_stop > 40 AND id_stop > en * 2", "id"),
]
#: The counts any of which makes a text certain.
CERTAIN_MARKS = ["hangul", "cyrillic", "kana", "vi_letters", "es_stop", "thai", "myanmar", "id_stop"]


def ladder_sql() -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{lang}'" for c, lang in LADDER) + " ELSE 'en' END"


def certain_sql() -> str:
    return " OR ".join(f"{k} > {CERTAIN}" for k in CERTAIN_MARKS)


def detect(docs: DataFrame, file: str = "file", content: str = "content", override: str | None = None) -> DataFrame:
    """``docs`` with lang and confident; ``override`` sets the language of all."""
    if override is not None and override not in LANGS:
        raise ValueError(f"language must be one of {', '.join(LANGS)}")
    kept = docs.columns
    named = with_markers(docs, content, override is not None).withColumn("__by_path", path_language(F.coalesce(F.col(file), F.lit(""))))
    lang = F.lit(override) if override else F.coalesce("__by_path", F.expr(ladder_sql()))
    confident = F.col("__by_path").isNotNull() | F.expr(certain_sql())
    return named.select(*kept, lang.alias("lang"), confident.alias("confident"))


def buckets(detected: DataFrame) -> DataFrame:
    """lang, files, first_file, uncertain: the files of each language; first_file gives the order of first sight."""
    return detected.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.min("file").alias("first_file"), F.count_if(~F.col("confident")).alias("uncertain"))


def uncertain(detected: DataFrame) -> DataFrame:
    """Files whose language is a guess."""
    return detected.where(~F.col("confident")).select("file", "lang")
