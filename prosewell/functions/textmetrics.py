"""English metrics as column expressions: sentences, tokens, syllables, lexical diversity, the composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewell.catalogs import metrics as M
from prosewell.functions.regexes import collapsed, occurrences, trimmed

TOKEN = "[a-z0-9][a-z0-9']*"


def strip_marked(text: Column, ignore_code: bool = False, ignore_quotes: bool = False) -> Column:
    """Text without code and quoted lines, where asked."""
    if ignore_code:
        for pattern in (r"(?s)```.*?```", r"`[^`\n]*`", r"(?m)^( {4,}|\t).*$"):
            text = F.regexp_replace(text, pattern, " ")
    if ignore_quotes:
        text = F.regexp_replace(text, r"(?m)^\s*>.*$", " ")
    return text


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _parts(text: Column) -> Column:
    """White space collapsed, cut after . ! ? before a space."""
    return F.split(F.trim(collapsed(text)), r"(?<=[.!?]) +")


def sentences(text: Column) -> Column:
    """Sentences that hold a token."""
    return F.filter(F.transform(_parts(text), trimmed), lambda s: F.lower(s).rlike("[a-z0-9]"))


def sentence_lengths(lowered: Column) -> Column:
    """Tokens of each sentence of a lower-cased text that holds one, counted without building them."""
    return F.filter(F.transform(_parts(lowered), lambda s: F.regexp_count(s, F.lit(TOKEN))), lambda n: n > 0)


def syllables(word: Column) -> Column:
    """Heuristic syllables of a token."""
    letters = F.translate(word, "0123456789'", "")
    stem = F.regexp_replace(letters, r"(?:[^laeiouy]es|ed|[^laeiouy]e)\z", "")
    stem = F.when(F.startswith(stem, F.lit("y")), F.substring(stem, F.lit(2), F.length(stem))).otherwise(stem)
    return F.when(letters == "", 0).when(F.length(letters) <= 3, 1).otherwise(F.greatest(F.regexp_count(stem, F.lit("[aeiouy]{1,2}")), F.lit(1)))


def rounded(x: Column, places: int) -> Column:
    """Half up, as floor(x * f + 0.5) / f."""
    f = float(10**places)
    return F.floor(x * f + 0.5) / f


def mean(xs: Column) -> Column:
    n = F.size(xs)
    return F.when(n > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)


def stdev(xs: Column, m: Column) -> Column:
    """Population standard deviation, 0 below two values."""
    n = F.size(xs)
    return F.when(n >= 2, F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n)).otherwise(0.0)


def type_token_ratio(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n > 0, F.size(F.array_distinct(tokens)) / n).otherwise(0.0)


def sorted_tokens(tokens: Column) -> Column:
    """array<struct<t, i>>: the tokens with their places, in order, so that equal ones stand together."""
    return F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))


def mattr(n: Column, ordered: Column, ratio: Column, window: int = M.WINDOW) -> Column:
    """Mean type-token ratio of all windows; of the whole text where it is no longer than one.

    A token counts in the windows in which it is the first of its kind: those that begin after the same token's
    place before it. So the sum over all windows is one pass over the places, not one per window.
    """
    windows = n - (window - 1)
    before = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("t"), F.lit(-1).alias("i"))), ordered)

    def fresh(b, x):
        begins = F.greatest(F.when(b["t"] == x["t"], b["i"] + 1).otherwise(0), x["i"] - (window - 1), F.lit(0))
        # x is null where the longer of the two lists ends
        return F.when(x.isNull(), 0).otherwise(F.greatest(F.least(x["i"], n - window) - begins + 1, F.lit(0)))

    total = F.aggregate(F.zip_with(before, ordered, fresh), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(n <= window, ratio).otherwise(total / (window * windows).cast("double"))


def total_syllables(tokens: Column) -> Column:
    """The sum of ``syllables`` over tokens, counted on all of them at once.

    Digits and apostrophes go; then words of one to three letters count one each, and of the others those without
    a vowel behind the cut of their ends count one, too.
    """
    letters = F.translate(F.array_join(tokens, " "), "0123456789'", "")
    long = F.regexp_replace(letters, r"(?<![a-z])[a-z]{1,3}(?![a-z])", "")
    stems = F.regexp_replace(F.regexp_replace(long, r"(?:[bcdfghjkmnpqrstvwxz]es|ed|[bcdfghjkmnpqrstvwxz]e)(?![a-z])", ""), r"(?<![a-z])y", "")
    short = F.regexp_count(letters, F.lit(r"(?<![a-z])[a-z]{1,3}(?![a-z])"))
    voiced = F.regexp_count(stems, F.lit(r"(?<![a-z])[a-z]*?[aeiouy][a-z]*+"))
    return short + F.regexp_count(long, F.lit("[a-z]++")) - voiced + F.regexp_count(stems, F.lit("[aeiouy]{1,2}"))


def trigram_repetition(tokens: Column) -> Column:
    """Share of word trigrams that repeat an earlier one."""
    n = F.size(tokens)
    grams = F.transform(F.slice(tokens, 1, F.greatest(n - 2, F.lit(0))), lambda t, i: F.concat_ws(" ", t, F.get(tokens, i + 1), F.get(tokens, i + 2)))
    return F.when(n >= 3, 1 - F.size(F.array_distinct(grams)) / (n - 2)).otherwise(0.0)


def vocabulary(docs: DataFrame) -> DataFrame:
    """Adds tier1, tier2, phrase_tells and density from __text and tokens."""
    n = F.size("tokens")
    # a look for any of the words is fast, a count goes through all tokens
    count = lambda words: F.when(F.arrays_overlap("tokens", F.array(*map(F.lit, words))), F.size(F.filter("tokens", lambda t: t.isin(*words)))).otherwise(0)
    if "__lowered" not in docs.columns:  # lower-cased once, not for each phrase
        docs = docs.withColumn("__lowered", F.lower("__text"))
    lowered = F.col("__lowered")
    phrases = sum((occurrences(lowered, p) for p in M.PHRASES[1:]), occurrences(lowered, M.PHRASES[0]))
    docs = docs.withColumns({"tier1": count(M.TIER1), "tier2": count(M.TIER2), "phrase_tells": phrases})
    weighted = F.col("tier1") * M.WEIGHT_TIER1 + F.col("tier2") * M.WEIGHT_TIER2 + F.col("phrase_tells") * M.WEIGHT_PHRASE
    return docs.withColumn("density", F.when(n > 0, weighted / n).otherwise(0.0))


#: The metrics of a text, in order.
METRICS = ["word_count", "sentence_count", "mean_sentence_length", "sentence_length_stdev", "sentence_length_cov", "burstiness", "burstiness_gb", "type_token_ratio", "mattr", "trigram_repetition", "fk_grade", "fk_ease", "vocab_tells", "vocab_tell_density", "short_sample"]


#: Those that the score is made of.
SCORED = ["word_count", "burstiness", "mattr", "trigram_repetition", "vocab_tell_density"]


def analyze(docs: DataFrame, content: str = "content", ignore_code: bool = False, ignore_quotes: bool = False, names: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns of METRICS, or those of ``names``; others are not computed. A null text counts as empty."""
    kept = docs.columns
    d = docs.withColumn("__text", strip_marked(F.coalesce(F.col(content), F.lit("")), ignore_code, ignore_quotes))
    d = d.withColumn("__lowered", F.lower("__text"))
    d = d.withColumns({"tokens": F.regexp_extract_all("__lowered", F.lit(TOKEN), F.lit(0)), "lengths": sentence_lengths(F.col("__lowered"))})
    d = vocabulary(d.withColumn("ordered", sorted_tokens(F.col("tokens"))))
    d = d.withColumns({"words": F.size("tokens"), "parts": F.size("lengths"), "m": mean(F.col("lengths")), "ratio": type_token_ratio(F.col("tokens")), "syllables": total_syllables(F.col("tokens"))})
    d = d.withColumn("s", stdev(F.col("lengths"), F.col("m")))
    words, parts, m, s = (F.col(c) for c in ("words", "parts", "m", "s"))
    wps = F.when(parts > 0, words / parts).otherwise(0.0)
    spw = F.when(words > 0, F.col("syllables") / words).otherwise(0.0)
    cov = rounded(F.when(m != 0, s / m).otherwise(0.0), 3)
    found = {
        "word_count": words,
        "sentence_count": parts,
        "mean_sentence_length": rounded(m, 2),
        "sentence_length_stdev": rounded(s, 2),
        "sentence_length_cov": cov,
        "burstiness": cov,
        "burstiness_gb": rounded(F.when(s + m != 0, (s - m) / (s + m)).otherwise(0.0), 3),
        "type_token_ratio": rounded(F.col("ratio"), 3),
        "mattr": rounded(mattr(words, F.col("ordered"), F.col("ratio")), 3),
        "trigram_repetition": rounded(trigram_repetition(F.col("tokens")), 3),
        "fk_grade": rounded(F.when(words > 0, 0.39 * wps + 11.8 * spw - 15.59).otherwise(0.0), 1),
        "fk_ease": rounded(F.when(words > 0, 206.835 - 1.015 * wps - 84.6 * spw).otherwise(0.0), 1),
        "vocab_tells": F.col("tier1") + F.col("tier2") + F.col("phrase_tells"),
        "vocab_tell_density": rounded(F.col("density"), 4),
        "short_sample": words < M.SHORT,
    }
    return fenced_off(d, kept, {k: found[k] for k in (METRICS if names is None else names)})


def fenced_off(df: DataFrame, kept: list[str], found: dict[str, Column]) -> DataFrame:
    """``kept`` and the found columns, computed once.

    They pass through a generator of one row, which no filter crosses: a filter on a score would else be pushed
    below and evaluate every metric once for each place that mentions it.
    """
    # a generator interprets what it is given, so the row is made by a projection below it
    row = F.struct(*(v.alias(k) for k, v in found.items()))
    return df.select(*kept, row.alias("__row")).select(*kept, F.inline(F.array("__row")))


def each(df: DataFrame, kept: list[str] | tuple[str, ...], values: Column, name: str) -> DataFrame:
    """``kept`` and ``name``: one row per entry of an array, which is computed once. Entries are never null.

    Below a plain explode, Spark puts a filter on the array's size, which moves below the projection that makes the array
    and makes it a second time. An outer explode has no such filter.
    """
    # a generator interprets what it is given, so the array is made by a projection below it
    return df.select(*kept, values.alias(name)).select(*kept, F.explode_outer(name).alias(name)).where(F.col(name).isNotNull())


def signals(metrics: DataFrame) -> DataFrame:
    """Adds the four contributors: <name>_norm (0 to 1) and <name>_points, then score_raw, score and verdict."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    some = F.col("word_count") > 0
    norms = {
        "burstiness": (M.COV_HUMAN - F.col("burstiness")) / M.COV_HUMAN,
        "diversity": (M.TTR_HIGH - F.col("mattr")) / (M.TTR_HIGH - M.TTR_LOW),
        "repetition": F.col("trigram_repetition") / M.REP_MAX,
        "lexical": F.col("vocab_tell_density") / M.VOCAB_MAX,
    }
    out = metrics.withColumns({f"{k}_norm": F.when(some, clamp(v)).otherwise(0.0) for k, v in norms.items()})
    out = out.withColumns({f"{k}_points": rounded(w * F.col(f"{k}_norm") * 100, 3) for k, w in M.WEIGHTS.items()})
    total = F.lit(0.0)
    for k, w in M.WEIGHTS.items():
        total = total + w * F.col(f"{k}_norm")
    out = out.withColumn("__raw", 100 * total)
    verdict = F.when(~some, M.NO_TEXT)
    for bound, name in M.VERDICTS:
        verdict = verdict.when(F.col("score") <= bound, name)
    out = out.withColumns({"score_raw": rounded(F.col("__raw"), 6), "score": F.floor(F.col("__raw") + 0.5)}).drop("__raw")
    return out.withColumn("verdict", verdict.otherwise(M.LAST_VERDICT))
