"""Secret scans: candidates by pattern, false positives removed by a random forest, all in native columns.

Candidates are of two kinds. Anywhere: maximal runs of 16 or more token characters (A-Z, a-z, 0-9, ``+ / _ -``)
that hold a digit, with up to two ``=`` of padding; an ``=`` elsewhere ends a run, so the name in ``secret=...``
is no part of it. Right behind a word such as password or token and ``=`` or ``:``: any run of six or more
characters without white space, quotes, commas, semicolons and angle brackets, with or without a digit. Their
features - length, character transitions, dictionary coverage, the path, the neighbouring words - are column
expressions. The forest is fitted by Spark's own learner on a small table of labelled findings (at most
``MAX_LABELLED`` rows, taken in the order of a hash of the row, are used for fitting) and compiled into one CASE
expression per tree, so scoring a corpus is a scan and a projection: no shuffle, no Python on the executors.

Defined cases: a null or empty text has no candidates; a null path counts as empty; a run may be as long
as the text; repeated rows give their findings each time. An empty labelled table accepts every
candidate (score 1). ``start`` and ``end`` count characters from 0, end exclusive. Other columns named in
``keep`` pass through, whatever their names; one that is called like a column of the result is left out.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
TREES, DEPTH, SEED = 15, 5, 7
#: Behind an assignment (checked first, as it is cheap) to a telling name; else any long run with a digit.
CANDIDATE = (
    r"(?<=[=:]\s{0,2}[\"'`]?)(?<=(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential)[\"'`]?\s{0,2}[=:]\s{0,2}[\"'`]?)(?![\"'`=:])[^\s\"'`,;<>]{6,}"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
)
FEATURES = ("length", "transitions", "alternation", "distinct", "digits", "uppers", "hex", "dictionary", "path", "cue", "assigned", "against", "quoted")
#: Words and word parts whose share of a candidate is its dictionary coverage.
DICTIONARY = ("example", "sample", "test", "dummy", "placeholder", "your", "key", "token", "secret", "password", "user", "name", "value", "default", "version", "build", "page", "index", "image", "file", "data", "http", "www", "html", "the", "and", "for", "with", "that", "this", "from", "ing", "tion", "ment", "est", "ent", "ion", "ter", "ver", "con", "pro", "per", "com", "ist", "all", "und", "der", "die", "que", "les", "los", "una")
CUES = r"(?:token|secret|passw(?:or)?d|pwd|passphrase|api[ _-]?key|access[ _-]?key|auth|bearer|credential|private[ _-]?key)[^a-z0-9]{0,6}$"
AGAINST = r"(?:sha\d*|md5|commit|checksum|digest|hash|uuid|guid|etag|revision|example|sample|dummy|placeholder|version|order|isbn|card|phone|invoice|id|ref)[^a-z0-9]{0,6}$"
PATHS = r"test|spec|example|sample|doc|readme|fixture|mock|vendor|node_modules|lock"


def labelled_findings(spark: SparkSession) -> DataFrame:
    """Small labelled table made by rule: candidate, before, after, path, label (1: a secret)."""

    def text(kind: str, n: int, size: int, letters: str) -> str:
        out, k = "", 0
        while len(out) < size:
            out += "".join(letters[b % len(letters)] for b in hashlib.sha256(f"{kind}/{n}/{k}".encode()).digest())
            k += 1
        return out[:size]

    hexa, base62, digits = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789"
    cues = ("token = \"", "api_key: ", "secret=", "password = '", "Authorization: Bearer ", "access-key=\"", "TOKEN = \"", "private_key = ")
    calm = ("commit ", "sha256:", "md5 checksum ", "uuid ", "etag: ", "digest=", "order no. ", "card ", "invoice id ", "see ")
    plain = ("the ", "of them ", "und ", "que ", "and in ", "")
    letters = base62[:52]
    mixed = base62 + "@#%!?*.-_"
    values = ("required", "unchanged", "optional", "disabled", "changeme", "none-given", "see-below", "must-not-be-empty", "example", "generated", "placeholder", "(hidden)", "[redacted]", "${SECRET}", "string", "********")
    rows = []
    for n in range(60):
        quote = ("\"", "'", "`")[n % 3]
        cue = cues[n % len(cues)]
        shut = cue[-1] + " " if cue[-1] in "\"'" else " "
        later = cues[(n + 3) % len(cues)]
        shut_later = later[-1] + " " if later[-1] in "\"'" else " "
        size = (20, 24, 32, 40, 40, 64)[n % 6]
        path = ("src/app/config.py", "src3", "deploy/prod.env", "src11", "settings.yaml")[n % 5]
        rows.append((text("hex", n, size, hexa), f"some text {cue}", f"{shut}more words", path, 1))
        rows.append((text("b62", n, size, base62), f"words {later}", f"{shut_later}after that", path, 1))
        rows.append((text("b64", n, size - 2, base62) + "==", f"words {cues[0]}", "\" after that", path, 1))
        rows.append((text("up", n, size, hexa).upper(), f"WORDS!! {cues[6]}", "\"!! MORE", path, 1))
        rows.append((text("short", n, 8 + n % 6, mixed).strip(".-") + "x7", f"more {('password', 'secret', 'pwd', 'token')[n % 4]}{('=', ': ', ' = ')[n % 3]}{quote}", f"{quote} and", path, 1))
        rows.append((text("word", n, 18 + n % 9, letters), f"and {('api_key', 'secret', 'token')[n % 3]}{('=', ': ')[n % 2]}", " and", path, 1))
        rows.append((text("sha", n, (32, 40, 64)[n % 3], hexa), f"some {calm[n % 6]}", " more", path, 0))
        rows.append((text("num", n, (16, 16, 19, 24)[n % 4], digits), f"some {plain[n % 6]}", " words", path, 0))
        rows.append((text("card", n, 16, digits), f"some {calm[6 + n % 4]}", ", words", path, 0))
        word = "-".join(DICTIONARY[(n * 7 + k * 5) % len(DICTIONARY)] for k in range(4))
        rows.append((f"{word}{n % 10}", f"some {plain[n % 6]}", " words", path, 0))
        rows.append((f"your-{('token', 'secret', 'password')[n % 3]}-example-{n:04d}", cue, f"{shut}words", "docs/readme.md", 0))
        rows.append((text("fix", n, size, hexa), f"example {calm[n % 6]}", " words", "tests/fixtures/sample.json", 0))
        rows.append((f"/en/{word}/{n * 31}", "link ", " words", path, 0))
        rows.append((values[n % len(values)], f"the {('password', 'token', 'secret', 'api key')[n // 16]}: ", " here", path, 0))
        rows.append((values[(n + 5) % len(values)], f"{('password', 'secret', 'token')[n % 3]}={quote}", f"{quote} here", path, 0))
    return spark.createDataFrame(rows, "candidate string, before string, after string, path string, label int")


def candidates(docs: DataFrame, text: str = "text", path: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """kept (a struct of the columns ``keep``), candidate, before, after (40 characters each), path, start, end: one row per candidate of every whole text."""
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None)
    base = docs.select(kept.alias("kept"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("hits", F.regexp_extract_all("text", F.lit(CANDIDATE), 0)).where(F.size("hits") > 0)
    base = base.withColumn("gaps", F.split("text", CANDIDATE))
    # offset of each hit: lengths of the gaps and hits before it, summed in one pass
    steps = F.zip_with(F.slice("gaps", 1, F.size("hits")), "hits", lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    spans = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts")),
        lambda acc, x: F.struct((acc["end"] + x["g"] + x["h"]).alias("end"), F.array_append(acc["starts"], acc["end"] + x["g"]).alias("starts")),
    )["starts"]
    base = base.withColumn("starts", spans)
    rows = base.select("kept", "path", "gaps", "starts", F.posexplode("hits").alias("k", "candidate"))
    gap = lambda k: F.coalesce(F.get("gaps", k), F.lit(""))
    start = F.get("starts", F.col("k"))
    return rows.select("kept", "candidate", F.right(gap(F.col("k")), F.lit(40)).alias("before"), F.left(gap(F.col("k") + 1), F.lit(40)).alias("after"), "path", start.alias("start"), (start + F.length("candidate")).alias("end"))


def features() -> dict[str, Column]:
    """The features as columns of candidate, before, after and path."""
    c, size = F.col("candidate"), F.length("candidate").cast("double")
    low, before = F.lower(c), F.lower("before")
    share = lambda pattern: (size - F.length(F.regexp_replace(c, pattern, ""))) / size
    return {
        "length": size,
        "transitions": F.regexp_count(c, F.lit(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]")) / size,
        "alternation": F.regexp_count(low, F.lit(r"[aeiou][b-df-hj-np-tv-z]")) / size,
        "distinct": F.size(F.array_distinct(F.split(low, ""))) / size,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "hex": c.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "dictionary": (size - F.length(F.regexp_replace(low, "|".join(DICTIONARY), ""))) / size,
        "path": F.lower("path").rlike(PATHS).cast("double"),
        "cue": before.rlike(CUES).cast("double"),
        "assigned": before.rlike(r"[=:]\s*[\"'`]?$").cast("double"),
        "against": before.rlike(AGAINST).cast("double"),
        "quoted": (before.rlike(r"[\"'`]$") & F.col("after").rlike(r"^[\"'`]")).cast("double"),
    }


def _fitted(labelled: DataFrame):
    """The learner's forest and the rows that it was fitted on, or None."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    row = ("candidate", "before", "after", "path", "label")
    rows = labelled.where("candidate is not null and label is not null").na.fill("", ["before", "after", "path"]).orderBy(F.xxhash64(*row), *row).limit(MAX_LABELLED)
    rows = rows.select(F.col("label").cast("double").alias("label"), *(v.alias(k) for k, v in features().items()))
    if rows.isEmpty():
        return None
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows.coalesce(1))
    return RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(data), data


def train_forest(labelled: DataFrame) -> list[str]:
    """Random forest on the labelled findings; one SQL expression (0.0 or 1.0) per tree."""
    found = _fitted(labelled)
    return [] if found is None else [_compiled(tree.toDebugString) for tree in found[0].trees]


def _compiled(debug: str) -> str:
    """A tree's printed form as a CASE expression."""
    lines = [x.strip() for x in debug.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict"):
            return f"{float(line.split(':')[1])}D"
        k, bound = re.fullmatch(r"If \(feature (\d+) <= ([-0-9.E]+)\)", line).groups()
        low = node()
        at += 1  # the Else line
        return f"CASE WHEN `{FEATURES[int(k)]}` <= {float(bound)!r}D THEN {low} ELSE {node()} END"

    return node()


def scan(docs: DataFrame, trees: list[str], text: str = "text", path: str = "source", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """keep, start, end, candidate, score (share of the trees that say secret) and is_secret, one row per candidate."""
    found = candidates(docs, text, path, keep).withColumns({f"is {k}": v for k, v in features().items()})
    votes = [F.expr(re.sub(r"`(\w+)`", r"`is \1`", t)) for t in trees]
    score = sum(votes[1:], votes[0]) / len(votes) if votes else F.lit(1.0)
    new = ("start", "end", "candidate", "score", "is_secret")
    found = found.withColumn("score", score).withColumn("is_secret", F.col("score") >= threshold)
    return found.select(*(F.col("kept")[c].alias(c) for c in keep if c not in new), *new)
