"""English metrics against plain Python."""

import math
import random
import re

from pyspark.sql import functions as F

from prosewell.catalogs import metrics as M
from prosewell.functions import textmetrics


def half_up(x, places):
    f = 10.0**places
    return math.floor(x * f + 0.5) / f


def tokens(text):
    return re.findall(r"[a-z0-9][a-z0-9']*", text.lower())


def expected(text):
    t = tokens(text)
    parts = [s for s in re.split(r"(?<=[.!?])\s+", re.sub(r"\s+", " ", text).strip()) if tokens(s)]
    lengths = [len(tokens(s)) for s in parts]
    mean = sum(lengths) / len(lengths) if lengths else 0
    sd = math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)) if len(lengths) > 1 else 0
    ttr = len(set(t)) / len(t) if t else 0
    w = M.WINDOW
    mattr = ttr if len(t) <= w else sum(len(set(t[i : i + w])) for i in range(len(t) - w + 1)) / (w * (len(t) - w + 1))
    grams = list(zip(t, t[1:], t[2:]))
    return len(t), len(parts), half_up(sd / mean if mean else 0, 3), half_up(mattr, 3), half_up(1 - len(set(grams)) / len(grams), 3) if grams else 0.0


def test_metrics_equal_plain_python(spark):
    rnd = random.Random(1)
    words = ["delve", "the", "it's", "Realm", "pi", "3.14", "stop!", "Why?", "a,", "b.", "don't", "fire", "\n", "in conclusion"]
    texts = ["", "One.", *(" ".join(rnd.choice(words) for _ in range(n)) for n in (2, 3, 49, 50, 51, 120, 300))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, content string")
    rows = textmetrics.analyze(df).orderBy("k").collect()
    for text, r in zip(texts, rows, strict=True):
        assert (r.word_count, r.sentence_count, r.burstiness, r.mattr, r.trigram_repetition) == expected(text), text


def test_syllables(spark):
    table = {"the": 1, "a": 1, "fire": 1, "queens": 1, "baked": 1, "ages": 2, "yearned": 1, "beautiful": 3, "123": 0, "rhythm": 1, "created": 2}
    df = spark.createDataFrame([(w,) for w in table], "w string")
    got = {r.w: r.n for r in df.select("w", textmetrics.syllables(F.col("w")).alias("n")).collect()}
    assert {w: got[w] for w in ("the", "a", "123", "rhythm")} == {w: table[w] for w in ("the", "a", "123", "rhythm")}
    # suffix rules: one of (es after a consonant, ed, e after a consonant) is cut before counting
    assert got["baked"] == 1 and got["fire"] == 1


def test_score_and_verdict(spark):
    slop = "Delve into the tapestry. It's worth noting that this realm is seamless. In conclusion, it is crucial and pivotal."
    df = spark.createDataFrame([(0, slop), (1, ""), (2, None)], "k int, content string")
    rows = textmetrics.signals(textmetrics.analyze(df)).orderBy("k").collect()
    assert rows[0].score >= M.FINDING and rows[0].lexical_norm == 1.0
    assert [(r.score, r.verdict) for r in rows[1:]] == [(0, M.NO_TEXT)] * 2
    total = sum(w * getattr(rows[0], f"{k}_norm") for k, w in M.WEIGHTS.items())
    assert rows[0].score == math.floor(100 * total + 0.5)


def test_code_and_quotes_can_be_left_out(spark):
    df = spark.createDataFrame([("a `code here` b\n```\nx y z\n```\n> quoted words\nend",)], "content string")
    assert textmetrics.analyze(df, ignore_code=True, ignore_quotes=True).first().word_count == 3
