"""Rewriting of rule patterns."""

import re

from pyspark.sql import functions as F

from prosewell.catalogs import english, others
from prosewell.functions.regexes import english as english_rule
from prosewell.functions.regexes import general, masked, occurrences, required, trimmed


def test_every_rule_compiles(spark):
    one = spark.createDataFrame([("x",)], "t string")
    rules = [english_rule(r[3]) for r in english.RULES] + [general(r[3]) for c in (others.SPANISH, others.THAI, others.BURMESE, others.INDONESIAN) for r in c] + [general(p, False) for r in others.JAPANESE for p in r[2]]
    row = one.select(*(F.col("t").rlike(p).alias(f"r{k}") for k, p in enumerate(rules))).first()
    assert len(row) == len(rules) == 139 + 14 + 5


def test_word_boundaries_are_ascii(spark):
    df = spark.createDataFrame([("el está aquí",), ("esta",)], "t string")
    assert [r.x for r in df.select(F.col("t").rlike(general(r"\best\b", True)).alias("x")).collect()] == [True, False]


def test_masking_keeps_length_and_ascii(spark):
    df = spark.createDataFrame([("Café — naïve ✅ ok 中",)], "t string")
    row = df.select("t", masked(F.col("t")).alias("m")).first()
    assert len(row.m) == len(row.t) and row.m == re.sub("[éï中]", "￼", row.t)


def test_required_literals_are_necessary():
    # strings drawn from the rules' own words, matched with Python's engine
    probes = ["it's worth noting", "In conclusion,", "this changes everything", "#a #b #c", "agree?", "take it to the next level", "let you go. it lets you", "one becomes two. two becomes three"]
    for name, _, _, rx in english.RULES:
        literals = required(rx)
        assert literals, name
        for text in probes:
            if re.search(english_rule(rx), text, re.ASCII):
                assert any(x in text.lower() for x in literals), (name, text)


def test_trim_and_occurrences(spark):
    df = spark.createDataFrame([(" \t a b ﻿\n", "aaaa"), ("", "")], "t string, u string")
    rows = df.select(trimmed(F.col("t")).alias("t"), occurrences(F.col("u"), "aa").alias("n")).collect()
    assert [(r.t, r.n) for r in rows] == [("a b", 2), ("", 0)]
