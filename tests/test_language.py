"""Language routing."""

import pytest

from prosewell.functions import language

PATHS = [("content/blog/ru/post.md", "ru"), ("my-notes.md", None), ("user-id.md", None), ("content/ind/post.md", "id"), ("docs/EN/readme.md", "en"), ("a/jp/b.ru.md", "ja"), ("x/espanol.md", "es"), ("burmese/a.md", "my"), ("plain.md", None)]
TEXTS = [
    ("안녕하세요 여러분 오늘은 날씨가 좋습니다", "ko"),
    ("Привет всем, сегодня хорошая погода", "ru"),
    ("これはとてもいい天気ですね、みなさん", "ja"),
    ("สวัสดีครับ วันนี้อากาศดีมาก", "th"),
    ("မင်္ဂလာပါ ဒီနေ့ ရာသီဥတု", "my"),
    ("¿Qué? ¡Niño! ¡Año! ¿Ñu? ¡Eñe!", "es"),
    ("que los las del una para pero muy como entre " * 5, "es"),
    ("não uma então mesmo após que los las del una para pero muy " * 4, "en"),
    ("yang dan di ke dari ini itu dengan untuk pada " * 5, "id"),
    ("Việt Nam là một đất nước rất đẹp và những người đều thân thiện", "vi"),
    ("Plain words of the garden", "en"),
    ("中文没有假名只有汉字这里应该是英文", "en"),
    ("", "en"),
    (None, "en"),
]


def test_paths(spark):
    df = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(PATHS)], "k int, p string")
    got = [r.x for r in df.select("k", language.path_language(df.p).alias("x")).orderBy("k").collect()]
    assert got == [x for _, x in PATHS]


def test_texts(spark):
    df = spark.createDataFrame([(f"f{k:02}.md", t) for k, (t, _) in enumerate(TEXTS)], "file string, content string")
    got = [r.lang for r in language.detect(df).orderBy("file").collect()]
    assert got == [x for _, x in TEXTS]


def test_certainty_and_buckets(spark):
    df = spark.createDataFrame([("b.md", "words"), ("ru/a.md", "words"), ("a.md", "가" * 51), ("c.md", "가" * 50)], "file string, content string")
    found = language.detect(df)
    assert {r.file: (r.lang, r.confident) for r in found.collect()} == {"b.md": ("en", False), "ru/a.md": ("ru", True), "a.md": ("ko", True), "c.md": ("ko", False)}
    assert {r.lang: (r.files, r.first_file, r.uncertain) for r in language.buckets(found).collect()} == {"en": (1, "b.md", 1), "ru": (1, "ru/a.md", 0), "ko": (2, "a.md", 1)}
    assert sorted(r.file for r in language.uncertain(found).collect()) == ["b.md", "c.md"]
    assert {r.lang for r in language.detect(df, override="th").collect()} == {"th"}
    with pytest.raises(ValueError):
        language.detect(df, override="xx")


def test_only_the_sample_counts(spark):
    df = spark.createDataFrame([("a.md", "x" * 4000 + "가" * 60)], "file string, content string")
    assert language.detect(df).first().lang == "en"
