"""What is broadcast has a checked size."""

import pytest

from prosewell.llm import decontam, langid


def test_more_languages_than_the_matrix_holds(spark, monkeypatch):
    rows = [("some text of a language", f"l{k % 7}") for k in range(30)] + [("x", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 7)
    assert len(langid.train(docs).languages) == 7
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 6)
    with pytest.raises(ValueError):
        langid.train(docs)


def test_many_items_of_one_text_are_no_broadcast(spark, monkeypatch):
    text = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"zero {text} ten"), (2, "nothing of it here"), (None, text)], "doc_id long, text string")
    items = spark.createDataFrame([(k, text) for k in range(40)], "item_id long, text string")
    small = decontam.build_index(docs, items)
    want = sorted(map(repr, decontam.contamination(docs, items).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WORDS", 20)  # nine words, forty items
    large = decontam.build_index(docs, items)
    assert small.small and not large.small
    assert sorted(map(repr, decontam.contamination(docs, items).collect())) == want
