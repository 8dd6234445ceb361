"""Benchmark decontamination: a positional inverted index over the training texts.

Three native steps, no Python on the executors:

1. frequencies of the test terms over all training texts (explode, join, count);
2. the postings (document, term, position and the words around it) of each window's two rarest terms,
   stored in the shared folder;
3. offset-adjusted intersection: a posting of an item's word at item position p gives the alignment
   (document, item, position - p); a window is a phrase match where both of its rarest terms give the
   same alignment and the words around agree, and a proximity match where their alignments differ by
   ``slop`` at most.

Only test-side tables are broadcast, behind a count of the items and their words (``BROADCAST_WORDS``); beyond it
the same joins shuffle, and the words around a posting are fetched afterwards by document, so that no row of a
shuffle by term holds more than its term and place. A window with a term that no text holds is dropped at once.

Defined cases: a null text has no words and no hits; an item without words has no window and matches
nothing; an item of fewer words than the window is one window. Equal frequencies go to the earlier
position. Items with the same text match together, each under its own id; repeated rows of the same id
and text give that row's result each time. Texts of any length are used whole. Empty tables give no rows
(no documents) or no hits (no items). Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewell.llm.common import stored

WINDOW = 8
BROADCAST_WORDS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, LOWER), NOT_A_WORD), ""), F.array().cast("array<string>"))


@dataclass
class Index:
    """first: postings of each window's rarest term, with the words around it; second: those of the next rarest.

    items: item number, words, window length and windows (start, rare: the two word positions);
    ids: the item ids of each number.
    """

    first: DataFrame
    second: DataFrame
    items: DataFrame
    ids: DataFrame
    window: int
    small: bool


def _maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _terms(items: DataFrame, role: int) -> DataFrame:
    """term, item, at: the places of the rarest (0) or next rarest (1) word of every window."""
    rare = items.select("item", "words", F.explode("windows").alias("w")).select("item", "words", F.get("w.rare", F.lit(role)).alias("at")).where("at is not null")
    return rare.select(F.element_at("words", F.col("at") + 1).alias("term"), "item", "at").distinct()


def build_index(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> Index:
    """Postings of the two rarest terms of every window of ``items`` (item_id, text) in ``docs`` (doc_id, text)."""
    named = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    texts = stored(named.select("words").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    ids = named.join(texts, "words").select("item_id", "item")
    total = texts.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    small = max(total, named.count()) <= BROADCAST_WORDS  # many items can have one text
    terms = texts.select(F.explode("words").alias("term")).distinct()
    tokens = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    frequency = tokens.select(F.explode("words").alias("term")).join(_maybe_broadcast(terms, small), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    frequency = stored(frequency, "term-frequency")

    # each item word with its frequency; each window with the positions of its two rarest words
    placed = texts.select("item", F.posexplode("words").alias("at", "term")).join(_maybe_broadcast(frequency, small), "term", "left")
    placed = placed.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("at", "term", F.coalesce("n", F.lit(0)).alias("n")))).alias("placed"))
    placed = placed.withColumn("length", F.least(F.lit(window), F.size("placed")))

    def rare(s):
        by_frequency = F.array_sort(F.transform(F.slice("placed", s + 1, F.col("length")), lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"))))
        return F.struct(s.alias("start"), by_frequency[0]["n"].alias("n"), F.transform(F.slice(by_frequency, 1, 2), lambda x: x["at"]).alias("rare"))

    windows = F.filter(F.transform(F.sequence(F.lit(0), F.size("placed") - F.col("length")), rare), lambda w: w["n"] > 0)
    placed = placed.withColumn("windows", windows).where(F.size("windows") > 0)
    placed = stored(placed.select("item", F.transform("placed", lambda x: x["term"]).alias("words"), "length", "windows"), "item-windows")

    roles = _terms(placed, 0).select("term", F.lit(True).alias("is_first")).distinct().join(_terms(placed, 1).select("term", F.lit(True).alias("is_second")).distinct(), "term", "full")
    lead = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    around = F.when(F.col("is_first"), F.slice("words", lead + 1, F.col("pos") - lead + window))
    if small:
        spread = tokens.select("doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "term")).join(F.broadcast(roles), "term")
    else:
        places = stored(tokens.select("doc_id", "text_hash", F.posexplode("words").alias("pos", "term")).join(roles, "term"), "places")
        whole = tokens.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "words").dropDuplicates(["d", "h"])
        # equal rows: the places of each stand in ``places``, so one of their texts is enough
        spread = places.join(whole, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")))
    postings = stored(spread.select("term", "doc_id", "text_hash", "pos", (F.col("pos") - lead).alias("before"), around.alias("around"), F.coalesce("is_second", F.lit(False)).alias("is_second")), "postings")
    first = postings.where("around is not null").select("term", "doc_id", "text_hash", "pos", "before", "around")
    return Index(first, postings.where("is_second").select("term", "doc_id", "text_hash", "pos"), placed, ids, window, small)


def _aligned(postings: DataFrame, index: Index, role: int) -> DataFrame:
    """Postings with item, at and shift (document position minus item position)."""
    return postings.join(_maybe_broadcast(_terms(index.items, role), index.small), "term").withColumn("shift", F.col("pos") - F.col("at"))


def _same_place(*columns: str) -> Column:
    """Lists a and b agree in the columns and in doc_id, where null is an id like others."""
    return F.expr(" AND ".join(["a.doc_id <=> b.doc_id", *(f"a.{c} = b.{c}" for c in columns)]))


def phrase_matches(index: Index) -> DataFrame:
    """doc_id, text_hash, item_id, start (word position in the document), length: every occurrence of a window."""
    pairs = index.items.select("item", "words", "length", F.explode("windows").alias("w"))
    pairs = pairs.select("item", F.col("w.start").alias("from"), "length", F.get("w.rare", F.lit(0)).alias("at"), F.get("w.rare", F.lit(1)).alias("at2"), F.slice("words", F.col("w.start") + 1, F.col("length")).alias("phrase"))
    one = _aligned(index.first, index, 0).select("doc_id", "text_hash", "item", "shift", "at", "before", "around")
    wanted = one.join(_maybe_broadcast(pairs.select("item", "at", "at2").distinct(), index.small), ["item", "at"])
    # adjusted lists meet: the next rarest word stands in the same alignment (a window of one word has none)
    two = _aligned(index.second, index, 1).select("doc_id", "text_hash", "item", "shift", F.col("at").alias("at2"))
    met = wanted.where("at2 is not null").alias("a").join(two.alias("b"), _same_place("text_hash", "item", "shift", "at2"), "left_semi").unionByName(wanted.where("at2 is null"), allowMissingColumns=True)
    # the words around the first agree with the whole window
    lead = F.col("at") - F.col("from")
    same = (lead <= F.col("before")) & (F.slice("around", F.greatest(F.col("before") - lead, F.lit(0)) + 1, F.col("length")) == F.col("phrase"))
    hits = met.join(_maybe_broadcast(pairs.withColumnRenamed("at2", "next"), index.small), ["item", "at"]).where(F.col("at2").eqNullSafe(F.col("next")) & same)
    hits = hits.select("doc_id", "text_hash", "item", (F.col("shift") + F.col("from")).alias("start"), "length")
    return hits.join(_maybe_broadcast(index.ids, index.small), "item").select("doc_id", "text_hash", "item_id", "start", "length")


def proximity_matches(index: Index, slop: int) -> DataFrame:
    """doc_id, text_hash, item_id, item_start, shift, other_shift: windows whose two rarest words lie within ``slop`` words of their places.

    The two lists meet by document, item and shift bucket, so a repeated word is not paired with all of its repeats.
    """
    wins = index.items.select("item", F.explode("windows").alias("w")).select("item", F.col("w.start").alias("item_start"), F.get("w.rare", F.lit(0)).alias("at"), F.get("w.rare", F.lit(1)).alias("at2")).where("at2 is not null")
    wide = slop + 1
    one = _aligned(index.first, index, 0).select("doc_id", "text_hash", "item", "at", "shift").join(_maybe_broadcast(wins, index.small), ["item", "at"])
    one = one.withColumn("bucket", F.explode(F.array(*(F.floor(F.col("shift") / wide) + k for k in (-1, 0, 1)))))
    two = _aligned(index.second, index, 1).select("doc_id", "text_hash", "item", F.col("at").alias("at2"), F.col("shift").alias("other_shift"), F.floor(F.col("shift") / wide).alias("bucket"))
    near = one.alias("a").join(two.alias("b"), _same_place("text_hash", "item", "at2", "bucket")).where(F.abs(F.col("shift") - F.col("other_shift")) <= slop)
    near = near.select("a.doc_id", "a.text_hash", "a.item", "item_start", "shift", "other_shift")
    return near.join(_maybe_broadcast(index.ids, index.small), "item").select("doc_id", "text_hash", "item_id", "item_start", "shift", "other_shift")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per row of ``docs``: doc_id, text_hash, n_words, n_hit and item_ids (sorted, as strings)."""
    matches = stored(phrase_matches(build_index(docs, items, window)), "phrase-matches")
    key = ["doc_id", "text_hash"]
    ends = F.sequence("start", F.col("start") + F.col("length") - 1)
    hit = matches.select(*key, "start", "length").distinct().select(*key, F.explode(ends).alias("pos")).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    ids = matches.groupBy(*key).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    found = hit.join(ids, [hit.doc_id.eqNullSafe(ids.doc_id), hit.text_hash == ids.text_hash]).select(hit.doc_id.alias("d"), hit.text_hash.alias("h"), "n_hit", "item_ids")
    every = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = every.join(found, every.doc_id.eqNullSafe(found.d) & (every.text_hash == found.h), "left")
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_items: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that hold windows of ``min_items`` items or more; columns stay as they are."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    matches = phrase_matches(build_index(base, items, window)).select("doc_id", "text_hash", "item_id").distinct()
    bad = stored(matches.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_items).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")), "contaminated")
    keyed = docs.withColumn("__hash", F.xxhash64(F.col(text).cast("string")))
    return keyed.join(bad, (keyed["__hash"] == bad["__h"]) & keyed[doc_id].eqNullSafe(bad["__d"]), "left_anti").drop("__hash")
