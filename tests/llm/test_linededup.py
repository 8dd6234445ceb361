"""Line dedup against brute force, and its edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from prosewell.llm import linededup


def levenshtein(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def edited(rnd, line, n):
    out = list(line)
    for _ in range(n):
        k = rnd.randrange(len(out))
        if rnd.random() < 0.4:
            out[k] = rnd.choice("abcdé ")
        elif rnd.random() < 0.5:
            out.insert(k, rnd.choice("abcd😀"))
        elif len(out) > 1:
            del out[k]
    return "".join(out)


def test_banded_distance_equals_the_full_table():
    rnd = random.Random(5)
    for _ in range(3000):
        a = "".join(rnd.choice("abc") for _ in range(rnd.choice([0, 3, 10, 64, 65, 130])))
        b = edited(rnd, a, rnd.randrange(5)) if a else "ab"
        for e in (1, 2, 4):
            assert linededup.within(a, b, e) == min(levenshtein(a, b), e + 1)


def brute(rows, edits=2, min_chars=30):
    """{(doc_id, line number)} to drop."""
    places = {}
    for doc_id, text in rows:
        for k, line in enumerate(text.split("\n") if text is not None else []):
            if len(line) >= min_chars:
                places.setdefault(line, []).append((doc_id, k))
    first = {line: min(p) for line, p in places.items()}
    out = set()
    for line, where in places.items():
        near = any(first[o] < first[line] and levenshtein(line, o) <= edits for o in places if o != line and abs(len(o) - len(line)) <= edits)
        out |= {p for p in set(where) if near or p != first[line]}
    return out


def test_finds_what_brute_force_finds(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcde fé") for _ in range(rnd.randrange(28, 60))) for _ in range(25)]
    rows = []
    for doc_id in range(60):
        lines = [edited(rnd, rnd.choice(base), rnd.randrange(5)) for _ in range(rnd.randrange(1, 6))]
        rows.append((doc_id, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, k) for r in linededup.document_report(docs).collect() for k in r.dropped}
    assert found == brute(rows)
    assert len(found) > 20


def test_near_lines_share_a_deviation_or_are_near_the_pivot():
    rnd = random.Random(11)
    shared = 0
    for _ in range(6000):
        letters = rnd.choice(["ab", "abcd"])
        pivot = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 60)))
        x = edited(rnd, pivot, rnd.randrange(2, 8))
        y = edited(rnd, x, rnd.randrange(1, 3)) if x else "b"
        e = levenshtein(x, y)
        (near, met), (near_y, met_y) = (linededup.deviations(t, pivot, 2) for t in (x, y))
        assert near == (levenshtein(x, pivot) if levenshtein(x, pivot) <= 2 else None) and len(met) <= 13
        if e <= 2 and x != y and None in (near, near_y):
            assert met & met_y
            shared += 1
    assert shared > 1000


@pytest.mark.parametrize(("many", "rounds"), [(0, 1), (8, 6)])
def test_crowded_keys_lose_no_near_copy(spark, monkeypatch, many, rounds):
    """Refined keys and pivots: groups whose lines differ in a number, in a word, or by a few edits."""
    monkeypatch.setattr(linededup, "MANY", many)
    monkeypatch.setattr(linededup, "ROUNDS", rounds)
    rnd = random.Random(many)
    lines = [f"2024-01-01 12:{rnd.randrange(60):02d}:{rnd.randrange(60):02d} INFO the service has started" for _ in range(120)]
    lines += [f"the same sentence with {rnd.choice(['one', 'two', 'three', 'fourteen', 'thirteen', 'some', 'sore'])} other word and {rnd.randrange(5)} more" for _ in range(120)]
    lines += [edited(rnd, "one line of which there are many near copies in the corpus", rnd.randrange(4)) for _ in range(150)]
    rnd.shuffle(lines)
    rows = [(k, line) for k, line in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, k) for r in linededup.document_report(docs).collect() for k in r.dropped}
    assert found == brute(rows)


def test_crowded_groups_lose_no_link(spark):
    """Every link between different lines, not only one to an earlier near copy."""
    rnd = random.Random(4)
    lines = {f"12:{rnd.randrange(60):02d}:{rnd.randrange(60):02d} INFO the service has started" for _ in range(60)}
    lines |= {edited(rnd, "one line of which there are many near copies in the corpus", rnd.randrange(5)) for _ in range(60)}
    lines |= {" ".join(rnd.choice([w, w, w, w + "s", "no"]) for w in "some words of this sentence are exchanged for other ones here".split()) for _ in range(60)}
    lines = sorted(lines, key=lambda x: rnd.random())
    near = {a: [b for b in range(len(lines)) if a != b and levenshtein(lines[a], lines[b]) <= 2] for a in range(len(lines))}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    report = {r.doc_id: (r.n_links, r.class_id) for r in linededup.document_report(docs).collect()}
    assert report == {a: (len(near[a]), min([a, *near[a]])) for a in near}
    assert max(n for n, _ in report.values()) > 5


def test_keys_that_one_line_makes_are_no_rows(spark, monkeypatch):
    """Lines that share a crowded segment and little else: their links need few rows, whatever their number."""
    made = []
    stored = linededup.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "states":
            made.append(out.count())
        return out

    monkeypatch.setattr(linededup, "stored", counted)
    rnd = random.Random(8)
    some = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(n))
    lines = [some(20) + "this part they share" + some(20) for _ in range(300)]
    lines += [line[:k] + "é" + line[k + 1 :] for k, line in enumerate(lines[:5])]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    links = {r.doc_id: r.n_links for r in linededup.document_report(docs).collect()}
    assert links == {k: int(k < 5 or k >= 300) for k in range(305)}
    assert made and sum(made) < 300


def test_equal_lines_of_many_tasks_meet_once(spark, monkeypatch):
    """Two near lines that stand in each of t tasks make no t * t pairs."""
    made = []
    frame = type(spark.range(1))
    distinct = frame.distinct

    def counted(df):
        made.append(df.count())
        return distinct(df)

    monkeypatch.setattr(frame, "distinct", counted)
    text = "a line that stands in each of many tasks, like\na line that stands in each of many tasks, luke"
    docs = spark.range(0, 32, 1, 32).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    report = {r.doc_id: (r.n_exact, r.n_near, r.n_links, r.class_id) for r in linededup.document_report(docs).collect()}
    assert report == {0: (0, 1, 2, 0)} | {k: (2, 0, 2, 0) for k in range(1, 32)}
    assert made and max(made) <= 64  # the places


def test_rests_that_two_near_lines_share_show_their_link():
    rnd = random.Random(12)
    for _ in range(4000):
        pivot = "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 25)))
        x = edited(rnd, pivot, rnd.randrange(5))
        y = edited(rnd, x, rnd.randrange(1, 3)) if x else "b"
        if x == y or levenshtein(x, y) > 2:
            continue
        found = False
        for i, j, e in linededup._states(x, 0, pivot, 0, 2):
            for k, m, f in linededup._states(y, 0, pivot, 0, 2):
                if j != m:
                    continue
                if x[i:] == y[k:]:
                    found |= len(e) + len(f) <= 2 or bool({*e} & {*f})
                elif x[i : i + 1] == y[k : k + 1] and len(e) < 2 and len(f) < 2:
                    found |= levenshtein(x[i:], y[k:]) <= 2 - max(len(e), len(f))
        assert found


def thue_morse(n, flip):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def test_different_lines_of_any_pattern_stay(spark):
    rows = [(2 * k + flip, thue_morse(1024 << k, flip)) for k in range(4) for flip in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(not r.dropped for r in linededup.document_report(docs).collect())
    assert sorted(map(tuple, linededup.deduplicated(docs).collect())) == rows


def test_names_of_the_columns_do_not_matter(spark):
    line = "a line that is long enough to take part in it"
    rows = [(1, line, "a", "b"), (2, line + "\nmore", "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, body string, `dropped` string, `d` string").withColumnsRenamed({"doc_id": "h"})
    kept = linededup.deduplicated(docs, doc_id="h", text="body")
    assert kept.columns == ["h", "body", "dropped", "d"]
    assert sorted(map(tuple, kept.collect())) == [(1, line, "a", "b"), (2, "more", "c", None)]
    with pytest.raises(ValueError):
        linededup.deduplicated(docs, doc_id="dropped", text="body")


def test_edge_cases(spark):
    line = "a line that is long enough to take part in it"
    rows = [(1, None, "x"), (2, "", "x"), (3, line, "x"), (4, f"{line}\nshort\nshort", None), (5, line.replace("long", "lung"), "y"), (3, line, "x"), (None, line, "z"), (6, "w" * 50_000, "z"), (7, "w" * 50_001, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped string")
    report = sorted(linededup.document_report(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_lines, r.dropped) for r in report] == [(1, 0, []), (2, 1, []), (3, 1, [0]), (3, 1, [0]), (4, 3, [0]), (5, 1, [0]), (6, 1, []), (7, 1, [0]), (None, 1, [])]
    kept = linededup.deduplicated(docs)
    assert kept.columns == docs.columns
    # the row without an id sorts first, so it keeps the line
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=lambda r: (r[0] is None, r[0] or 0))[:3] == [(1, None), (2, ""), (4, "short\nshort")]
    assert linededup.document_report(docs.limit(0)).count() == 0


def test_exact_repeats_of_every_length_are_reported(spark):
    line = "a line that is long enough to take part in it"
    rows = [(1, f"{line}\n# Notes\n\n \u3000\n}}"), (2, f"}}\n\n \u3000\n# notes\n# Notes\n{line}\n}}"), (3, "# Notes"), (4, "x"), (None, "x"), (5, "é😀\né😀")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    report = {r.doc_id: (r.n_exact, r.n_near, r.class_id, r.dropped, r.short_repeats) for r in linededup.document_report(docs).collect()}
    assert report == {1: (0, 0, 1, [], []), 2: (4, 0, 1, [5], [0, 4, 6]), 3: (1, 0, 1, [], [0]), 4: (1, 0, 4, [], [0]), None: (0, 0, None, [], []), 5: (1, 0, 5, [], [1])}
    assert {r.doc_id: r.text for r in linededup.deduplicated(docs).collect()}[3] == "# Notes"


@pytest.mark.parametrize("length", [30, 47])
def test_every_pair_within_two_edits_meets(spark, length):
    rnd = random.Random(length)
    line = "".join(rnd.choice("abcdefgh") for _ in range(length))
    variants = {line[:i] + c + line[i + k :] for i in range(length) for k in (0, 1, 2) for c in ("", "z", "zz")} - {line}
    variants = [v for v in variants if len(v) >= 30 and linededup.within(line, v, 2) <= 2]
    docs = spark.createDataFrame([(0, line), *((k + 1, v) for k, v in enumerate(variants))], "doc_id long, text string")
    assert sum(len(r.dropped) for r in linededup.document_report(docs).collect()) == len(variants)


def test_a_segment_that_all_lines_share(spark):
    """More lines than a task keeps of one key: what goes past the ranges gives the same links, from one task or many."""
    rnd = random.Random(11)
    head = "2026-01-01 00:00:00 INFO prefix of every line "
    tails = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(20, 24))) for _ in range(260)]
    near = [t[:5] + rnd.choice("XYZ") + t[6:] for t in tails[:40]]
    lines = [head + t for t in tails] + [head + t for t in near]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    want = {(i, k) for i in range(len(lines)) for k in range(i + 1, len(lines)) if abs(len(lines[i]) - len(lines[k])) <= 2 and linededup.within(lines[i], lines[k], 2) <= 2}
    assert len(want) >= 40
    for n in (1, 7):
        report = linededup.document_report(docs.repartition(n)).collect()
        links = {r.doc_id: r.n_links for r in report}
        assert links == {i: sum(i in pair for pair in want) for i in range(len(lines))}
        assert {r.doc_id for r in report if r.dropped} == {k for _, k in want}


def test_short_repeats_go_where_asked(spark):
    rows = [(1, "# Notes\n}\n\n"), (2, "}\n# notes\n# Notes\n\nown"), (3, "}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, linededup.deduplicated(docs).collect())) == rows
    assert sorted(map(tuple, linededup.deduplicated(docs, short_repeats=True).collect())) == [(1, "# Notes\n}\n\n"), (2, "# notes\n\nown")]


def test_labels_deal_ranges_out_evenly(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    for ranges in (3, 25, 102):
        own, members = linededup._labels(spark, ranges)
        assert len({*own.tolist(), *members.tolist()}) == 2 * ranges
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        for some in (own, members):
            dealt = Counter(r.p for r in spark.createDataFrame([(int(k),) for k in some], "k int").select(F.expr(f"pmod(hash(k), {n})").alias("p")).collect())
            assert max(dealt.values()) <= -(-ranges // n) + 1
