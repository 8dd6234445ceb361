"""Decontamination, language model, nearest neighbours, near duplicates and the pipeline, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from pyspark.sql import functions as F

from prosewell.llm import ann, decontam, jaccard, lm
from prosewell.llm.components import components


def words3(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, items, window=8):
    out = {}
    for k, text in docs:
        w, hit, ids = words3(text), set(), set()
        for item, phrase in items:
            p = words3(phrase)
            n = min(window, len(p))
            for s in range(len(p) - n + 1) if n else ():
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == p[s : s + n]:
                        hit.update(range(i, i + n))
                        ids.add(str(item))
        out[k] = (len(w), len(hit), sorted(ids))
    return out


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = ["the", "of", "a", "and", *(f"w{k}" for k in range(40)), "é", "Ünd"]
    say = lambda n: " ".join(rnd.choice(vocabulary[:4] if rnd.random() < 0.5 else vocabulary) for _ in range(n))
    items = [(k, say(rnd.choice([1, 3, 8, 9, 20]))) for k in range(12)] + [(99, None), (98, "!?"), (97, "the of the of the of the of the of")]
    docs = []
    for k in range(40):
        parts = [say(rnd.randrange(12))]
        if k % 2:
            w = (rnd.choice(items[:12])[1] or "").split()
            parts.append(", ".join(w[rnd.randrange(2) :]))
        docs.append((k, " ".join([*parts, say(3)])))
    docs += [(50, None), (51, ""), (52, "the of " * 3000), (53, items[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontam.contamination(df, bench).collect()}
    want = brute_hits(docs, items)
    assert got == want and sum(bool(x[2]) for x in want.values()) > 10
    bad = {k for k, x in want.items() if x[2]}
    extra = df.selectExpr("*", "1 AS item_id", "'x' AS n_hit")
    kept = decontam.clean(extra, bench)
    assert kept.columns == extra.columns and {r.doc_id for r in kept.collect()} == {k for k, _ in docs} - bad
    assert decontam.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contamination(df.limit(0), bench).count() == 0


def test_repeated_rows_and_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "alpha beta x gamma delta epsilon zeta eta theta"), (3, "alpha zeta")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "alpha beta gamma delta epsilon zeta eta theta"), ("r", "alpha beta gamma delta epsilon zeta eta theta")], "item_id string, text string")
    rows = decontam.contamination(docs, bench).collect()
    assert sorted((r.doc_id, r.n_hit, tuple(r.item_ids)) for r in rows) == [(1, 8, ("q", "r"))] * 2 + [(2, 0, ()), (3, 0, ())]


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_proximity_equals_brute_force(spark, slop):
    rnd = random.Random(slop)
    say = lambda n: " ".join(rnd.choice([f"w{k}" for k in range(25)]) for _ in range(n))
    items = [(k, say(rnd.choice([2, 8, 10]))) for k in range(6)]
    docs = [(k, say(12)) for k in range(25)]
    for k, (_, phrase) in enumerate(items):  # with words put in or taken out
        w = phrase.split()
        at = rnd.randrange(1, len(w))
        docs += [(100 + k, " ".join(["w1", *w])), (200 + k, " ".join([*w[:at], "x", *w[at:]])), (300 + k, " ".join([*w[:at], "x", "y", "z", *w[at:]])), (400 + k, " ".join(reversed(w)))]
    docs += [(None, items[0][1]), (500, None)]
    counts = Counter(w for _, t in docs for w in words3(t))
    want = set()
    for item, phrase in items:
        p = phrase.split()
        n = min(8, len(p))
        for start in range(len(p) - n + 1):
            if any(not counts[w] for w in p[start : start + n]):
                continue
            a, b = sorted(range(start, start + n), key=lambda i: (counts[p[i]], i))[:2]
            for doc, text in docs:
                w = words3(text)
                want |= {(doc, item, start, i - a, j - b) for i in range(len(w)) for j in range(len(w)) if w[i] == p[a] and w[j] == p[b] and abs((i - a) - (j - b)) <= slop}
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = [(r.doc_id, r.item_id, r.item_start, r.shift, r.other_shift) for r in decontam.proximity_matches(index, slop).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 10


def test_without_broadcasts_the_result_is_the_same(spark, monkeypatch):
    rnd = random.Random(9)
    say = lambda n: " ".join(rnd.choice([f"w{k}" for k in range(30)]) for _ in range(n))
    items = [(k, say(9)) for k in range(8)]
    docs = [(k % 25, f"{say(5)} {items[k % 8][1] if k % 3 else ''} {say(4)}") for k in range(30)] + [(None, items[0][1]), (None, items[0][1]), (40, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    run = lambda: sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontam.contamination(df, bench).collect())
    small = run()
    monkeypatch.setattr(decontam, "BROADCAST_WORDS", 0)
    assert run() == small and sum(x[2] > 0 for x in small) > 10


def test_rows_without_an_id_are_decontaminated(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(None, f"so {passage} end"), (None, "alpha zeta"), (1, passage), (2, "theta")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", passage)], "item_id string, text string")
    rows = decontam.contamination(docs, bench).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in rows} == {(None, 10, 8, ("q",)), (None, 2, 0, ()), (1, 8, 8, ("q",)), (2, 1, 0, ())} and len(rows) == 4
    assert sorted(r.text for r in decontam.clean(docs, bench).collect()) == ["alpha zeta", "theta"]
    assert {r.doc_id for r in decontam.proximity_matches(decontam.build_index(docs, bench), 0).collect()} == {None, 1}


class Plain:
    """Interpolated modified Kneser-Ney, from the definition."""

    def __init__(self, texts, order):
        self.order = order
        self.uni, counts = Counter(), Counter()
        for t in texts:
            w = [*lm_words(t), "</s>"]
            self.uni.update(w)
            w = ["<s>"] * (order - 1) + w
            counts.update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.counts = {order: counts}
        for n in range(order - 1, 0, -1):
            lower = Counter()
            for gram, c in self.counts[n + 1].items():
                lower[gram[1:]] += c if n > 1 and gram[1] == "<s>" else 1
            self.counts[n] = lower
        self.d = {n: (0, *lm._discounts(np.array([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]))) for n, x in self.counts.items()}
        self.after = defaultdict(list)
        for x in self.counts.values():
            for gram, c in x.items():
                self.after[gram[:-1]].append(c)

    def p(self, context, w):
        n = len(context) + 1
        lower = self.p(context[1:], w) if n > 1 else 1 / (self.v + 1)
        seen = self.after.get(context)
        if not seen:
            return lower
        d, total, c = self.d[n], sum(seen), self.counts[n][(*context, w)]
        return max(c - d[min(c, 3)], 0) / total + sum(d[min(x, 3)] for x in seen) / total * lower


def lm_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_model_equals_the_definition(spark, order):
    rnd = random.Random(6)
    say = lambda: " ".join(rnd.choice("a b c d e f the The of é".split()) for _ in range(rnd.randrange(12)))
    train = [*(say() for _ in range(60)), None, "", "a a a a", *["c d e a b c d"] * 3]
    test = [*(say() for _ in range(20)), "zz a zz", None, "", "a " * 5000, "c d e a b c d", "c d e a b c d"]
    model = lm.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(3), order=order)
    plain = Plain(train, order)
    assert (model.n_tokens, model.n_types, model.n_pairs) == (plain.n, plain.v, sum(plain.counts[1].values()))
    rows = lm.score(spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(test)], "k int, text string, perplexity string, shard string"), model).orderBy("k").collect()
    for text, r in zip(test, rows, strict=True):
        w = [*lm_words(text), "</s>"]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.shard) == (len(w), sum(plain.uni[x] > 0 for x in w), plain.n, "y")
        assert r.base_score == pytest.approx(sum(math.log10((plain.uni[x] + 0.5) / (plain.n + 0.5 * (plain.v + 1))) for x in w))
        padded = ["<s>"] * (order - 1) + w
        assert r.score == pytest.approx(sum(math.log10(plain.p(tuple(padded[i : i + order - 1]), x)) for i, x in enumerate(w)))
        assert r.perplexity == pytest.approx(10 ** (-r.score / len(w)))
    # probabilities after any context, an unknown word included, add up to one
    for context in (("<s>",) * (order - 1), ("a",) * (order - 1), ("zz",) * (order - 1), ("c", "d", "e")[: order - 1]):
        assert sum(plain.p(context, w) for w in [*plain.uni, "unknown word"]) == pytest.approx(1)


def thue_morse(n, flip):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def test_different_words_of_any_pattern_are_different(spark):
    a, b = ([thue_morse(1024 << k, flip) for k in range(4)] for flip in (0, 1))
    model = lm.train(spark.createDataFrame([(" ".join(a),)], "text string"))
    rows = lm.score(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "k int, text string"), model).orderBy("k").collect()
    assert [r.n_known for r in rows] == [5, 1] and model.n_types == 5
    texts = [" ".join([*x, x[0]]) for x in (a, b)]
    found = jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.component_id for r in found] == [0, 1]


def test_counts_of_any_size_and_many_shards(spark):
    """Counts beyond 32 bits are packed and stored whole; a reader closes what it has not used."""
    columns, counts = np.array([[1, 2, 70000], [3, 1 << 40, 5]], np.uint64), np.array([1, 1 << 40, 3])
    got = lm._unpacked(lm._packed(columns, counts))
    assert (got[0] == columns).all() and (got[1] == counts).all()
    uri = lm.fresh_path(spark, "numbers")
    lm._write_numbers(f"{uri}/n/0", counts)
    lm._write_numbers(f"{uri}/n/1", np.array([7]))
    reader = lm._Reader(lm.KneserNey(uri, 2, 2))
    assert reader.array("n", 0).tolist() == counts.tolist() and reader.array("n", 1).tolist() == [7] and not len(reader.array("n", 2))


def test_untrained_model(spark):
    docs = spark.createDataFrame([("a b", "x")], "text string, score string")
    model = lm.train(docs.limit(0).select("text"))
    row = lm.score(docs, model).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 32))
    x = (centres[rng.integers(0, 8, 1500)] + rng.normal(size=(1500, 32))).astype(np.float32)
    x[7] = x[40]
    df = vectors(spark, [(k, v.tolist(), None) for k, v in enumerate(x)])
    got = defaultdict(list)
    for r in ann.search(df, "id % 20 = 0", radius=26, rotations=2).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    full = x.astype(np.float64) @ x.astype(np.float64).T
    recall = []
    for q in range(0, 1500, 20):
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 21))
        assert all(s == pytest.approx(full[q, v]) for _, v, s in rows)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        best = sorted((v for v in range(1500) if v != q), key=lambda v: (-full[q, v], v))[:20]
        recall.append(len(set(best) & {v for _, v, _ in rows}) / 20)
    assert np.mean(recall) >= 0.9


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    codes[100:200] = codes[5] ^ (1 << rng.integers(0, 16, (100, 4))).astype(np.uint16)
    index = ann.BlockIndex(codes)
    for radius in (0, 3, 4, 9, 20, 40, 64):
        for q in (5, 150, 2999):
            want = np.flatnonzero(ann._POP[codes ^ codes[q]].sum(axis=1, dtype=int) <= radius)
            assert index.within(codes[q], radius).tolist() == want.tolist()


def test_neighbours_edge_cases(spark):
    rows = [(0, [1.0, 0.0], "a"), (20, [0.0, 1.0], "a"), (1, [1.0, 1.0], "a"), (2, [1.0, 1.0], "a"), (3, None, "a"), (4, [0.0, 0.0], "a"), (5, [float("nan"), 1.0], "a"), (6, [float("inf"), 1.0], "a"), (7, [None, 1.0], "a"), (8, [], "a"), (9, [1.0, 2.0, 3.0], "a"), (None, [1.0, 1.0], "a"), (2, [1.0, 1.0], "a")]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(vectors(spark, rows), "id % 20 = 0").collect())
    # the second row of the id 2 is a candidate of its own
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 2), (0, 4, 20), (20, 1, 1), (20, 2, 2), (20, 3, 2), (20, 4, 0)]
    twice = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(vectors(spark, [(0, [1.0, 0.0], "a"), (0, [0.0, 1.0], "a"), (5, [1.0, 2.0], "a")]), "id % 20 = 0").collect())
    assert twice == [(0, 1, 5, 1.0), (0, 1, 5, 2.0), (0, 2, 0, 0.0), (0, 2, 0, 0.0)]
    assert ann.search(vectors(spark, rows).limit(0), "id % 20 = 0").count() == 0


def sets_of(text):
    w = lm_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(docs):
    sets = [(k, sets_of(t)) for k, t in docs]
    root = {k: k for k, _ in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                r, s = sorted((find(a), find(b)))
                root[s] = r
    return {k: (len(s), find(k)) for k, s in sets}


def near_copies(rnd, n_groups=12, copies=14):
    docs = []
    for _ in range(n_groups):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([4, 6, 30, 60, 120]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                text[rnd.randrange(len(text))] = f"x{rnd.randrange(60)}"
            if rnd.random() < 0.3:
                text += ["tail"] * rnd.randrange(8)
            docs.append(" ".join(text))
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    docs = near_copies(random.Random(seed)) + [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, "z " * 20_000), (905, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    want = brute_components(docs)
    assert got == want and len({c for _, c in want.values()}) < len(docs) - 30


def test_signatures_are_exact_and_bound_true_pairs(spark):
    import pandas as pd

    fields = "set long, n long, slack long, " + ", ".join(f"{c} long" for c in jaccard.SIGNATURE)
    rows, sets = [], {}
    for block, idle in ((0, 0), (1, 3)):  # without and with documents that share no token
        rng = np.random.default_rng(4)
        owned = {}
        for pair in range(40):
            both = np.unique(rng.integers(0, 1 << 48, 300).astype(np.uint64))
            own = np.unique(rng.integers(0, 1 << 48, 98).astype(np.uint64))
            owned[2 * pair], owned[2 * pair + 1] = np.sort(np.concatenate([both, own[:49]])), np.sort(np.concatenate([both, own[49:]]))
        n = [len(t) for t in owned.values()] + [7] * idle
        ids = [1000 * block + k for k in range(len(n))]
        key, owner = np.concatenate(list(owned.values())), np.repeat(np.arange(len(owned)), [len(t) for t in owned.values()])
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order].astype(np.uint32)
        key, at, count = np.unique(key, return_index=True, return_counts=True)
        kept = {"owners": owner[np.repeat(count > 1, count)].tobytes(), "several": count[count > 1].astype(np.uint32).tobytes()}
        asked = {"keys": jaccard.pack_sorted(key), "owners": jaccard._planes(np.where(count > 1, jaccard.SEVERAL, owner[at])), "df": jaccard._planes(np.full(len(key), 2))}
        pdf = pd.DataFrame([{"block": block, "keys": None, **kept, "df": None, "ids": ids, "sizes": n, "sets": ids}, {"block": block, **asked, "several": None, "ids": None, "sizes": None, "sets": None}])
        out = jaccard._documents(75)(pdf)
        for r in out[out["one"].notna()].to_dict("records"):
            tokens = owned[r["set"] % 1000]
            parity = np.bincount((tokens % np.uint64(1024)).astype(np.int64), minlength=1024) & 1
            assert [r[c] for c in jaccard.SIGNATURE] == np.packbits(parity.astype(np.uint8)).view(np.int64).tolist()
            rows.append((int(r["set"]), int(r["n"]), int(r["slack"]), *(int(r[c]) for c in jaccard.SIGNATURE)))
            sets[r["set"]] = set(tokens.tolist())
    df = spark.createDataFrame(rows, fields)
    near = {(r.u, r.v) for r in df.alias("a").join(df.alias("b"), jaccard._near(75)).selectExpr("a.set AS u", "b.set AS v").collect()}
    true = {(a, b) for a, x in sets.items() for b, y in sets.items() if 100 * len(x & y) >= 75 * len(x | y)}
    assert true <= near and len(true) == 4 * len(sets) and len(near) < len(sets) ** 2


def test_one_of_each(spark):
    rows = [(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y"), (7, None, "z"), (None, "q r s", "z"), (8, "other words here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, [(1, "a b c d e f"), (7, None), (None, "q r s"), (8, "other words here")]))
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    say = lambda n: " ".join(rnd.choice("the of and to in that with for was this".split()) + str(rnd.randrange(90)) for _ in range(n))
    passage, line = say(12), "this line stands in several documents, word for word, as lines do"
    rows = [(k, say(40), "en", f"s{k}", 1) for k in range(8)]
    rows += [(10, rows[0][1] + " end", "en", "s", 1), (11, f"{line}\n{say(30)}", "en", "s", 1), (12, f"{line}\n{say(30)}", None, "s", 1), (13, f"{say(20)} {passage} {say(20)}", "en", "s", 1), (14, "12 34 !!", "en", "s", 1), (15, None, "en", "s", None), (2, rows[2][1], "en", "s2", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append({r.doc_id for r in docs.collect()})
    every = {r[0] for r in rows}
    assert seen[0] == every - {14, 15}
    assert 12 in seen[1] and spark.read.parquet(f"{tmp_path}/out1").where("doc_id = 12").first().text == rows[10][1].split("\n")[1]
    # the copy of document 2 and the near copy of document 0 go, in the line stage or the next
    assert seen[2] == every - {14, 15, 10}
    assert seen[3] == seen[2] - {13} == seen[4]
    assert docs.where("not round_trip").count() == 0 and docs.count() == len(seen[4])
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_every_stage_takes_nulls_and_any_columns(spark, tmp_path):
    """Each stage on rows with nulls in every column, an empty and a long text, repeated rows and columns named as the operators' own."""
    import corpus_pipeline

    long = " ".join(f"the{k % 977} of and to in that with for was this from have which are" for k in range(4000))
    rows = [(1, "the of and to in that with for was this are", "en", None, None), (None, "the of and in this are that which from have", None, "s", 2), (3, None, "en", "s", 1), (4, "", None, None, 0), (5, long, "en", "s", 9), (1, "the of and to in that with for was this are", "en", None, None), (6, "the of and to in that with for was that", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clashes = ["item", "n_hit", "text_hash", "dropped", "set", "n_shingles", "component_id", "score", "key", "words", "id", "first"]
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in clashes}).repartition(3)
    spark.createDataFrame([(None, "a passage of nothing"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"language": [1, 1, 5, 6, None], "lines": [1, 1, 3, 4, 5, 6, None], "near_duplicates": [1, 3, 4, 5, 6, None], "benchmark": [1, 1, 3, 4, 5, 6, None], "encode": [1, 1, 3, 4, 5, 6, None]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "encode" or out.columns == docs.columns
        assert sorted((r.doc_id for r in out.collect()), key=lambda k: (k is None, k or 0)) == want[name], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_intermediate_tables_are_forgotten(spark):
    from prosewell.llm import common

    common.forget(spark)
    path = common.stored(spark.range(3), "three").inputFiles()[0]
    assert common.forget(spark) == 1 and common.forget(spark) == 0
    assert not Path(path.removeprefix("file://")).exists()


def test_partitioning_changes_nothing(spark):
    """Near copies in one block or in many: the same components, lines and scores."""
    from prosewell.llm import linededup

    rnd = random.Random(21)
    say = lambda n: " ".join(f"w{rnd.randrange(400)}" for _ in range(n))
    base = [[say(12) for _ in range(5)] for _ in range(6)]
    rows = []
    for k in range(90):
        lines = list(rnd.choice(base))
        if k % 3:
            at = rnd.randrange(5)
            w = lines[at].split()
            w[rnd.randrange(12)] = f"v{k}"
            lines[at] = " ".join(w)
        rows.append((k, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for n in (1, 3, 17):
        own = docs.repartition(n)
        components_ = sorted(map(tuple, jaccard.join(own).select("doc_id", "n_shingles", "component_id").collect()))
        kept = sorted(map(tuple, linededup.deduplicated(own).collect()))
        scores = sorted((r.doc_id, round(r.score, 9)) for r in lm.score(own, lm.train(own)).collect())
        found.append((components_, kept, scores))
    assert found[0] == found[1] == found[2]
    assert len({c for _, _, c in found[0][0]}) < 30 and len(found[0][1]) < 90
