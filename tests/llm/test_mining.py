"""Hard negatives, toxicity and the filter audit against brute force, on nulls, ties, repeats and odd columns."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosewell.llm import filteraudit, hardnegatives, toxicity

SF = "/root/testdata/sf0.1"

# -- hard negatives ----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, row string, block int, q string, score double"


def mined_brute_force(rows, is_anchor):
    usable = []
    for vec_id, v, label, *_ in rows:
        if vec_id is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    sizes = Counter(len(q) for _, _, q in usable)
    common = min(sizes, key=lambda d: (-sizes[d], d), default=0)
    usable = [r for r in usable if len(r[2]) == common]
    out = []
    for a, (anchor, label, q) in enumerate(usable):
        if not is_anchor(anchor):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, z, strict=True)), i, lab == label) for b, (i, lab, z) in enumerate(usable) if b != a)
        for s, positive, _ in [x for x in scored if x[2]][:5]:
            window = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(anchor, positive, k, i, -s, -n) for k, (n, i, _) in enumerate(window, 1)]
    return sorted(out)


def vectors(n, d, labels, seed, shared=0.0):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        v = [rng.choice([-0.5, 0.0, 0.25, 0.5, 0.75, 1.0]) if rng.random() < 0.6 else rng.gauss(0.3, 0.4) for _ in range(d)]
        out.append((k if rng.random() > shared else rng.randint(0, n), v, rng.randint(0, labels - 1), "x", 1, "y", 0.5))
    return out


@pytest.mark.parametrize(("n", "d", "labels", "anchor_block", "row_block"), [(150, 7, 3, 256, 8192), (150, 70, 4, 3, 16), (90, 5, 40, 2, 10), (60, 3, 1, 4, 9)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, n, d, labels, anchor_block, row_block):
    monkeypatch.setattr(hardnegatives, "ANCHOR_BLOCK", anchor_block)
    monkeypatch.setattr(hardnegatives, "ROW_BLOCK", row_block)
    rows = vectors(n, d, labels, n + d)
    odd = [None, [], [None] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] * d, [1.0] * (d + 1), [0.0] * d]
    rows += [(7 * 1000 + k, v, 0, "x", 1, "y", 0.5) for k, v in enumerate(odd)] + [(None, [1.0] * d, 0, "x", 1, "y", 0.5), (9000, [1.0] * d, None, "x", 1, "y", 0.5)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hardnegatives.mine(df, "id % 7 = 0").collect())
    assert got == mined_brute_force(rows, lambda i: i % 7 == 0) and (len(got) > 20 or labels == 1)


def test_hard_negatives_with_repeated_ids_and_ties(spark):
    rows = [(k % 40, [float(k % 3), 1.0], k % 2, "x", 1, "y", 0.5) for k in range(120)]
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hardnegatives.mine(spark.createDataFrame(rows, VECTORS), "id % 10 = 0").collect())
    assert got == mined_brute_force(rows, lambda i: i % 10 == 0) and got


def test_hard_negatives_of_nothing_and_of_too_much(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hardnegatives.mine(empty, "true").collect() == []
    assert hardnegatives.mine(spark.createDataFrame([(0, [1.0], 0, "", 0, "", 0.0)], VECTORS), "true").collect() == []
    with pytest.raises(ValueError):
        hardnegatives.mine(spark.createDataFrame([(0, [1e30], 0, "", 0, "", 0.0)], VECTORS), "true")


def test_partial_tiles_survive_their_bytes():
    tile = np.array([[0, -1, 1, 2**62, -(2**62)], [255, -256, 65536, -1, 7]], np.int64)
    assert (hardnegatives._tile(hardnegatives._planes(tile)).reshape(tile.shape) == tile).all()
    s = np.array([3, 9, 9, 1, 9, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 5])
    assert hardnegatives.first_of(s, 5).tolist() == [1, 2, 4, 21, 0]


@pytest.mark.parametrize("exact", [True, False])
def test_the_chunks_of_a_cell_agree_on_the_order_of_rows(exact):
    """A shuffle over several executors hands a cell's rows over in another order for each chunk of dimensions."""
    import pandas as pd

    rng = np.random.default_rng(3)
    a, b = rng.integers(-300, 300, (6, 64)), rng.integers(-300, 300, (9, 64))

    def side(q, first, chunk, **more):
        rows = pd.DataFrame({"ab": 0, "rb": 0, "chunk": chunk, "row": range(first, first + len(q)), "label": 1, "q": list(q[:, 32 * chunk : 32 * chunk + 32]), **{k: list(v) for k, v in more.items()}})
        return rows.sample(frac=1, random_state=chunk + first)

    partial = pd.concat([hardnegatives._multiplier(exact)(side(a, 100, c, positives=[[]] * 6), side(b, 200, c, id=range(200, 209))) for c in (0, 1)])
    got = hardnegatives._reducer(3, False)(partial)
    want = [(100 + n, 200 + int(k), int(s[k])) for n, s in enumerate(a @ b.T) for k in np.argsort(-s, kind="stable")[:3]]
    assert [tuple(map(int, r)) for r in got[["anchor_row", "id", "score"]].to_numpy()] == want


def test_hard_negatives_of_long_integers(spark):
    """Products beyond 2**53, where doubles are no longer exact."""
    rng = random.Random(9)
    rows = [(k, [rng.uniform(1e5, 4e5) for _ in range(6)], k % 2, "x", 1, "y", 0.5) for k in range(40)]
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hardnegatives.mine(spark.createDataFrame(rows, VECTORS), "id % 5 = 0").collect())
    assert got == mined_brute_force(rows, lambda i: i % 5 == 0) and got and got[0][4] > 2**53


# -- toxicity ----------------------------------------------------------------------------------------


def grams_brute_force(word):
    marked, out = f"<{word}>", []
    for n in toxicity.ORDERS:
        for k in range(len(marked) - n + 1):
            h = 0x811C9DC5 + n
            for c in marked[k : k + n]:
                h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
                h ^= h >> 13
            out.append((h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - toxicity.BITS))
    return out


def score_brute_force(text, values, offset):
    words = [w for w in (t.strip(toxicity.STRIPPED) for t in (text or "").lower().split()) if w]
    z = sum(np.mean([values[g] for g in grams_brute_force(w)]) for w in words) / len(words) if words else 0.0
    return 1 / (1 + math.exp(-(z + offset)))


def test_scores_equal_the_definition(spark, monkeypatch):
    rng = np.random.default_rng(1)
    values, offset = rng.normal(size=1 << toxicity.BITS) * 5, -0.3
    pick = random.Random(2)
    texts = [None, "", " \n", "...", "a", "É!", "Ünï-cødé 語語語語語語 \U0001f600", "idiot, (idiot) IDIOT"] + [" ".join("".join(pick.choice("abcé語.,'") for _ in range(pick.randint(1, 9))) for _ in range(pick.randint(1, 60))) for _ in range(60)]
    for size in (toxicity._SLICE, 20):  # long words in slices, too
        monkeypatch.setattr(toxicity, "_SLICE", size)
        scorer = toxicity.Scorer(values, offset)
        got = scorer.score([*texts, *texts])
        assert np.allclose(got, [score_brute_force(t, values, offset) for t in texts] * 2, rtol=1e-9)


def test_a_long_unbroken_text_is_scored_whole():
    values = np.random.default_rng(3).normal(size=1 << toxicity.BITS)
    text = "".join(chr(0x4E00 + k * 7 % 5000) for k in range(700_000))
    got = toxicity.Scorer(values, 0.0).score([text])[0]
    owner, bucket = toxicity.subwords([text])
    assert abs(got - 1 / (1 + math.exp(-values[bucket].mean()))) < 1e-9


def test_unseen_misspellings_share_their_vectors():
    rng = random.Random(4)
    plain = ["".join(rng.choice("aeioutnrslm") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["idiotic", "worthless", "disgusting"]
    texts, labels = [], []
    for k in range(800):
        words = [rng.choice(plain) for _ in range(30)]
        if k % 4 == 0:
            words[::10] = [rng.choice(bad) for _ in words[::10]]
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    model = toxicity.fit(texts, labels)
    scorer = toxicity.Scorer(model.values, model.offset)
    clean = [" ".join(rng.choice(plain) for _ in range(30)) for _ in range(50)]
    with_ = lambda w: [" ".join([w, w, w, *t.split()[3:]]) for t in clean]
    fine = scorer.score(clean)
    assert max(fine) < 0.5
    for misspelt in ("idiotik", "worthles", "disgustingg", "dissgusting"):
        found = scorer.score(with_(misspelt))
        assert np.mean(found[:, None] > fine[None, :]) > 0.95 and np.mean(found > fine) > 0.95, misspelt


DOCS = "doc_id long, text string, lang string, score double, predicted string"


def test_toxicity_defined_cases(spark):
    rows = [(k, ("vile scum here " if k % 3 == 0 else "quite fine words ") * 5 + str(k), "en", 0.1, "p") for k in range(90)] + [(None, "vile scum", None, None, None), (500, None, "x", 0.2, "q"), (7, "quite fine words", "en", 0.1, "p")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] + [(None, 1), (1, None), (2, 5), (3, 0), (888, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "predicted", "score"] and got.count() == len(rows)
    by_text = {r.text: r.score for r in got.collect()}
    assert all((by_text[r[1]] >= 0.5) == (r[1] is not None and "scum" in r[1]) for r in rows)
    assert by_text[None] == pytest.approx(1 / (1 + math.exp(-model.offset)))
    assert toxicity.score(docs.limit(0), model, keep=["doc_id"]).collect() == []
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.5}
    again = {r.text: r.score for r in toxicity.score(docs.repartition(7), toxicity.train(docs.repartition(5), labels.repartition(3))).collect()}
    assert again == pytest.approx(by_text, abs=1e-6)


def test_the_sample_of_the_fit_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_ROWS", 5)
    monkeypatch.setattr(toxicity, "FIT_BYTES", 20)
    docs = spark.createDataFrame([(k, "x" * (k % 9), "", 0.0, "") for k in range(200)] + [(3, "x" * 50, "", 0.0, "")] * 30, DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    sample, totals = toxicity.labelled(docs, labels)
    rows = sample.collect()
    assert totals == {0: 100, 1: 100} and all(0 < len([r for r in rows if r.y == y]) <= 5 and sum(len(r.text) for r in rows if r.y == y) <= 20 for y in (0, 1))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_toxicity_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(docs, labels.where(~held))
    rows = toxicity.score(docs.join(labels.where(held), "doc_id"), model, keep=["doc_id", "toxic"]).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    bad, good = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    auc = np.mean([(x > y) + 0.5 * (x == y) for x in bad for y in good])
    # about 3,200 labelled rows; over 16,000 (check_s) it is 0.99
    assert auc > 0.9 and np.mean([x >= 0.5 for x in good]) < 0.06 and np.mean([x >= 0.5 for x in bad]) > 0.55


# -- filter audit ------------------------------------------------------------------------------------


def mask_brute_force(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text).split(" ") if w]
    upper = sum("A" <= c <= "Z" for c in text)
    return (len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words)) + 4 * (100 * upper > 10 * len(text)) + 8 * any(c in "#$%&*|" for c in text)


def audit_brute_force(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out, shapley = defaultdict(Counter), Counter()
    parts = {lang or "" for _, _, lang in rows}
    for i, text, lang in rows:
        mask = mask_brute_force(text or "") + 16 * (i is not None and i > first[text or ""])
        fails = "".join(f for k, f in enumerate("ABCDE") if mask >> k & 1)
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                row = out[lang or "", "".join(order), step]
                here = f in fails and not gone
                row["redundant"] += f in fails and gone
                gone |= here
                row["kept"] += not gone
                row["removed"] += here
                row["unique_fails"] += fails == f
                row["good_lost"] += here and i is not None and i in good
                row["toxic_lost"] += here and i is not None and i in toxic
                shapley[lang or "", f] += here
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {(p, "".join(o), s): (*(out[p, "".join(o), s][n] for n in names), shapley[p, o[s - 1]]) for p in parts for o in permutations("ABCDE") for s in range(1, 6)}


AUDITED = "doc_id long, text string, lang string, part string, mask int, n string"


@pytest.mark.parametrize("chain_bytes", [32_000_000, 300])
def test_filter_audit_equals_brute_force(spark, monkeypatch, chain_bytes):
    monkeypatch.setattr(filteraudit, "CHAIN_BYTES", chain_bytes)
    rng = random.Random(8)
    texts = [None, "", " ", "A b", "ÄÖ x", "B" * 30, "a # b", " ".join(f"w{k}" for k in range(100)), " ".join(f"w{k % 79}" for k in range(100)), " ".join(f"W{k % 80}" for k in range(100)), "tab\tnew\nline\x0bx\x0cy\rz\x1cq"]
    rows = [(rng.choice([None, 1, 2, 3, *range(4, 200)]), rng.choice(texts), rng.choice(["en", "de", None, ""]), "p", 3, "n") for _ in range(300)]
    rows += [(k, "one text of many", "en", "p", 3, "n") for k in range(500)]
    labels = [(k, k % 2, k % 3 % 2) for k in range(150)] + [(None, 1, 1), (4, None, None), (5, 0, 1), (5, 1, 0)]
    docs = spark.createDataFrame(rows, AUDITED).repartition(6)
    found = filteraudit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    want = audit_brute_force([r[:3] for r in rows], labels)
    assert len(found) == len(got) == len(want) and got == want


def test_equal_hashes_of_different_texts_stay_apart(spark, monkeypatch):
    chains = filteraudit.Chains()
    out = []
    for doc_id, text in ((5, b"x"), (3, b"y"), (4, b"x"), (2, b"y"), (3, b"y"), (4, b"x")):
        out += chains.meet(1, text, None, doc_id, {"en": 1})
    assert sorted((i, m & 16) for i, _, m, _ in out) == [(3, 16), (3, 16), (5, 16)]
    assert sorted((e[0], e[2], e[3]) for _, e in chains.entries()) == [(b"x", 4, {"en": 2}), (b"y", 2, {"en": 1})]


def test_filter_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(spark.createDataFrame([], AUDITED), labels).collect() == []
    one = filteraudit.audit(spark.createDataFrame([(1, None, None, "", 0, "")], AUDITED), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""}
