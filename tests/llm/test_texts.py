"""Language ID, URL filters, pieces, PII and secrets."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prosewell.llm import langid, pieces, pii, secrets, urlfilter
from prosewell.llm.common import words_hashed
from prosewell.llm.queries import QUERIES

WORDS = {
    "en": "the of and to in that with for was this are from have which".split(),
    "fr": "le la les des une dans pour avec sur est que qui était à".split(),
    "de": "der die das und ist nicht mit für ein eine auf wird über zu".split(),
}


def sentence(rnd, lang, n=30):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


def test_words_are_those_of_the_pattern():
    rnd = random.Random(4)
    texts = [None, "", " ", "a", "  x\x0by\u00a0z ", "É é", *("".join(rnd.choice("aAbé \n\t\x0c\u3000") for _ in range(rnd.randrange(40))) for _ in range(300))]
    seen: dict[int, str] = {}
    for first, n, hashes in words_hashed(texts, chunk=50):
        at = 0
        for text, count in zip(texts[first : first + len(n)], n, strict=True):
            lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
            want = re.findall(r"[^\x20\x09-\x0D]+", lowered)
            assert count == len(want)
            for h, w in zip(hashes[at : at + count].tolist(), want, strict=True):
                assert seen.setdefault(h, w) == w
            at += count
    assert len(set(seen.values())) == len(seen) > 100


def test_language_of_held_out_texts(spark):
    rnd = random.Random(0)
    rows = [(k, sentence(rnd, lang), lang) for k, lang in enumerate(list(WORDS) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id % 4 <> 0"))
    assert model.languages == ["de", "en", "fr"]
    found = langid.identify(docs.where("doc_id % 4 = 0"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) >= 0.95
    assert all(0 <= r.score <= 1 for r in found)


def brute_bayes(train, text, smoothing=0.5):
    """Naive Bayes from the definition, over the operator's own n-grams of one text at a time."""
    grams = lambda t: [int(b) for _, _, _, bucket in langid._grams([t]) for b in bucket]
    langs = sorted({y for _, y in train})
    scores = []
    for y in langs:
        own = [g for t, z in train if z == y for g in grams(t)]
        logs = {b: np.log(own.count(b) + smoothing) - np.log(len(own) + smoothing * langid.BUCKETS) for b in set(grams(text))}
        scores.append(np.log(sum(z == y for _, z in train) / len(train)) + sum(logs[b] for b in grams(text)))
    p = np.exp(np.array(scores) - max(scores))
    return langs[int(np.argmax(scores))], p.max() / p.sum()


def test_language_equals_the_definition(spark):
    train = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the end", "en")]
    model = langid.train(spark.createDataFrame(train, "text string, lang string"))
    for text in ("the chat", "le", "dog", "Zz"):
        names, score = langid.classify([text], model)
        want = brute_bayes(train, text)
        assert names[0] == want[0] and score[0] == pytest.approx(want[1])


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "en", "x"), (2, "", None, "x"), (3, "12 !", "en", None), (4, "the " * 40_000, "en", "y"), (4, "the " * 40_000, "en", "y"), (5, "la", "fr", "y")], "doc_id long, text string, lang string, score string")
    model = langid.train(docs)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "fr")}
    assert langid.accepted(docs, model).columns == docs.columns and langid.accepted(docs, model).count() == 3
    nothing = langid.train(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, nothing).collect()} == {("und", 0.0)}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_urls(spark):
    model = urlfilter.fit_table(spark.createDataFrame(urlfilter.labelled_urls(), "url string, label int"))
    urls = ["http://A.Net/x", "http://example.net/en/1", "https://m.example.net/en/1?q", "http://x.example.com/de/#a", "http://b.org/fr/", "http://net", "http://blog.casino-win.example.com/en/1", "http://www.ththe.example.com/fr/2", "no url", None, "x://http://y.net/", "http://notnet.orgx/fr/", "http://u.net:80/"]
    pages = spark.createDataFrame([(k, u, "keep") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, model).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block")
    assert got[1] == ("example.net", "/en/1", "example.net/en/", "allow") and got[2] == ("m.example.net", "/en/1", "example.net/en/", "allow")
    assert got[3] == ("x.example.com", "/de/", "example.com/de/", "block") and got[4] == ("b.org", "/fr/", "org/fr/", "allow")
    assert got[5][:3] == ("net", "", None) and got[12][:3] == ("u.net:80", "/", None) and got[11][2] is None
    assert got[6][3] == "block" and got[7][3] == "allow"
    assert got[8][:3] == got[9][:3] == ("", "", None)
    assert got[10][:2] == ("http:", "//y.net/")
    assert urlfilter.judge(pages.limit(0), model).count() == 0


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_SQL = f"""
WITH u AS (SELECT page_id, url, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS t(verdict, h, p)),
fit AS (SELECT page_id, host, path, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST) AS k
        FROM s LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, verdict FROM fit WHERE k = 1
"""


def test_hosts_paths_and_rules_equal_sql(spark):
    import duckdb
    import pyarrow as pa

    rnd = random.Random(8)
    hosts = ["net", "x.net", "example.net", "a.Example.NET", "notnet", "EXAMPLE.com", "b.example.com", "org", "q.org", "orgs.io", "", "x" * 300 + ".net"]
    paths = ["", "/", "/en/", "/en/1", "/EN/1", "/de/x?y=/fr/", "/fr/#z", "/de", "?q", "#f", "/fr/" + "y" * 20_000, "/a\n/de/"]
    urls = [None, "", "no scheme", "://", "a://b://c/d", *(f"{rnd.choice(['http', 'HTTPS', ''])}://{h}{p}" for h in hosts for p in paths)]
    table = pa.table({"page_id": list(range(len(urls))), "url": urls})
    con = duckdb.connect()
    con.register("pages", table)
    want = {r[0]: r[1:] for r in con.execute(URL_SQL).fetchall()}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("__host", F.lit(1)).withColumn("rule", F.lit("x"))
    found = urlfilter.judge(pages, urlfilter.fit_table(spark.createDataFrame(urlfilter.labelled_urls(), "url string, label int")))
    assert found.columns == ["page_id", "url", "__host", "host", "path", "rule", "verdict", "block_score"]
    rows = found.collect()
    assert len(rows) == len(urls) > 100
    for r in rows:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.block_score >= 0.5 else "allow"))


def test_of_rules_of_equal_length_the_first_listed_wins(spark):
    row = spark.range(1).select(*urlfilter.rule_columns(F.lit("a.net"), F.lit("/xy"), [("allow", "a.net", "/x"), ("block", "a.net", "/x")])).first()
    assert tuple(row) == ("a.net/x", "allow")


def test_url_classifier_on_held_out_rows():
    rows = urlfilter.labelled_urls()
    split = lambda u: (u.split("://")[1].partition("/")[0], "/" + u.split("://")[1].partition("/")[2])
    train, test = [r for k, r in enumerate(rows) if k % 4], [r for k, r in enumerate(rows) if k % 4 == 0]
    model = urlfilter.fit([split(u)[0] for u, _ in train], [split(u)[1] for u, _ in train], [y for _, y in train])
    p = model.block_probability([split(u)[0] for u, _ in test], [split(u)[1] for u, _ in test])
    assert np.mean((p >= 0.5) == np.array([y for _, y in test])) >= 0.9
    assert urlfilter.fit([], [], []).bias == 0.0


def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    rnd = random.Random(1)
    texts = [None, "", " ", "   x", "in  the\n\n end\t", "日本語 テスト😀", "x" * 3000, "ababab" * 200, *("".join(rnd.choice("abcde the  \n.,éß😀") for _ in range(rnd.randrange(60))) for _ in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = pieces.read_model()
    back = pieces.decode(pieces.encode(docs, model), model)
    for r in back.collect():
        assert r.ids == (None if r.text is None else library.encode(r.text))
        assert r.decoded == r.text
    assert pieces.round_trip(docs, model).where("round_trip").count() == len(texts)
    assert pieces.encode(docs.limit(0), model).count() == 0


def test_the_mark_itself_does_not_come_back(spark):
    docs = spark.createDataFrame([("a▁b", "x")], "text string, ids string")
    row = pieces.round_trip(docs.drop("ids"), pieces.read_model()).first()
    assert not row.round_trip and row.ids
    assert pieces.encode(docs, pieces.read_model()).columns == ["text", "ids"]


@pytest.mark.parametrize("encode", [pieces.encode, pieces.round_trip])
def test_words_are_remembered_for_one_task_only(spark, encode):
    """The workers go on with tasks of other operators; what they remember of words would stay in their memory."""

    def remembered(batches):
        for _ in batches:
            held = list(pieces._LOADED.values())
            n = sum(len(x) for m in held for x in (m.cache, m.older, m.lost, m.compatible))
            yield pa.RecordBatch.from_arrays([pa.array([len(held)]), pa.array([n])], ["models", "remembered"])

    docs = spark.range(2000).repartition(4).selectExpr("concat('words of a text ', id, ' and more', id * 7) AS text")
    assert encode(docs, pieces.read_model()).where("size(ids) > 3").count() == 2000
    found = spark.range(8, numPartitions=8).mapInArrow(remembered, "models long, remembered long").collect()
    assert any(r.models for r in found)
    assert all(r.remembered == 0 for r in found)


def test_the_round_trip_is_that_of_whole_texts():
    """Checked word by word, over several generations of remembered words, against decoding each text."""
    m = pieces.PieceModel(pieces.read_model())
    rnd = random.Random(3)
    for _ in range(60):
        texts = [None, "", "▁", "a▁ b", *("".join(rnd.choice("ab \n▁éß😀\t") for _ in range(rnd.randrange(40))) for _ in range(20))]
        found, same = m.encode(texts)
        assert same == [t is None or m.decode(np.frombuffer(x, np.int32).tolist()) == t for t, x in zip(texts, found, strict=True)]


def test_unigram_walk_finds_the_best_split(tmp_path):
    from itertools import product

    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("▁", -3, 1), ("▁a", -2, 1), ("a", -3, 1), ("b", -3.5, 1), ("ab", -4, 1), ("ba", -2.5, 1), ("▁ab", -6, 1)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    m = pieces.PieceModel(proto.SerializeToString())

    def best(word):
        if not word:
            return 0.0
        return max(m.score[i] + best(word[len(p) :]) for p, i in m.ids.items() if word.startswith(p))

    words = ["▁" + "".join(x) for n in range(1, 6) for x in product("ab", repeat=n)]
    for word, ids in m.encode_words(words).items():
        found = np.frombuffer(ids, np.int32)
        assert "".join(m.text[i] for i in found) == word
        assert sum(m.score[i] for i in found) == pytest.approx(best(word))


def test_runs_of_unknown_characters_are_one_piece():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3, 1), ("a", -3, 1), ("▁a", -2, 1), ("b", -3.5, 1)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    proto.normalizer_spec.escape_whitespaces = True
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    m = pieces.PieceModel(proto.SerializeToString())
    texts = ["azzza", "zz a zz", "z", "z z", "xyab zzb  yy", "b", "za\nz", "", "zzz"]
    for text, ids, same in zip(texts, *m.encode(texts), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == library.encode(text), text
        assert same == (m.decode(library.encode(text)) == text) == (not set(text) - set("ab "))
    proto.pieces.add(piece="<user>", score=0, type=4)
    with pytest.raises(ValueError):
        pieces.PieceModel(proto.SerializeToString())


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rnd = random.Random(7)
    for letters in ("ab@.-", "012.5 ", "0123456789 -", "+1 ().-23", "a@1.b +2-()5 9"):
        for _ in range(3000):
            text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(45)))
            assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("x 4111 1111 1111 1111 y") == [(2, 2, 21)]


def test_em_finds_the_reliable_labelers():
    rnd = random.Random(3)
    patterns = {}
    for _ in range(4000):
        truth = rnd.random() < 0.5
        v = tuple((1 if truth else -1) if rnd.random() < right else (-1 if truth else 1) for right in (0.95, 0.9, 0.9, 0.55, 0.8))
        patterns[0, v] = patterns.get((0, v), 0) + 1
    post, theta = pii.expectation_maximisation(patterns)
    model = pii.fit_classifier({(*k, (0, 0, 0, 0)): n for k, n in patterns.items()}, post, theta)
    assert model.reliability["form"] > model.reliability["plain"] > model.reliability["context"]
    assert model.probability(0, (1,) * 5, (0, 0, 0, 0)) > 0.9 > 0.1 > model.probability(0, (-1,) * 5, (0, 0, 0, 0))


def test_the_classifier_learns_shapes_that_the_votes_leave_open():
    """Spans of equal votes: those shaped like the ones that the labelers agree on are likelier."""
    sure, unsure, against = (1, 1, 1, 1, 1), (1, 0, 0, 0, 0), (-1, -1, -1, -1, -1)
    good, bad = (2, 3, 1, 1), (0, 1, 2, 3)
    patterns = {(3, sure, good): 500, (3, against, bad): 500, (3, unsure, good): 5, (3, unsure, bad): 5}
    votes = {}
    for (k, v, _), n in patterns.items():
        votes[k, v] = votes.get((k, v), 0) + n
    model = pii.fit_classifier(patterns, *pii.expectation_maximisation(votes))
    odds = [p / (1 - p) for p in (model.probability(3, unsure, x) for x in (good, bad))]
    assert odds[0] > 5 * odds[1]


def test_overlaps_are_those_of_a_scan():
    rnd = random.Random(5)
    for _ in range(300):
        spans = sorted((s, 0, s + rnd.randrange(1, 9)) for s in (rnd.randrange(40) for _ in range(rnd.randrange(6))))
        taken, added, kept = pii._Taken(spans), pii._Taken(), []
        for _ in range(8):
            s = rnd.randrange(45)
            e = s + rnd.randrange(1, 6)
            assert taken.free(s, e) == (not any(a < e and s < b for a, _, b in spans))
            free = not any(a < e and s < b for a, b in kept)
            assert added.free(s, e) == free
            if free:
                added.add(s, e)
                kept.append((s, e))


def test_base_digests_equal_the_patterns_on_the_query(spark, tmp_path):
    """The registered query against the patterns as they are written down, and the spans that the model adds."""
    rnd = random.Random(2)
    pieces_ = ["a.b@c.de", "10.0.0.1", "999.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+49 (30) 123-4567", "+1 2", "tel (743) 555-3824", "ann (at) mail (dot) com", "é😀", "1" * 30]
    texts = [None, "", *(" ".join(rnd.choice(pieces_) for _ in range(rnd.randrange(1, 9))) for _ in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op10_pii"](spark, str(tmp_path)).collect():
        base = [(pii.KINDS[k], s, e) for s, k, e in plain_spans(texts[r.doc_id] or "")]
        digest = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        every = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        spans = [(k, int(s), int(e)) for k, s, e in every]
        assert len(spans) == r.n_spans and set(base) <= set(spans) and spans == sorted(spans, key=lambda x: (x[1], pii.KINDS.index(x[0])))
        added = sorted(x for x in spans if x not in base)
        assert all(not (a[1] < b[2] and b[1] < a[2]) for a in added for b in spans if a != b)


def test_added_spans_and_edge_cases(spark):
    texts = [None, "", "mail a.b@c.de now", "call me tel (743) 555-3824 today", "write ann (at) mail (dot) com", "😀 ip 10.1.2.3", "order 4111 1111 1111 1112", "1" * 5000, "a" * 20000 + "@b.co"]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, pii string").repartition(2)
    model = pii.train(docs)
    got = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.pii] for r in pii.find(docs, model).collect()}
    for k, text in enumerate(texts):
        base = [(pii.KINDS[kind], s, e) for s, kind, e in plain_spans(text or "")] if k != 7 else []
        assert [x[:3] for x in got[k] if x[3]] == base
        want, every = pii.all_spans(text or "", model)
        assert [(pii.KINDS[kind], s, e) for s, kind, e in every] == [x[:3] for x in got[k]] and set(want) <= set(every)
    assert got[5] == [("ip", 5, 13, True)]
    assert pii.find(docs.limit(0), pii.train(docs.limit(0))).count() == 0


def test_forest_removes_false_positives(spark):
    """On held-out findings; a secret that is no candidate, or whose span is wrong, counts as an error."""
    rows = secrets.labelled_findings(spark).withColumn("k", F.abs(F.hash("candidate")) % 4).cache()
    trees = secrets.train_forest(rows.where("k <> 0"))
    assert len(trees) == secrets.TREES
    held = rows.where("k = 0").toPandas()
    docs = spark.createDataFrame([(k, r.before + r.candidate + r.after, r.path) for k, r in enumerate(held.itertuples())], "doc_id long, text string, source string")
    said = {}
    for r in secrets.scan(docs, trees).where("is_secret").collect():
        said.setdefault(r.doc_id, set()).add((r.start, r.end))
    right = [said.get(k, set()) == ({(len(r.before), len(r.before) + len(r.candidate))} if r.label else set()) for k, r in enumerate(held.itertuples())]
    assert len(right) > 150 and np.mean(right) >= 0.9


def test_compiled_trees_say_what_the_learner_says(spark):
    forest, data = secrets._fitted(secrets.labelled_findings(spark))
    for tree in forest.trees:
        rows = tree.transform(data).select("prediction", F.expr(secrets._compiled(tree.toDebugString)).alias("own")).collect()
        assert len(rows) > 500 and all(r.prediction == r.own for r in rows)


def test_assigned_values_are_cut_at_the_assignment(spark):
    cases = {
        "secret=04dbebab91ab85687d33eeaaf9ac699e1188f962 x": ["04dbebab91ab85687d33eeaaf9ac699e1188f962"],
        "a password = 'P@ss.w0rd!x' b": ["P@ss.w0rd!x"],
        'x "token": "abcdefgh", y': ["abcdefgh"],
        "API-KEY:hunter22 and password:abc": ["hunter22"],
        "path=/usr/lib/python3.11/site-packages": ["/usr/lib/python3", "11/site-packages"],
        "QUJDREVGR0hJSktMTU5PUA== x=0123456789abcdef=y": ["QUJDREVGR0hJSktMTU5PUA==", "0123456789abcdef="],
        "QUJDREVGR0hJSktMTU5PUDE== z": ["QUJDREVGR0hJSktMTU5PUDE=="],
        "the passwords are secret: yes": [],
    }
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(cases)], "doc_id long, text string, source string")
    got = {k: [] for k in range(len(cases))}
    for r in secrets.candidates(docs).select("kept.doc_id", "candidate", "start").orderBy("start").collect():
        got[r.doc_id].append(r.candidate)
    assert list(got.values()) == list(cases.values())


def test_names_of_kept_columns_do_not_matter(spark):
    docs = spark.createDataFrame([(1, "x 04dbebab91ab85687d33eeaaf9ac699e", "src", 2, 3, "k")], "doc_id long, text string, path string, start int, score int, kept string")
    found = secrets.scan(docs, [], path="path", keep=("doc_id", "path", "start", "score", "kept"))
    assert found.columns == ["doc_id", "path", "kept", "start", "end", "candidate", "score", "is_secret"]
    assert [tuple(r)[:5] for r in found.collect()] == [(1, "src", "k", 2, 34)]


def test_candidates_equal_python(spark):
    texts = [None, "", "😀 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" x abcdefghijklmnop1", "é" + "a1" * 30_000 + " b", "aaaaaaaaaaaaaaaaaaaa 1234567890123456"]
    docs = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)] + [(4, texts[4], None)], "doc_id long, text string, source string")
    rows = secrets.candidates(docs).select("kept.doc_id", "candidate", "start", "end").collect()
    want = [(k, m.start(), m.end()) for k, t in [*enumerate(texts), (4, texts[4])] for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}", t or "") if re.search("[0-9]", m.group())]
    # Spark counts code points too: the emoji is one character
    assert sorted((r.doc_id, r.start, r.end) for r in rows) == sorted(want)
    assert all(r.candidate == (texts[r.doc_id])[r.start : r.end] for r in rows)
    accepted = secrets.scan(docs, [])
    assert accepted.where("is_secret").count() == len(want) and secrets.scan(docs.limit(0), []).count() == 0


FOLD_SQL = """
WITH w AS (SELECT doc_id, crc % 4 = 2 AS held_out, crc % 5 = 1 AS held_lm, list_append(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+'), NULL) AS t FROM folds),
tok AS (SELECT doc_id, held_lm, coalesce('w' || x, 'end') AS x FROM (SELECT doc_id, held_lm, unnest(t) AS x FROM w)),
c AS (SELECT x, count(*) AS c FROM tok WHERE NOT held_lm GROUP BY x), s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_lm) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, CAST(any_value(s.n) AS BIGINT) AS train_tokens, sum(log10((coalesce(c.c, 0) + 0.5) / (s.n + 0.5 * (s.v + 1)))) AS base_score
FROM tok LEFT JOIN c USING (x), s GROUP BY doc_id
"""


def test_folds_and_base_scores_equal_sql(spark, tmp_path):
    """op2's fold and ``und``, and op4's columns of the contract, on the registered queries."""
    import zlib

    import duckdb
    import pyarrow as pa

    rnd = random.Random(4)
    texts = [None, "", " ", "½ ² ٣ 12", "Ünd É", *(sentence(rnd, rnd.choice(["en", "fr", "de"]), rnd.randrange(30)).title() for _ in range(80))]
    rows = [(k, t, rnd.choice(["en", "fr", None])) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.register("folds", pa.table({"doc_id": [r[0] for r in rows], "text": pa.array(texts, pa.string()), "crc": [zlib.crc32(str(r[0]).encode()) for r in rows]}))
    want = {r[0]: r[1:] for r in con.execute(FOLD_SQL.format(upper=UPPER, lower=LOWER)).fetchall()}
    got = QUERIES["op4_lm_score"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, pytest.approx(r.base_score)) == want[r.doc_id]
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    for r in QUERIES["op2_language_id"](spark, str(tmp_path)).collect():
        text = texts[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text)) and 0 <= r.score <= 1


def plain_grams(text):
    """Buckets of the 1- to 3-grams that hold a letter, one by one."""
    code = [32 if ord(c) < 128 and not "a" <= c <= "z" else ord(c) for c in f" {text.lower()} "]
    for n in (1, 2, 3):
        for i in range(len(code) - n + 1):
            if any(c != 32 for c in code[i : i + n]):
                h = 0x811C9DC5 + n
                for c in code[i : i + n]:
                    h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
                    h ^= h >> 13
                yield (h * 0x85EBCA6B & 0xFFFFFFFF) >> 16


def test_language_posteriors_equal_the_formula(spark):
    import math
    from collections import Counter

    rnd = random.Random(12)
    train = [(sentence(rnd, lang, 12), lang) for lang in ("en", "fr", "de") for _ in range(rnd.randrange(2, 6))] + [(None, "en"), ("x", None)]
    model = langid.train(spark.createDataFrame(train, "text string, lang string").repartition(2))
    counts, docs = {}, Counter(lang for _, lang in train if lang)
    for text, lang in train:
        if lang:
            counts.setdefault(lang, Counter()).update(plain_grams(text or ""))
    texts = [*(sentence(rnd, lang, 3) for lang in ("en", "fr", "de") for _ in range(8)), "Ünd É 5", "à", None, "½"]
    names, scores = langid.classify(texts, model)
    for text, name, score in zip(texts, names, scores, strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0)
            continue
        log = {}
        for lang, c in counts.items():
            total = sum(c.values()) + 0.5 * langid.BUCKETS
            log[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((c[g] + 0.5) / total) for g in plain_grams(text))
        top = max(log.values())
        assert log[name] == pytest.approx(top) and score == pytest.approx(1 / sum(math.exp(x - top) for x in log.values()))
