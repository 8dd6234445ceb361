"""The queries of the llm operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewell.llm import ann, decontam, filteraudit, hardnegatives, jaccard, langid, linededup, lm, pieces, pii, secrets, toxicity, urlfilter

QUERIES, ORACLES = {}, {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(modulus: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


@_query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every whole text, with the forest's verdict."""
    return secrets.scan(_table(spark, sf_dir, "documents"), secrets.train_forest(secrets.labelled_findings(spark)))


@_query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold windows of benchmark items."""
    found = decontam.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_items = F.size("item_ids").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


ORACLES["op3_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i + 1:i + least(8, len(w))], ' ') AS phrase
       FROM (SELECT item_id, w, unnest(range(0, len(w) - least(8, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS phrase
       FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, phrase)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the rows outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~_fold(4, 2)).select("text", "lang"))
    found = langid.identify(docs.select("doc_id", _fold(4, 2).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@_query
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every whole text under the model of the rows outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", _fold(5, 1).alias("held_out"), "text")
    return lm.score(docs, lm.train(docs.where("not held_out"))).drop("text")


@_query
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector, among all vectors."""
    return ann.search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "id % 20 = 0")


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's repeated lines, exact and within two edits of an earlier one."""
    return linededup.document_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets reach a Jaccard similarity of 0.75."""
    return jaccard.join(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


ORACLES["op7_ngram_jaccard"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
          JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS root, doc_id AS node FROM d UNION SELECT root, b FROM reach JOIN links ON a = node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node) r USING (doc_id)
"""


@_query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: the longest rule that fits, else the classifier."""
    model = urlfilter.fit_table(spark.createDataFrame(urlfilter.labelled_urls(), "url string, label int"))
    found = urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), model)
    return found.select("page_id", "host", "path", "rule", "verdict", "block_score")


@_query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    found = pieces.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.read_model())
    return found.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip")


def _digest(spans):
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


@_query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added personal-data spans of every whole text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    base = F.filter("pii", lambda s: s["base"])
    counts = [F.size(F.filter(base, _is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five hard negatives of each positive of every hundredth vector, with a part of the labels changed."""
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hardnegatives.mine(vectors.select("vec_id", "embedding", label.alias("label")), "id % 100 = 0")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLES["op11_hard_negatives"] = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@_query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from the labels outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~_fold(5, 0)))
    found = toxicity.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", _fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, by language."""
    return filteraudit.audit(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
        regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, a, b, c, d, e, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM f p, f q, f r, f s, f t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
z AS (SELECT *, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM c),
r AS (SELECT z.part, k.filter_order, k.step, k.f, z.n, z.good, z.toxic, contains(fails, k.f) AS failed, len(list_filter(string_split(fails, ''), lambda x: x <> '' AND contains(k.earlier, x))) > 0 AS gone, fails = k.f AS alone FROM z, k),
g AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (failed AND gone), 0) AS redundant,
        coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(good) FILTER (failed AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (failed AND NOT gone), 0) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g
"""
