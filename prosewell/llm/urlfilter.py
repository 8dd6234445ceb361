"""URL filters: host/path rules first, then logistic regression on hashed character n-grams.

The regression is fitted on the driver from a small labelled URL table (at most ``MAX_LABELLED``
rows are used, a documented bound for the classifier's fit only, taken in the order of a hash); its weight vector, of a fixed size,
is broadcast and urls are scored in Arrow batches, without a shuffle.

Defined cases: a null url, or one without ``://``, has an empty host and an empty path, so no rule
fits and the classifier sees no n-gram: its verdict is that of the bias alone. Repeated rows are judged
alike; urls of any length are judged whole; an empty table gives no rows. Other columns are untouched, but for
those with the names of the new ones, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 14
MAX_LABELLED = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Production rules: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words from which the small labelled table is made by rule.
BAD_WORDS = ("casino", "casino-win", "poker", "slots", "free-bets", "betting", "jackpot", "adult", "adult-x", "xxx", "porn", "escort", "spam-farm", "linkfarm", "cheap-pills", "viagra", "payday-loans", "warez", "torrent-hub", "click-bait")
GOOD_WORDS = ("news", "docs", "library", "museum", "university", "school", "research", "weather", "recipes", "garden", "history", "science", "travel", "music", "health", "sports", "city-hall", "journal", "forum", "wiki")


#: Surroundings of the words: (url before, url after); no word tells the label by these.
_AROUND = (("https://", ".com/"), ("http://www.", ".info/index.php"), ("https://the-", "-site.co.uk/a/b?id=7"), ("http://", "24.biz/start/"), ("https://shop.", ".io"), ("https://blog.", ".net/2021/05/post-1"), ("http://10.0.0.7/", "/page/3.html"), ("https://cdn.media.eu/x/", ".jpg"), ("https://m.", ".example.org/en/12"), ("http://my", ".page/u/~k"))


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table (url, 1 for block): each word as part of a host or a path, in many surroundings; and hosts of pronounceable nonsense."""
    out = []
    for words, label in ((BAD_WORDS, 1), (GOOD_WORDS, 0)):
        out += [(f"{before}{w}{after}", label) for w in words for before, after in _AROUND]
    heads = ("b", "br", "c", "d", "f", "gr", "h", "k", "l", "m", "n", "p", "r", "s", "st", "t", "th", "v", "w", "wh")
    tails = ("a", "ai", "an", "ar", "e", "ea", "en", "er", "i", "in", "ing", "ion", "le", "o", "on", "ou", "re", "ty", "u", "y")
    for k in range(300):  # everyday hosts: two or three syllables, in the same surroundings
        n = 2 + k % 2
        name = "".join(heads[(k * 7 + j * 11) % 20] + tails[(k * 13 + j * 3 + k // 20) % 20] for j in range(n))
        before, after = _AROUND[k % len(_AROUND)]
        out.append((f"{before}{name}{after}", 0))
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (host and its subdomains, path prefix), else null.

    Equal lengths go to the rule that is listed first.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # what comes later wins
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p).otherwise(name)
        verdict = F.when(fits, what).otherwise(verdict)
    return name, verdict


def _features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of the 3- to 5-grams of each host and of each path; the two are hashed apart."""
    owners, buckets = [], []
    for salt, values in ((17, hosts), (91, paths)):
        code = np.frombuffer("".join(f"^{v}$" for v in values).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(values)), [len(v) + 2 for v in values])
        digit = (code >= 48) & (code <= 57)
        code = np.where(digit, 48, code).astype(np.uint32)
        for n in (3, 4, 5):
            m = len(code) - n + 1
            if m <= 0:
                continue
            h = np.full(m, salt * 1000003 + n, np.uint32)
            for k in range(n):
                h = (h ^ code[k : k + m]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            keep = owner[:m] == owner[n - 1 :]
            owners.append(owner[:m][keep])
            buckets.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))[keep])
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def block_probability(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        owner, bucket = _features(hosts, paths)
        n = np.maximum(np.bincount(owner, minlength=len(hosts)), 1)
        z = np.bincount(owner, weights=self.weights[bucket], minlength=len(hosts)) / np.sqrt(n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(hosts: list[str], paths: list[str], labels: list[int], penalty: float = 1e-3, steps: int = 400) -> UrlModel:
    """Logistic regression by accelerated gradient steps; each row's n-gram counts are scaled by 1/sqrt(their number)."""
    hosts, paths, y = hosts[:MAX_LABELLED], paths[:MAX_LABELLED], np.array(labels[:MAX_LABELLED], float)
    w, bias = np.zeros(1 << BITS), 0.0
    if not len(y):
        return UrlModel(w, bias)
    owner, bucket = _features(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(y)), 1))
    value = scale[owner]
    v, c, was_w, was_b = w, bias, w, bias
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights=v[bucket] * value, minlength=len(y)) + c, -40, 40)))
        r = (p - y) / len(y)
        w = v - 8.0 * (np.bincount(bucket, weights=r[owner] * value, minlength=1 << BITS) + penalty * v / 8)
        bias = c - 2.0 * r.sum()
        m = k / (k + 3)
        v, c, was_w, was_b = w + m * (w - was_w), bias + m * (bias - was_b), w, bias
    return UrlModel(w, float(bias))


def fit_table(table: DataFrame, url: str = "url", label: str = "label") -> UrlModel:
    """The model of a small labelled table (null urls and labels do not train)."""
    host, path = split_url(F.col(url))
    rows = table.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(host.alias("h"), path.alias("p"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("h", "p", "y"), "h", "p", "y").limit(MAX_LABELLED).collect()
    return fit([r.h for r in rows], [r.p for r in rows], [r.y for r in rows])


def judge(pages: DataFrame, model: UrlModel, rules=RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict and block_score; columns of those names are replaced."""
    new = ("host", "path", "rule", "verdict", "block_score")
    host, path = split_url(F.col(url))
    name, by_rule = rule_columns(host, path, rules)
    kept = [c for c in pages.columns if c not in new]
    # read by place below, so that no name of theirs can meet one of ours
    base = pages.select(*(F.col(f"`{c}`") for c in kept), host.alias("host"), path.alias("path"), name.alias("rule"), by_rule.alias("verdict"))
    sent, at = pages.sparkSession.sparkContext.broadcast(model), len(kept)

    def run(batches):
        for b in batches:
            p = sent.value.block_probability(b.column(at).to_pylist(), b.column(at + 1).to_pylist())
            verdict = [r or ("block" if x >= threshold else "allow") for r, x in zip(b.column(at + 3).to_pylist(), p, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: at + 3], pa.array(verdict, pa.string()), pa.array(p)], [*kept, *new])

    schema = T.StructType([*(base.schema[c] for c in kept), *(T.StructField(c, T.StringType()) for c in new[:4]), T.StructField(new[4], T.DoubleType())])
    return base.mapInArrow(run, schema)
