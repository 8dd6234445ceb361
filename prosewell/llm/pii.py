"""PII spans by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Four base patterns (email, ip, card, phone) give spans that always stay. Wider candidate patterns
(spelled-out emails, IPv6, national phone numbers, cards with unusual separators) propose further spans.
Labelers (strict form, checksum and plausibility, gazetteers, context words before and after) vote
for, against or abstain on every candidate and base span of the whole corpus. Only the counts of distinct
patterns - kind, votes and the shape of the span (its length, share of digits, separators and longest run of
digits, in a few classes each) - reach the driver; their number is bounded by the labelers and classes, not by
the corpus. Expectation-maximisation on the votes estimates every labeler's reliability, its posteriors train
a logistic span classifier on votes and shape together, and a second pass over the texts adds the candidates
that the classifier accepts and no base span overlaps.

Defined cases: a null text counts as empty and has no spans; a corpus without candidates adds nothing
(the classifier then keeps its prior); repeated rows give the same spans; offsets are code points, end
exclusive; spans are ordered by start, then by kind as listed. Texts are processed whole. Other columns
pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosewell.llm.common import modest_batches, slices

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "check", "gazetteer", "context", "plain")
#: Patterns of the base spans. A start inside a run that just failed can't match either, so the
#: lookbehind only saves the retries.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Wider candidates.
_SPELLED = re.compile(r" ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]{2,63}){1,4}", re.I)
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_WIDE_CARD = re.compile(r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9])")
_WIDE_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)[\x20.-]?|00[0-9]{1,3}[\x20.-]|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
#: Gazetteers and context words.
_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info co us ca".split())
_DIALS = ("1", "33", "34", "44", "49", "7", "39", "41", "43", "52", "54", "61", "81", "82", "86", "91")
_FOR = {
    "email": frozenset("email mail e-mail contact write an correo courriel adresse address".split()),
    "ip": frozenset("ip address addr host server from client adresse".split()),
    "card": frozenset("card visa mastercard credit carte karte tarjeta payment account".split()),
    "phone": frozenset("phone tel tel. telephone call mobile fax telefon téléphone teléfono cell whatsapp".split()),
}
_AGAINST = frozenset("version ver v release isbn order sku part figure fig page section price total token id doi issue no nr build chapter".split())


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c)
        total += n if k % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    """Leftmost non-overlapping emails: each @ with what stands before it, from the last match on."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
            at = text.find("@", floor)
        else:
            # the next start lies behind this @
            floor = max(floor, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, in order."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidate_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the wider patterns."""
    out = []
    if "at" in text or "AT" in text or "At" in text:
        for m in _SPELLED.finditer(text):
            start = m.start()
            while start > 0 and text[start - 1] in _LOCAL and m.start() - start < 64:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in _IP6.finditer(text)] if ":" in text else []
    out += [(m.start(), 2, m.end()) for m in _WIDE_CARD.finditer(text)]
    out += [(m.start(), 3, m.end()) for m in _WIDE_PHONE.finditer(text)]
    return out


def votes(text: str, start: int, kind: int, end: int, base: bool) -> tuple[int, ...]:
    """Votes of LABELERS on a span: 1, -1 or 0 (abstains)."""
    span, digits = text[start:end], _digits(text[start:end])
    form = 1 if base or kind == 1 else 0
    if kind == 0:
        check = 1 if re.search(r"[A-Za-z]", span.split("@")[0]) else -1
        last = re.split(r"[^A-Za-z0-9]+", span.rstrip("])"))[-1].lower()
        gaz = 1 if last in _DOMAINS else 0
    elif kind == 1:
        check = 0 if ":" in span else (1 if not span.startswith("0.") else -1)
        gaz = 0 if ":" in span else (-1 if span.startswith(("127.", "255.")) else 1)
    elif kind == 2:
        check = 1 if _luhn(digits) else -1
        gaz = 1 if digits[:1] in "3456" else 0
    else:
        check = 1 if len(set(digits)) >= 4 else -1
        bare = digits.lstrip("0") if not span.startswith("+") else digits
        gaz = 1 if span.startswith(("+", "00")) and bare.startswith(_DIALS) else 0
    before = re.findall(r"[^\W\d_][\w.-]*", text[max(0, start - 40) : start].lower())[-3:]
    after = re.findall(r"[^\W\d_][\w.-]*", text[end : end + 24].lower())[:1]
    cues = {w.rstrip(".:") for w in before}
    context = 1 if cues & _FOR[KINDS[kind]] else -1 if cues & _AGAINST else 0
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    plain = -1 if glued or (after and after[0] in _AGAINST) else 1
    return form, check, gaz, context, plain


#: Numbers of classes of a span's length, share of digits, separators and longest run of digits.
SHAPE = (4, 4, 3, 4)


def shape(text: str, start: int, end: int) -> tuple[int, ...]:
    """Class of a span in each part of SHAPE."""
    span = text[start:end]
    runs = [len(x) for x in re.findall("[0-9]+", span)]
    other = {c for c in span if not c.isalnum()}
    return min(max(len(span) - 6, 0) // 6, 3), 3 * sum(runs) // len(span), min(len(other), 2), min((max(runs, default=0) + 1) // 3, 3)


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier over the one-hot kind, votes and shape; what EM found per labeler."""

    weights: np.ndarray
    reliability: dict[str, float]

    def probability(self, kind: int, v: tuple[int, ...], s: tuple[int, ...]) -> float:
        z = float(self.weights[_hot(kind, v, s)].sum())
        return 1 / (1 + np.exp(-z))


_VOTES = 5  # the first feature of the votes, behind the bias and the kinds
_SHAPES = _VOTES + 3 * len(LABELERS)
_FEATURES = _SHAPES + len(KINDS) * sum(SHAPE)


def _hot(kind: int, v: tuple[int, ...], s: tuple[int, ...]) -> list[int]:
    """Active features: bias, kind, each labeler's vote, and each class of the shape within that kind."""
    first = _SHAPES + kind * sum(SHAPE)
    return [0, 1 + kind, *(_VOTES + 3 * j + x + 1 for j, x in enumerate(v)), *(first + sum(SHAPE[:j]) + x for j, x in enumerate(s))]


def expectation_maximisation(patterns: dict[tuple, int], rounds: int = 60) -> tuple[dict[tuple, float], np.ndarray]:
    """Posterior of each (kind, votes) pattern, and P(vote | class) of each labeler [labeler, class, vote].

    Vote probabilities carry a prior worth 15 spans a class that says: labelers are right more often than not.
    """
    prior = np.array([[[6.0, 8.0, 1.0], [1.0, 8.0, 6.0]]] * len(LABELERS))  # classes no, yes; votes -1, 0, 1
    theta = prior / prior.sum(axis=2, keepdims=True)
    share = np.full(len(KINDS), 0.5)
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], float)
    kind = np.array([k[0] for k in keys], int)
    v = np.array([k[1] for k in keys], int).reshape(len(keys), len(LABELERS)) + 1
    post = np.full(len(keys), 0.5)
    for _ in range(rounds if len(keys) else 0):
        like = np.stack([np.log(theta[np.arange(len(LABELERS)), c, v]).sum(axis=1) for c in (0, 1)], axis=1)
        like += np.log(np.stack([1 - share[kind], share[kind]], axis=1))
        post = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
        for k in range(len(KINDS)):
            own = kind == k
            share[k] = (2 + (n * post)[own].sum()) / (4 + n[own].sum())
        for j in range(len(LABELERS)):
            for c, w in ((0, n * (1 - post)), (1, n * post)):
                got = prior[j, c] + np.bincount(v[:, j], weights=w, minlength=3)
                theta[j, c] = got / got.sum()
    return dict(zip(keys, post, strict=True)), theta


def fit_classifier(patterns: dict[tuple, int], post: dict[tuple, float], theta: np.ndarray, steps: int = 800) -> SpanModel:
    """Logistic regression of EM's posteriors on (kind, votes, shape) patterns, each weighted by its count (logarithmically damped)."""
    w = np.zeros(_FEATURES)
    w[0] = -1.0
    keys = list(patterns)
    if keys:
        x = np.zeros((len(keys), len(w)))
        for i, key in enumerate(keys):
            x[i, _hot(*key)] = 1
        y = np.array([post[k[:2]] for k in keys])
        n = np.log1p(np.array([patterns[k] for k in keys], float))
        n /= n.sum()
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            w = w - 1.5 * (x.T @ (n * (p - y)) + 1e-3 * w)
    right = theta[:, 1, 2] / (theta[:, 1, 2] + theta[:, 0, 2])
    return SpanModel(w, dict(zip(LABELERS, right.tolist(), strict=True)))


def train(docs: DataFrame, text: str = "text") -> SpanModel:
    """Vote patterns of all base and candidate spans of the corpus, counted by Spark; then EM and the classifier."""

    def count(batches):
        found: Counter = Counter()
        for b in batches:
            for t in (t for _, part in slices(b.column(0)) for t in part.to_pylist()):
                if t:
                    base = base_spans(t)
                    taken = _Taken(base)
                    found.update((k, votes(t, s, k, e, True), shape(t, s, e)) for s, k, e in base)
                    found.update((k, votes(t, s, k, e, False), shape(t, s, e)) for s, k, e in candidate_spans(t) if taken.free(s, e))
        yield pa.RecordBatch.from_pydict(
            {"kind": [k for k, _, _ in found], "votes": [list(v) for _, v, _ in found], "shape": [list(s) for _, _, s in found], "n": list(found.values())},
            schema=pa.schema([("kind", pa.int32()), ("votes", pa.list_(pa.int32())), ("shape", pa.list_(pa.int32())), ("n", pa.int64())]),
        )

    modest_batches(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string")).mapInArrow(count, "kind int, votes array<int>, shape array<int>, n long").groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n")).collect()
    patterns = {(r.kind, tuple(r.votes), tuple(r["shape"])): r.n for r in sorted(rows, key=lambda r: (r.kind, r.votes, r["shape"]))}
    by_votes: Counter = Counter()
    for key, n in patterns.items():
        by_votes[key[:2]] += n
    post, theta = expectation_maximisation(by_votes)
    return fit_classifier(patterns, post, theta)


class _Taken:
    """Spans in order of their starts, with the farthest end so far: what overlaps is found by halving."""

    def __init__(self, spans: list[tuple[int, int, int]] = ()) -> None:
        self.starts, self.reach = [s for s, _, _ in spans], []
        for _, _, e in spans:
            self.reach.append(max(e, self.reach[-1]) if self.reach else e)

    def free(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k == 0 or self.reach[k - 1] <= start

    def add(self, start: int, end: int) -> None:
        """A span that is free, among spans of which none overlap."""
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.reach.insert(k, end)


def all_spans(text: str, model: SpanModel, threshold: float = 0.8) -> tuple[list, list]:
    """Base spans, and base plus accepted spans, each (start, kind index, end) in order."""
    base = base_spans(text)
    taken, more, added = _Taken(base), [], _Taken()
    for s, k, e in candidate_spans(text):
        if taken.free(s, e) and added.free(s, e) and model.probability(k, votes(text, s, k, e, False), shape(text, s, e)) >= threshold:
            more.append((s, k, e))
            added.add(s, e)
    return base, sorted(base + more)


def find(docs: DataFrame, model: SpanModel, text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` with ``pii`` array<struct<start, kind, end, base>>; a column of that name is replaced."""
    modest_batches(docs.sparkSession)
    base = docs.drop(*({"pii"} - {text}))
    kept = [c for c in base.columns if c != "pii"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches):
        for b in batches:
            found = []
            for t in (t for _, part in slices(b.column(b.schema.get_field_index(text))) for t in part.to_pylist()):
                own, every = all_spans(t, sent.value, threshold) if t else ([], [])
                own_set = set(own)
                found.append([{"start": s, "kind": KINDS[k], "end": e, "base": (s, k, e) in own_set} for s, k, e in every])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(found, pa.list_(span))], [*kept, "pii"])

    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
    return base.mapInArrow(run, T.StructType([*(base.schema[c] for c in kept), T.StructField("pii", kind)]))
