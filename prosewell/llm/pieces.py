"""SentencePiece encoding and decoding: shared-prefix Viterbi over a trie of marked words.

A text becomes marked words: a dummy space in front, every space written as the mark ``▁``, cut before
each run of marks (no piece of a model in use crosses such a cut; this is checked on loading). The
distinct words that a worker has not met yet are sorted, which lays them out as the depth-first order of
their trie, and one forward pass walks that trie: the forward state of every prefix is kept on a stack
and reused by all words that share the prefix.

* Unigram models: the state of a prefix is its best log score and last piece (classic Viterbi).
* BPE models: the state of a prefix is the last piece of that prefix's merge result. It is the one piece
  that ends there and is compatible with the state where it starts; two pieces are compatible if merging
  their joint text gives back just them. A sequence is the merge result exactly if all its neighbours are
  compatible, so the ids equal those of greedy merging, without merging each word.

The vocabulary is read from a model file whose path is a parameter; it is fixed in size and broadcast.
Tokenizers are never trained here.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids and decodes to the
empty text; characters outside the vocabulary become byte pieces, or, where the model has none, the unknown
piece, one for a run of them (then the round trip is not exact). Models that normalise texts or have pieces
of the user's own are refused (ValueError). A text that holds the mark ``▁`` itself decodes with spaces
in its place, as the format cannot tell them apart; ``round_trip`` is false there. Long texts are encoded
whole. Repeated rows give the same ids. Other columns pass through.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from prosewell.llm.common import give_back, modest_batches, slices

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of each of the two generations that a task remembers; bounds its memory.
CACHE_WORDS = 300_000


class PieceModel:
    """Vocabulary of a SentencePiece model file, and the shared-prefix encoder on it."""

    def __init__(self, data: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(data)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("models with pieces of the user's own are not supported")
        self.prefix = spec.add_dummy_prefix
        self.bpe = proto.trainer_spec.model_type == 2
        self.text = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.score = [p.score for p in proto.pieces]
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == 2), 0)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece of this model crosses words")
        # characters that no longer piece holds merge with nothing: a cut on both sides of them is exact
        inner = set("".join(p for p in self.ids if len(p) > 1))
        apart = "".join(re.escape(c) for c in "\n\r\t" if c not in inner)
        self.words = re.compile(f"[{apart}]|{MARK}*[^{MARK}{apart}]+|{MARK}+" if apart else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.compatible: dict[tuple, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.lost: set[str] = set()  # remembered words whose ids do not decode to them
        self.floor = min(self.score, default=0.0) - 10
        self.id_bytes = {p: np.array([i], np.int32).tobytes() for p, i in self.ids.items()}
        self.trie: dict = {}
        for p in self.ids:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        raw = []
        for i, p in enumerate(proto.pieces):
            raw.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type in (2, 3) else p.piece.replace(MARK, " ").encode())
        self.raw = raw

    def merged(self, text: str) -> list[str]:
        """Greedy merging of a short text: best score first, then leftmost."""
        parts = list(text)
        while True:
            best = None
            for k, (a, b) in enumerate(pairwise(parts)):
                i = self.ids.get(a + b)
                if i is not None and (best is None or self.score[i] > best[0]):
                    best = (self.score[i], k)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.compatible.get(key)
        if found is None:
            if len(self.compatible) > 250_000:
                self.compatible.clear()
            found = self.compatible[key] = self.merged(left + right) == [left, right]
        return found

    def ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        if self.byte:
            return [self.byte[b] for b in piece.encode("utf-8", "replace")]
        return [self.unknown]

    def whole(self, piece: str) -> bool:
        """Does merging the piece's own text reach it?"""
        found = self.compatible.get(piece)
        if found is None:
            found = self.compatible[piece] = self.merged(piece) == [piece]
        return found

    def _extend_bpe(self, state: tuple, stack: list, end: int, char: str) -> tuple:
        """State of the prefix that ends with ``char``: the last piece of its merge result, and the open pieces.

        An open piece is (start, trie node) of a piece that may still grow; the longest come first.
        """
        grown, last = [], None
        for start, node in (*state[1], (end - 1, self.trie)):
            node = node.get(char)
            if node is None:
                continue
            grown.append((start, node))
            if last is None and (piece := node.get("")) is not None and (start == 0 or self.fits(stack[start][0], piece)) and self.whole(piece):
                last = piece
        if last is None:
            last = char  # a character without a piece of its own; it merges with nothing
        return last, grown

    def _extend_unigram(self, state: tuple, stack: list, end: int, char: str) -> tuple:
        """State of the prefix that ends with ``char``: the last piece of its best split, the open pieces, its score."""
        grown, best = [], None
        for start, node in (*state[1], (end - 1, self.trie)):
            node = node.get(char)
            if node is None:
                continue
            grown.append((start, node))
            if (piece := node.get("")) is not None:
                s = stack[start][2] + self.score[self.ids[piece]]
                if best is None or s > best[0]:
                    best = (s, piece)
        if best is None:
            best = (stack[end - 1][2] + self.floor, char)
        return best[1], grown, best[0]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (int32 bytes) of each distinct word: one depth-first walk of the words' trie."""
        out: dict[str, bytes] = {}
        extend = self._extend_bpe if self.bpe else self._extend_unigram
        stack: list = [("", (), 0.0)]  # forward state of each prefix of the previous word
        before = ""
        for word in sorted(words):
            n, same, most = len(word), 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del stack[same + 1 :]
            for end in range(same + 1, n + 1):
                stack.append(extend(stack[-1], stack, end, word[end - 1]))
            before = word
            found, at = [], n
            while at:
                piece = stack[at][0]
                found.append(piece)
                at -= len(piece)
            out[word] = b"".join([self.id_bytes.get(p) or np.array(self.ids_of(p), np.int32).tobytes() for p in reversed(found)])
        return out

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bool]]:
        """Ids of whole texts, as int32 bytes; and whether these decode to the text.

        Decoding joins the bytes of the pieces, so a text comes back exactly if each of its words does and it holds
        no mark of its own; each different word is decoded once.
        """
        lists, new = [], set()
        for t in texts:
            words = self.words.findall(((" " if self.prefix else "") + t).replace(" ", MARK)) if t else []
            lists.append(words)
            new.update(words)
        cache, older = self.cache, self.older
        new.difference_update(cache)
        for w in new & older.keys():  # words of the generation before move on
            cache[w] = older[w]
        new.difference_update(older)
        fresh = self.encode_words(list(new))
        self.lost.update(w for w, ids in fresh.items() if self.bytes_of(memoryview(ids).cast("i")) != w.replace(MARK, " ").encode("utf-8", "replace"))
        cache.update(fresh)
        get = cache.__getitem__
        found = [b"".join(map(get, words)) for words in lists]
        if not self.byte:
            found = [self._joined(x) for x in found]
        lost = self.lost
        same = [not t or (MARK not in t and (not lost or lost.isdisjoint(words))) for t, words in zip(texts, lists, strict=True)]
        if len(cache) > CACHE_WORDS:
            self.cache, self.older = {}, cache
            self.lost = {w for w in lost if w in cache}
        return found, same

    def forget(self) -> None:
        """Drops the words and pairs remembered so far; the vocabulary stays."""
        self.cache, self.older, self.lost, self.compatible = {}, {}, set(), {}
        give_back()

    def _joined(self, ids: bytes) -> bytes:
        """A run of unknown pieces as one."""
        x = np.frombuffer(ids, np.int32)
        again = np.flatnonzero((x[1:] == self.unknown) & (x[:-1] == self.unknown)) + 1
        return np.delete(x, again).tobytes() if len(again) else ids

    def bytes_of(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        data = self.bytes_of(ids)
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


_LOADED: dict[int, PieceModel] = {}


def _model(sent) -> PieceModel:
    """The broadcast model, parsed once per worker."""
    key = hash(sent.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceModel(sent.value)
    return _LOADED[key]


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    """The model file, read on the driver (it is fixed in size and sent by broadcast)."""
    with open(path, "rb") as f:
        return f.read()


def _groups(column: pa.Array, m: PieceModel, group: int):
    """(first row, ids as bytes, texts, do they decode to them) of about ``group`` bytes of text at a time."""
    for at, part in slices(column, group):
        texts = part.to_pylist()
        found, same = m.encode(texts)
        yield at, found, texts, same


def _id_lists(found: list[bytes], texts: list[str | None]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), np.int32)), mask=pa.array([t is None for t in texts]))


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", group: int = 1_000_000) -> DataFrame:
    """``docs`` with ``ids`` array<int>; a column of that name is replaced."""
    modest_batches(docs.sparkSession)
    base = docs.drop(*({ids} - {text}))
    kept = [c for c in base.columns if c != ids]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = _model(sent)
        try:
            for b in batches:
                for at, found, texts, _ in _groups(b.column(b.schema.get_field_index(text)), m, group):
                    part = b.slice(at, len(texts))
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), _id_lists(found, texts)], [*kept, ids])
        finally:  # the worker lives on, and other operators' tasks run in it
            m.forget()

    return base.mapInArrow(run, T.StructType([*(base.schema[c] for c in kept), T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def round_trip(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", group: int = 1_000_000) -> DataFrame:
    """``docs`` without its text, with ``ids`` array<int> and round_trip: do the ids decode to the text? One pass."""
    modest_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, ids, "round_trip")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = _model(sent)
        try:
            for b in batches:
                column = b.column(b.schema.get_field_index(text))
                for at, found, texts, same in _groups(column, m, group):
                    part = b.slice(at, len(texts))
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), _id_lists(found, texts), pa.array(same)], [*kept, ids, "round_trip"])
        finally:
            m.forget()

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]))


def decode(encoded: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text; null ids decode to null."""
    modest_batches(encoded.sparkSession)
    base = encoded.drop(*({text} - {ids}))
    kept = [c for c in base.columns if c != text]
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = _model(sent)
        for b in batches:
            column = b.column(b.schema.get_field_index(ids))
            values, at, there = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist(), column.is_valid().to_pylist()
            # one row's ids become Python numbers at a time
            found = [m.decode(values[s:e].tolist()) if ok else None for s, e, ok in zip(at, at[1:], there, strict=False)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(found, pa.string())], [*kept, text])

    return base.mapInArrow(run, T.StructType([*(base.schema[c] for c in kept), T.StructField(text, T.StringType())]))
