"""N-gram Jaccard join: prefix filters under several global token orders, intersected before verification.

A document is its set of distinct word 5-grams. Two sets link when 100 * intersection >= 75 * union, so
the first n - ceil(0.75 n) + 1 tokens of both, under any one global order, share a token. Three orders
are used, all by document frequency first (so passages that many documents share come last), at three
grains, with different hashes below: (df, h), (log2 df, h'), (log2 df / 2, h'').

1. Tasks hash their texts and send the sorted 48-bit tokens of each block of documents to range shards, each
   token once a block with the number of its documents there; a block sends equal sets once. So a token that
   all documents hold is one entry a block, not one a document. A shard adds the numbers up and answers every
   block with its tokens that stand in two documents or more. (A token of one document only fills the prefix.)
2. A block keeps, for each document whose prefixes hold such a token, the three prefixes and the set of
   its shared tokens. Nothing is collected: everything is stored in the shared folder.
3. Candidates share a prefix token under the first order, pass the size and overlap bounds, and share
   prefix tokens under the second and the third order. Hot lists are not squared: in each list all sets
   are first held against one pivot (the one with the fewest tokens of its own), the links so far give
   components, and only sets outside a list's largest component are held against the rest, until no pair
   of different components is left unexamined. There, a 1024-bit parity signature bounds the symmetric
   difference from below inside the join, so that pairs too far apart never become rows. No link that
   could join two components is missed, while near copies cost one comparison each.

Words are told apart by 64 bits (see ``common.words_hashed``), tokens by 48 bits of a 64-bit hash: for two sets
of 500 tokens the odds of one false agreement are about 1e-9. Sets are told apart by their size and a 64-bit sum
of token hashes: some two of n different sets of one size agree with odds of about n * n / 2**65 (1e-7 for two million,
0.03 for a billion), and would then be one; sets of different sizes are mixed with them, so all of n documents count only
if they are of one size.

Defined cases: a null or wordless text has an empty set, links with nothing and is its own component; fewer
words than five are one token; equal sets are one component; rows of the same doc_id are treated as
documents of their own with that id; long texts are used whole; an empty table gives no rows. doc_id is an
integer column (others raise ValueError).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewell.llm.common import mix, modest_batches, pack_sorted, parts, stored, unpack_sorted, words_hashed
from prosewell.llm.components import components

SHINGLE, PERCENT, PIVOT_ROUNDS = 5, 75, 2
#: Columns of the parity signature: bit (token mod 1024) flips with each token.
SIGNATURE = tuple(f"s{k}" for k in range(16))
#: Stands for "several documents of the block" where a token's document is asked for.
SEVERAL = 0xFFFFFFFF
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(n_words: np.ndarray, hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(owner, token): the distinct shingles of each text, sorted by owner, then token."""
    owner = np.repeat(np.arange(len(n_words), dtype=np.int32), n_words)
    m = max(0, len(hashes) - size + 1)
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h += hashes[k : k + m] * _ODD[k]
        whole = owner[:m] == owner[size - 1 :] if m else np.zeros(0, bool)
        token, own = [mix(h[whole])], [owner[:m][whole]]
        short = np.flatnonzero((n_words > 0) & (n_words < size))
        start = (np.cumsum(n_words) - n_words)[short]
        if len(short):
            h = n_words[short].astype(np.uint64) * _ODD[7]
            for k in range(size - 1):
                has = n_words[short] > k
                h[has] += hashes[(start + k)[has]] * _ODD[k]
            token.append(mix(h))
            own.append(short.astype(np.int32))
    token, own = np.concatenate(token), np.concatenate(own)
    order = np.argsort(token)
    order = order[np.argsort(own[order], kind="stable")]
    token, own = token[order], own[order]
    if len(token):
        first = np.concatenate([[True], (token[1:] != token[:-1]) | (own[1:] != own[:-1])])
        token, own = token[first], own[first]
    return own, token


def _u64(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _blocks(docs: DataFrame, text: str, size: int, shards: int) -> DataFrame:
    """Rows for shards (keys, owners; numbers of documents of the tokens of several) and one row per block (ids, sizes, sets; the documents of those tokens)."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("several", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("sets", pa.list_(pa.int64()))])

    def run(batches):
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 24, 0
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, n_words, hashes in words_hashed(b.column(1)):
                own, token = shingles(n_words, hashes, size)
                n = np.bincount(own, minlength=len(n_words))
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token ^ _ODD[5]), dtype=np.uint64)])
                ends = np.cumsum(n)
                sets = mix(total[ends] - total[ends - n] + n.astype(np.uint64) * _ODD[6])
                block = base + k
                k += 1
                once = np.zeros(len(n), bool)
                once[np.unique(sets, return_index=True)[1]] = True
                keep = once[own]
                key = token[keep] >> np.uint64(16)
                order = np.argsort(key, kind="stable")
                key, who = key[order], own[keep][order].astype(np.uint32)
                at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                count = np.diff(np.append(at, len(key)))
                # the documents of tokens of several stay with the block
                kept = np.repeat(count > 1, count)
                rows = [(int(block % shards), block, None, who[kept].tobytes(), count[count > 1].astype(np.uint32).tobytes(), ids[first : first + len(n)], n.tolist(), _u64(sets).tolist())]
                key, who = key[at], np.where(count > 1, np.uint32(SEVERAL), who[at])
                bounds = np.searchsorted(key, [(s << 48) // shards + (1 if (s << 48) % shards else 0) for s in range(shards + 1)])
                for s in np.flatnonzero(np.diff(bounds)):
                    i, j = bounds[s], bounds[s + 1]
                    here = count[i:j]
                    rows.append((int(s), block, pack_sorted(key[i:j]), _planes(who[i:j]), here[here > 1].astype(np.uint32).tobytes(), None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "shard int, block long, keys binary, owners binary, several binary, ids array<long>, sizes array<long>, sets array<long>")


def _planes(values: np.ndarray) -> bytes:
    return values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplane(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


_ANSWERS = "block long, keys binary, owners binary, several binary, df binary, ids array<long>, sizes array<long>, sets array<long>"


def _answers(pdf):
    """A shard's answers: to every block, its tokens that two documents or more hold, and how many (2**32 - 1 at most)."""
    import pandas as pd

    tables = pdf[pdf["keys"].isna()]
    out = [{"block": int(r.block), "keys": None, "owners": r.owners, "several": r.several, "df": None, "ids": r.ids, "sizes": r.sizes, "sets": r.sets} for r in tables.itertuples()]
    asked = pdf[pdf["keys"].notna()]
    if len(asked):
        keys = [unpack_sorted(k) for k in asked["keys"]]
        who = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        key, owner = np.concatenate(keys), np.concatenate([_unplane(o) for o in asked["owners"]])
        number = np.ones(len(key), np.int64)
        number[owner == SEVERAL] = np.concatenate([np.frombuffer(x, np.uint32) for x in asked["several"]])
        order = np.argsort(key)
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        df = np.empty(len(key), np.int64)
        df[order] = np.repeat(np.add.reduceat(number[order], first), np.diff(np.append(first, len(key))))
        bounds = np.searchsorted(who, np.arange(len(keys) + 1))
        for k, block in enumerate(asked["block"]):
            s, e = bounds[k], bounds[k + 1]
            shared = df[s:e] > 1
            if shared.any():
                # the numbers only order tokens, and all blocks are told the same one
                out.append({"block": int(block), "keys": pack_sorted(key[s:e][shared]), "owners": _planes(owner[s:e][shared]), "several": None, "df": _planes(np.minimum(df[s:e][shared], SEVERAL)), "ids": None, "sizes": None, "sets": None})
    return pd.DataFrame(out, columns=["block", "keys", "owners", "several", "df", "ids", "sizes", "sets"])


def _documents(percent: int):
    """A block's documents, from its table and the shards' answers."""

    def run(pdf):
        import pandas as pd

        table = pdf[pdf["keys"].isna()].iloc[0]
        ids, n, sets = table.ids, np.array(table.sizes, np.int64), np.array(table.sets, np.int64)
        asked = pdf[pdf["keys"].notna()]
        cols: dict[str, list | np.ndarray] = {c: [None] * len(n) for c in ("one", "two", "three", "tokens")}
        # whole numbers throughout: a None among 64-bit words would make pandas round them to floats
        cols |= {c: np.zeros(len(n), np.int64) for c in ("slack", *SIGNATURE)}
        if len(asked):
            key = np.concatenate([unpack_sorted(k) for k in asked["keys"]])
            owner = np.concatenate([_unplane(o) for o in asked["owners"]]).astype(np.int64)
            df = np.concatenate([_unplane(d) for d in asked["df"]]).astype(np.int64)
            # tokens of several documents of the block: all of them are answered, and stand in the order of the keys
            by_key = np.argsort(key)
            key, owner, df = key[by_key], owner[by_key], df[by_key]
            times = np.ones(len(key), np.int64)
            times[owner == SEVERAL] = np.frombuffer(table.several, np.uint32)
            key, df, owner = np.repeat(key, times), np.repeat(df, times), np.repeat(owner, times)
            owner[owner == SEVERAL] = np.frombuffer(table.owners, np.uint32)
            order = np.lexsort((key, owner))
            key, owner, df = key[order], owner[order], df[order]
            grain = np.log2(df).astype(np.int64)
            orders = [np.lexsort((key, df, owner)), np.lexsort((mix(key), grain, owner)), np.lexsort((mix(key ^ _ODD[1]), grain // 2, owner))]
            bounds = np.searchsorted(owner, np.arange(len(n) + 1))
            need = -(-percent * n // 100)
            prefix = n - need + 1 - (n - np.diff(bounds))  # the tokens of one document come first
            for k in np.flatnonzero((prefix > 0) & (np.diff(bounds) > 0)):
                s, e = bounds[k], bounds[k + 1]
                for c, o in zip(("one", "two", "three"), orders, strict=True):
                    cols[c][k] = _u64(key[o[s:e]][: prefix[k]])
                cols["slack"][k] = int(e - s)
                cols["tokens"][k] = pack_sorted(key[s:e])
                parity = np.bincount((key[s:e] % np.uint64(64 * len(SIGNATURE))).astype(np.int64), minlength=64 * len(SIGNATURE)) & 1
                for c, bits in zip(SIGNATURE, np.packbits(parity.astype(np.uint8)).view(np.int64), strict=True):
                    cols[c][k] = bits
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n": n, "set": sets, **cols})

    return run


def _verify(batches):
    """Pairs whose Jaccard similarity reaches the bound: u, v, n_u, n_v, tokens_u, tokens_v, percent."""
    for b in batches:
        u, v, n_u, n_v, percent = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 6))
        both = np.zeros(len(u), np.int64)
        last, left = None, None
        for k, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
            if x is not last:
                last, left = x, unpack_sorted(x)
            joint = np.concatenate([left, unpack_sorted(y)])
            joint.sort()
            both[k] = int((joint[1:] == joint[:-1]).sum())
        ok = 100 * both >= percent * (n_u + n_v - both)
        yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok])], ["u", "v"])


def _links(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """Verified links of candidate pairs (u, v): both further filters first, then the sets themselves."""
    a = active.select(F.col("set").alias("u"), F.col("n").alias("n_u"), F.col("two").alias("two_u"), F.col("three").alias("three_u"), F.col("tokens").alias("tokens_u"))
    b = active.select(F.col("set").alias("v"), F.col("n").alias("n_v"), F.col("two").alias("two_v"), F.col("three").alias("three_v"), F.col("tokens").alias("tokens_v"))
    both = pairs.join(b, "v").join(a, "u").where(F.arrays_overlap("two_u", "two_v") & F.arrays_overlap("three_u", "three_v"))
    rows = both.select("u", "v", "n_u", "n_v", "tokens_u", "tokens_v", F.lit(percent).alias("percent"))
    return stored(rows.mapInArrow(_verify, "u long, v long"), "links")


def _possible(percent: int, a: str, b: str):
    """Size and overlap bounds: the overlap is at most the smaller number of shared tokens."""
    need = f"100 * {{}} >= {percent} * ({a}.n + {b}.n - {{}})"
    return F.expr(" AND ".join(need.format(x, x) for x in (f"{a}.slack", f"{b}.slack")) + f" AND 100 * {a}.n >= {percent} * {b}.n AND 100 * {b}.n >= {percent} * {a}.n")


def _near(percent: int):
    """The signatures' difference allows the overlap that the bound asks for."""
    differ = " + ".join(f"bit_count(a.{c} ^ b.{c})" for c in SIGNATURE)
    return F.expr(f"{100 + percent} * (a.slack + b.slack - ({differ})) >= {2 * percent} * (a.n + b.n)")


def class_links(active: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) between sets that together give the components of all links."""
    columns = ["token", "set", "n", "slack"]
    postings = stored(active.select(F.explode("one").alias("token"), "set", "n", "slack"), "postings")
    labels, found, seen = None, None, None
    for turn in range(PIVOT_ROUNDS + 1):
        if labels is None:
            here = postings.withColumn("label", F.col("set"))
        else:
            here = postings.join(labels, postings.set == labels.node, "left").select(*columns, F.coalesce("component", "set").alias("label"))
        sizes = here.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
        largest = sizes.groupBy("token").agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("token", F.col("top.label").alias("main"))
        # stored, so that both sides of the join are fresh exchanges and a hot token's postings can be split
        here = stored(here.join(stored(largest, "open-tokens"), "token"), "open-postings")
        if here.isEmpty():
            if found is None:
                found = stored(here.select(F.col("set").alias("u"), F.col("set").alias("v")), "links")
            break
        rest = here.where("label <> main") if turn else here
        if turn < PIVOT_ROUNDS:
            # the set with the fewest tokens of its own, among those outside the largest component
            pivot = rest.groupBy("token").agg(F.max(F.struct((F.col("slack") / F.col("n")).alias("share"), F.col("set"), F.col("n"), F.col("slack"), F.col("label"))).alias("p"))
            pivot = stored(pivot.select("token", "p.set", "p.n", "p.slack", "p.label"), "pivots")
            a, b = pivot.alias("a"), here.alias("b")
            pairs = a.join(b, "token").where((F.col("a.label") != F.col("b.label")) & _possible(percent, "a", "b"))
        else:
            signed = active.select("set", *SIGNATURE)
            a, b = rest.join(signed, "set").alias("a"), here.join(signed, "set").alias("b")
            once = (F.col("b.label") == F.col("b.main")) | (F.col("a.set") < F.col("b.set"))
            pairs = a.join(b, "token").where((F.col("a.label") != F.col("b.label")) & once & _possible(percent, "a", "b") & _near(percent))
        pairs = pairs.select(F.least("a.set", "b.set").alias("u"), F.greatest("a.set", "b.set").alias("v")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["u", "v"], "left_anti")
        pairs = stored(pairs, "pairs")
        seen = pairs if seen is None else seen.unionByName(pairs)
        links = _links(pairs, active, percent)
        found = links if found is None else found.unionByName(links)
        if turn < PIVOT_ROUNDS:
            labels = stored(components(found), "labels")
    return found


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and set (its class of equal sets), one row per row of ``docs``."""
    spark = docs.sparkSession
    modest_batches(spark)
    if docs.schema[doc_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{doc_id} must be an integer column")
    shards = 4 * max(2, parts(spark))  # a task takes several shards, one after the other
    asked = _blocks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "text", size, shards)
    answers = asked.groupBy("shard").applyInPandas(_answers, _ANSWERS)
    rows = answers.groupBy("block").applyInPandas(_documents(percent), "doc_id long, n long, set long, slack long, one array<long>, two array<long>, three array<long>, tokens binary, " + ", ".join(f"{c} long" for c in SIGNATURE))
    rows = stored(rows, "documents")
    active = stored(rows.where("one is not null").select("set", "n", "slack", "one", "two", "three", "tokens", *SIGNATURE).dropDuplicates(["set"]), "active")
    labels = stored(components(class_links(active, percent)), "labels")
    classes = stored(rows.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("least")), "classes")
    # only linked classes take a component's smallest id; stored, so that a large component can be split in the join
    linked = labels.join(classes, labels.node == classes.set).groupBy("component").agg(F.min("least").alias("component_id"))
    linked = labels.join(stored(linked, "component-ids"), "component").select(F.col("node").alias("set"), "component_id")
    named = stored(classes.join(linked, "set", "left").select(F.col("set").alias("s"), F.coalesce("component_id", "least").alias("component_id")), "named")
    out = rows.select("doc_id", "n", "set").join(named, F.col("set") == F.col("s"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "set")


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; columns stay as they are.

    Rows that share an id stand for one document: they stay or go together, and of equal rows one stays.
    """
    found = stored(join(docs, doc_id, text, size, percent).select("doc_id", "n_shingles", "component_id"), "components")
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("kept doc_id")).agg(F.count(F.lit(1)).alias("kept rows"))
    keep = stored(keep, "keep")
    repeats = keep.where("`kept rows` > 1")
    kept = docs.join(keep.select("kept doc_id"), F.col(doc_id).cast("long").eqNullSafe(F.col("kept doc_id")), "left_semi")
    if repeats.isEmpty():
        return kept
    again = F.col(doc_id).cast("long").eqNullSafe(F.col("kept doc_id"))
    single = kept.join(repeats.select("kept doc_id"), again, "left_anti")
    return single.unionByName(kept.join(repeats.select("kept doc_id"), again, "left_semi").dropDuplicates([doc_id, text]))
