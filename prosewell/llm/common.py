"""Shared helpers: the shared folder, written intermediate tables, vectorised tokens."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset (local tests) a temporary folder of this machine is set as it.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = sc._jsc.sc().getCheckpointDir()
        if made.isDefined():
            found = made.get()
        elif not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="prosewell-")
            sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that this driver has made; ``forget`` removes them.
_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def forget(spark: SparkSession) -> int:
    """Removes the intermediate tables and models made so far, once no result that reads them is needed any more; returns their number."""
    made, gone = spark._jvm.org.apache.hadoop.fs, 0
    while _MADE:
        path = made.Path(_MADE.pop())
        gone += bool(path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True))
    return gone


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_ROWS = 1_000


def modest_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows go to a Python worker at once: whole texts are long, and a batch lies in memory on both sides.

    This lowers a setting of the session (spark.sql.execution.arrow.maxRecordsPerBatch); it never raises it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _at_place(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A value of its own, in effect random, for each byte at each place of a word."""
    with np.errstate(over="ignore"):
        return mix((place.astype(np.uint64) * np.uint64(256) + byte.astype(np.uint64) + np.uint64(1)) * _MULT)


#: The values of the first places, looked up instead of computed.
_NEAR_PLACES = 64
_PLACES = _at_place(np.repeat(np.arange(_NEAR_PLACES), 256), np.tile(np.arange(256), _NEAR_PLACES))
#: ASCII lower case of a byte; other bytes stay.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes 09-0D and 20.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _trim() -> None:
    """Gives freed memory back to the system (where the C library can)."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def give_back() -> None:
    """Gives freed memory, that of Arrow's buffers included, back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _trim()


def slices(column, size: int = 2_000_000):
    """(first row, part) of an Arrow string column, cut between texts into parts of about ``size`` bytes."""
    ends = _offsets(column)[1:]
    at = 0
    while at < len(column):
        start = ends[at - 1] if at else _offsets(column)[0]
        end = max(at + 1, int(np.searchsorted(ends, start + size, side="right")))
        yield at, column.slice(at, end - at)
        at = end
    _trim()


def _offsets(column) -> np.ndarray:
    if not len(column):
        return np.zeros(1, np.int64)
    kind = np.int64 if str(column.type).startswith("large") else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]


def words_hashed(texts, chunk: int = 2_000_000):
    """Words ``[^\\x20\\x09-\\x0D]+`` of A-Z lower-cased texts (a list or an Arrow column), as 64-bit hashes.

    Yields (first, n_words, hashes): ``first`` is the index of the chunk's first text, ``n_words`` the
    number of words of each text in it, ``hashes`` the words of all of them in order. A null text has
    no words. A chunk holds whole texts, about ``chunk`` bytes of them.

    A hash is the sum of one value per (place, byte) of the word, and every value is a mix of its own, so
    no pattern inside a word makes two words agree (as the powers of one number modulo 2**64 would): two
    different words agree with odds of 2**-64, some two of n different words with about n * n / 2**65.
    """
    if isinstance(texts, list):
        import pyarrow as pa

        texts = pa.array(texts, pa.string())
    for first, part in slices(texts, chunk):
        offsets = _offsets(part).astype(np.int64)
        data = part.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        bounds = offsets - offsets[0]
        n = len(raw)
        edge = np.zeros(n + 1, bool)  # a text begins (or all end) here
        edge[bounds] = True
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = ~_SPACE[raw]
        start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
        end = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
        size = end - start
        begin = np.cumsum(size) - size  # of each word among the bytes of words
        byte = _LOWER[raw[solid[1:-1]]]
        place = np.arange(len(byte), dtype=np.int32) - np.repeat(begin, size).astype(np.int32)
        x = _PLACES[np.minimum(place, _NEAR_PLACES - 1) * 256 + byte]
        far = np.flatnonzero(place >= _NEAR_PLACES)
        x[far] = _at_place(place[far], byte[far])
        with np.errstate(over="ignore"):
            hashes = np.add.reduceat(x, begin) if len(begin) else np.zeros(0, np.uint64)
            hashes += size.astype(np.uint64) * _MULT
        yield first, np.diff(np.searchsorted(start, bounds)), mix(hashes)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte plane by byte plane: the shuffle's compressor drops the empty planes."""
    if not len(keys):
        return b""
    steps = np.empty(len(keys), np.uint64)
    steps[0] = keys[0]
    np.subtract(keys[1:], keys[:-1], out=steps[1:])
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)
    return np.cumsum(steps, dtype=np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys.astype(np.uint64), counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts.astype(np.int64), first)


def write_array(uri: str, array: np.ndarray) -> None:
    """A file of the shared folder, put in place in one step, so that a repeated task does no harm."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).tobytes())
    system.move(part, path)


def map_array(uri: str, dtype) -> np.ndarray:
    """A file of the shared folder, memory-mapped; one in a remote store is read into a mapping of this process's own. A file that is not there is empty."""
    import mmap

    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    size = system.get_file_info(path).size
    if not size:
        return np.zeros(0, dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    own = mmap.mmap(-1, size)
    with system.open_input_stream(path) as src:
        while block := src.read(1 << 24):
            own.write(block)
    return np.frombuffer(own, dtype)
