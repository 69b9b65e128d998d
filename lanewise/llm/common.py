"""What the training-data operators share: staged tables, Arrow batches and word hashing.

Words are runs of bytes other than ASCII space and U+0009..U+000D; A-Z are folded.  Hashes
are computed for a whole block of texts at once with numpy: a word's hash chains a mixing
function over its bytes, eight at a time, so words of one length of up to eight bytes never
collide and no Python object is made for a word.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import hashlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
BLOCK_BYTES = 1 << 19
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20
NARROW_ROWS = 250_000

_own_dir: list[str] = []
_scratch: list[list[str]] = []
_results: list[list[str]] = []
_left: list[Callable[[], None]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lowers, for the session, what one Arrow batch of texts holds; a smaller setting is kept. Plans read it when they run, so it stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))
    if now <= 0 or now > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; where none is set, an own one, which only a local master's tasks can see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="lanewise-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, keep: bool = False, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing.
    Within scratch() the table goes when that ends, unless it is to be kept. Rows of each value of `by` are in a folder of their own."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with own_settings(spark, RELEASE):
        df.write.partitionBy(*[by] * (by is not None)).option("compression", "zstd").parquet(path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    elif _results:
        _results[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lanewise_path = path
    return out


#: Spark drops an action's shuffle files when it ends.
RELEASE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def own_settings(spark: SparkSession, own: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for what is planned and run meanwhile."""
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged while it holds are deleted when it ends; nothing that is returned may read them."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop_path(spark, path)


@contextlib.contextmanager
def results_dropped(spark: SparkSession) -> Iterator[None]:
    """Also the tables that operators' results read are deleted when it ends; what is wanted of those must be written by then."""
    _results.append([])
    try:
        yield
    finally:
        for path in _results.pop():
            drop_path(spark, path)


def prefiltered_joins(spark: SparkSession):
    """While it holds, Spark puts a Bloom filter of a join's filtered side (of a fixed size, 8 MB at most) before the
    other side's shuffle, whatever the sizes. Beyond what the filter can tell apart it only lets more rows through."""
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    return own_settings(spark, {prefix + "enabled": "true", prefix + "applicationSideScanSizeThreshold": "0", prefix + "creationSideThreshold": "10g"})


def map_arrow(df: DataFrame, f, schema, forget: Callable[[], None] | None = None) -> DataFrame:
    """df.mapInArrow(f, schema); a worker gives memory that a task no longer needs back before it waits for the next.
    `forget`, a module's function, drops what f keeps for the worker's next task; tasks of other kinds call it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(forget)
        try:
            yield from f(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def begin_task(forget: Callable[[], None] | None) -> None:
    """Drops what tasks of other kinds have left in this worker."""
    for other in [x for x in _left if x is not forget]:
        other()
        _left.remove(other)
    if forget is not None and forget not in _left:
        _left.append(forget)


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def keep(df: DataFrame) -> None:
    """What staged() wrote outlives results_dropped()."""
    for paths in _results:
        if df._lanewise_path in paths:
            paths.remove(df._lanewise_path)


def unstage(df: DataFrame) -> None:
    """Deletes what staged() wrote, once nothing reads it any more."""
    drop_path(df.sparkSession, df._lanewise_path)


def n_buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def n_tasks(spark: SparkSession) -> int:
    """Tasks for a step whose result is written and whose rows are worked off one after another: fewer, and so fewer files."""
    return -(-n_buckets(spark) // 3)


def narrow(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df in fewer tasks, and so fewer files once it is written: a third of the buckets, or one for each NARROW_ROWS where about
    their number is known, but as many as there are cores.  Each file costs a store several calls, and a local one several processes."""
    spark = df.sparkSession
    tasks = n_tasks(spark) if rows is None else min(n_buckets(spark), -(-rows // NARROW_ROWS))
    return df.coalesce(max(tasks, spark.sparkContext.defaultParallelism))


# --- hashing -------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    m = (1 << 64) - 1
    x &= m
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)
LONG_WORD = 512


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data: the bytes of texts end to end; offsets: where each begins, and the end.
    Returns where every word begins and ends, and the number of words of each text."""
    n = len(data)
    if n == 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.zeros(len(offsets) - 1, dtype=np.int64)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = solid[cuts]
    ends[cuts - 1] = solid[cuts - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.diff(np.searchsorted(s, offsets))


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and the number of words of each text."""
    s, e, counts = word_spans(data, offsets)
    return span_hashes(data, s, e, fold), counts


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """The hash of each span of bytes: of its length, then of eight bytes after eight."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = _LOWER[data] if fold else data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # those from each place on
    size = ends - begins
    out = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x57D))
    out = mix(out ^ (eight[begins] & _FIRST[np.minimum(size, 8)]))
    live, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(live):
        out[live] = mix(out[live] ^ (eight[begins[live] + at] & _FIRST[np.minimum(size[live] - at, 8)]))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(padded[begins[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span of bytes equals the span numbered by `other`."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    size, at, live = ends - begins, 0, np.arange(len(begins))
    if (size != size[other]).any():
        return False
    while len(live):
        if ((eight[begins[live] + at] ^ eight[begins[other[live]] + at]) & _FIRST[np.minimum(size[live] - at, 8)]).any():
            return False
        at += 8
        live = live[size[live] > at]
    return True


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(hashes, return_inverse=True) by a hash table, for many of few values."""
    number, values = pd.factorize(hashes)
    order = np.argsort(values)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return values[order], rank[number]


def sorting(keys: np.ndarray) -> np.ndarray:
    """A stable argsort of numbers from 0 on; they are sorted with their places in the low bits, if both fit."""
    n = len(keys)
    low = n.bit_length()
    if not n or int(keys.max()).bit_length() + low > 63:
        return np.argsort(keys, kind="stable")
    both = (keys.astype(np.int64) << low) | np.arange(n)
    both.sort()
    return both & ((1 << low) - 1)


def numbered_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(keys, return_inverse=True) of numbers from 0 on."""
    order = sorting(keys)
    ranked = keys[order]
    begins = np.ones(len(keys), dtype=bool)
    begins[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.cumsum(begins) - 1
    return ranked[begins], number


def packed(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, after a byte that tells how many."""
    width = 1 if (most := int(x.max(initial=0))) < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=f"<u{x[0]}", offset=1).astype(np.int64)


def by_bucket(hashes: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Places of the hashes of each bucket, in order."""
    bucket = (mix(hashes + U64(0x42)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [order[cuts[b] : cuts[b + 1]] for b in range(buckets)]


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each key, which stand together."""
    now, held = None, []
    for row in rows(batches):
        if held and row[key] != now:
            yield now, held
            held = []
        now = row[key]
        held.append(row)
    if held:
        yield now, held


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of a sequence of word hashes; windows over a border of texts are the caller's to leave out."""
    if len(words) < k:
        return np.empty(0, dtype=U64)
    n = len(words) - k + 1
    out = np.zeros(n, dtype=U64)
    for j in range(k):
        out *= U64(0xD6E8FEB86659FD93)
        out += words[j : j + n]
    return mix(out)


def text_blocks(ids: list, column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Cuts a column of texts into blocks of about `limit` bytes: ids, bytes, offsets. Null is an empty text; a longer text is a block of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, dtype=np.uint8)
    if column.null_count:  # a null's bytes, if any, are not text
        lengths = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
        if (lengths != np.diff(offsets)).any():
            yield from text_blocks(ids, pa.array([x or b"" for x in column.to_pylist()], pa.large_binary()), limit)
            return
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
