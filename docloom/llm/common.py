"""Helpers that the corpus operators share: staging in the shared folder, word
hashing over Arrow batches, and the fold rule of the query contracts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_made: list[list[str]] = []


@contextmanager
def cleared(spark: SparkSession):
    """Deletes at its end the folders that were named inside. Results are read from them, so what is
    wanted of a result must be written or collected inside."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared folder (spark.checkpoint.dir).

    Where that setting is absent, a session on one machine (a local test) gets a
    temporary folder; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/docloom-{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives
    the loss of executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Arrow batches of at most that many rows for what runs inside: a batch of texts
    is held several times over, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep_memory() -> None:
    """Let this worker use freed arrays again instead of mapping new pages for each:
    small steps of training make very many of a few hundred kilobytes. `give_back` ends
    what is held."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 8 << 20)  # arrays below 8 MB come from the heap
        libc.mallopt(-1, 64 << 20)  # which is cut back beyond 64 MB free
    except (OSError, AttributeError):
        pass  # another C library


def give_back() -> None:
    """Return freed memory to the machine: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to return by hand


def fold(key: Column, folds: int) -> Column:
    """crc32(key as text) mod folds; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def slots(spark: SparkSession) -> int:
    """Partitions for tables whose size the optimizer cannot see."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- text in numpy

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_GRAM = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow: list[np.ndarray] = []
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Between words [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+ (letters, digits, all beyond ASCII).
MARKS = np.zeros(256, bool)
MARKS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        m = max(n, 1 << 20)
        _pow[:] = []
        for base in (_BASE, _BASE_INV):
            p = np.ones(m, np.uint64)
            p[1:] = np.uint64(base)
            np.multiply.accumulate(p, out=p)
            _pow.append(p)
    return _pow


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into runs of rows of about `limit` bytes: first
    row, end row, the bytes, and where each row starts (one more entry closes the
    last). Nulls are empty texts. A longer single text is one run of its own."""
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, starts_of_rows: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are not `between`), and per
    row its first word (one more entry closes the last). A row's end ends a word."""
    space = between[data]
    inside = ~space
    begin = inside.copy()
    begin[1:] &= space[:-1]
    edges = starts_of_rows[1:-1]
    edges = edges[edges < len(data)]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    stop = np.ones(len(data) + 1, bool)
    stop[:-1] = space
    stop[edges] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts + 1)]
    return starts, ends, np.searchsorted(starts, starts_of_rows)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, A-Z as a-z."""
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[TO_LOWER[data]] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each place (len - n + 1 of them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out += words[j : j + m] * _GRAM[j]
    return mix(out)


def appended(docs: DataFrame, fields: list[tuple[str, str, pa.DataType]], score, keep: list[str]) -> DataFrame:
    """`keep` columns of docs and new ones that `score(text column)` returns as a list
    of Arrow arrays, in `fields` (name, SQL type, Arrow type)."""
    # by number, as a name with a dot cannot be given to mapInArrow
    kept = docs.select(*[F.col(f"`{c}`").alias(f"_docloom_{k}") for k, c in enumerate(keep)], F.col("text").cast("string").alias("_docloom_text"))
    ddl = ", ".join([f"`{c}` {f.dataType.simpleString()}" for c, f in zip(keep, kept.schema, strict=False)] + [f"`{n}` {t}" for n, t, _ in fields])
    names = [*keep, *[f[0] for f in fields]]

    def run(batches):
        for batch in batches:
            new = score(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, f[2]) for c, f in zip(new, fields, strict=True)]], names=names)
        give_back()

    return kept.mapInArrow(run, ddl)


def sampled(key: Column, share: Column | float) -> Column:
    """True for about that share of keys, the same keys each time."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < (F.lit(float(1 << 30)) * share)
