"""What the operators of this folder share: words, stable hashes, folds, shared storage, Arrow batches.

Words are runs of bytes other than space and 0x09-0x0D. ``bytes.split()`` cuts at exactly these six
bytes and ``bytes.lower()`` changes A-Z only, so both act on UTF-8 without decoding it.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries that a word cache may hold before it starts anew (about 150 bytes each).
CACHE_WORDS = 200_000
#: UTF-8 bytes that one step of a worker handles at once; a longer text is a step of its own.
STEP_BYTES = 2_000_000

#: Rows that a key may have in a task of ``spread_join``, and keys with more at most (so many are broadcast).
HOT_ROWS, HOT_KEYS = 1000, 100_000

_U = np.uint64


class HashCache(dict):
    """word -> 64-bit xxHash, bounded by CACHE_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(words: list[bytes], cache: HashCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every window of n words, from the words' hashes; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m]
    for i in range(1, n):
        out = mix64(out) + h[i : i + m] * _U(0x9E3779B97F4A7C15)
    return mix64(out)


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32(doc_id as text) mod k; 0 where doc_id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % k if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % k, F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = getattr(spark, "_foliant_shared", None)
        if at is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            at = spark._foliant_shared = "file://" + tempfile.mkdtemp(prefix="foliant-")
            spark.sparkContext.setCheckpointDir(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)  # with its scheme, so that workers know a mounted folder
    return str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()).rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    for spark, path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended; the folder is scratch space
            return


atexit.register(_remove_written)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/foliant-{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


#: Spark's setting that removes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run within leave no shuffle files behind; the setting is as before afterwards."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage is cut, and columns are still pruned. The shuffle files
    of the write go with it, as nothing reads them any more."""
    spark = df.sparkSession
    with shuffles_removed(spark):
        df.write.parquet(path := scratch(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table of ``stored`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/foliant-" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def private(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def spread_join(big: DataFrame, small: DataFrame, key: str, by: str, limit: int | None = None, total: int | None = None, counted: str | None = None) -> DataFrame:
    """``big`` joined to ``small`` (one row for each ``key``), with the rows of a hot key dealt over several tasks by the column ``by``.

    A key is hot if it has more than ``limit`` rows, or more than a HOT_KEYS-th of all; so there are HOT_KEYS hot keys at
    most, which are broadcast with their number of parts, and the row of ``small`` is repeated for each part.
    ``big`` should be a stored table: its keys are counted first, unless ``small`` has their counts in the column ``counted``, or
    ``big`` has no more than ``limit`` rows in ``total``.
    """
    limit = HOT_ROWS if limit is None else limit
    if total is not None and total <= limit:
        return big.join(small, key)
    known = small.select(key, F.col(counted).alias("rows_of_key")) if counted else big.groupBy(key).agg(F.count("*").alias("rows_of_key"))
    counts = known.where(F.col("rows_of_key") > limit)
    if counts.isEmpty():
        return big.join(small, key)
    limit = max(limit, (big.count() if total is None else total) // HOT_KEYS)
    part, parts = private("part"), private("parts")
    hot = F.broadcast(stored(counts.where(F.col("rows_of_key") > limit).select(key, F.ceil(F.col("rows_of_key") / limit).cast("int").alias(parts)), "hot"))
    many = big.join(hot, key, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(by), F.col(parts)), F.lit(0)).cast("int")).drop(parts)
    each = small.join(hot, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts)
    return many.join(each, [key, part]).drop(part)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most so many rows for this session's plans, so that long texts do not make a batch too large for
    a worker. The setting is read when a plan runs, so it stays; a smaller one of the session's own is left alone."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def steps(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def give_back() -> None:
    """Returns what a task has freed to the system, so that a worker that is used again starts small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim is not None:
        trim(0)


def per_text(
    docs: DataFrame,
    keep: list[str],
    text_col: str,
    fields: list[tuple[str, T.DataType, pa.DataType]],
    make: Callable[[], Callable[[list[bytes]], list]],
) -> DataFrame:
    """The columns ``keep`` and, for every text, the fields that the worker's function returns as one list or array each.

    ``make`` runs once in each task. No other column of ``docs`` is read, so their names can't clash.
    """
    small_batches(docs.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField(n, source.schema[n].dataType) for n in names] + [T.StructField(f"v{i}", t) for i, (_, t, _) in enumerate(fields)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = texts_of(batch.column(len(names)))
            parts = [work(texts[a:b]) for a, b in steps(texts)]
            values = [pa.concat_arrays([pa.array(p[i], type=t) for p in parts]) for i, (_, _, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *values], names=schema.fieldNames())
        del work
        give_back()

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *[F.col(f"v{i}").alias(n) for i, (n, _, _) in enumerate(fields)])


def filtered(docs: DataFrame, text_col: str, make: Callable[[], Callable[[list[bytes]], np.ndarray]]) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the worker's function accepts. Columns keep place, name and type."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                texts = texts_of(batch.column(at))
                yield batch.filter(pa.array(np.concatenate([work(texts[a:b]) for a, b in steps(texts)]).astype(bool)))
        del work
        give_back()

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
