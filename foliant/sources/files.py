"""Files of a folder as rows, decoded, validated and routed."""

from __future__ import annotations

import signal
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, text
from ..plans.registry import builtin, routed

MB = 1024 * 1024
#: Most bytes of a file, by parser, before a warning.
LARGE = {"text": 50 * MB, "markdown": 50 * MB, "epub": 500 * MB, "docx": 500 * MB}
MOST_BYTES = 500 * MB
#: Parsers that only warn above MOST_BYTES.
READ_ON = ("epub", "docx")


def scan(spark: SparkSession, path: str, glob: str | None = None, max_bytes: int | None = MOST_BYTES, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content). Of larger files only those of READ_ON are opened; the others are rows with null
    content, which ``validated`` turns into errors. The size filter reaches the source. Spark's file scan leaves out empty files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    if not max_bytes:
        return files
    large = files.where(F.col("length") > max_bytes)
    read_on = classify.suffix("path").isin(*[f".{p}" for p in READ_ON])
    unread = large.where(~read_on).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    return files.where(F.col("length") <= max_bytes).unionByName(large.where(read_on)).unionByName(unread)


@contextmanager
def time_limit(seconds: float | None) -> Iterator[None]:
    """TimeoutError after so many seconds (never, for None). Only where the platform has alarms, and in a process's main thread, as in a
    worker's; elsewhere there is no limit."""
    if not seconds or not hasattr(signal, "setitimer") or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise TimeoutError(f"not done after {seconds:g} seconds")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def identified(files: DataFrame) -> DataFrame:
    """Files with parser, file name, stem and suffix."""
    name = F.element_at(F.split("path", "/"), -1)
    return routed(files, builtin().frame(files.sparkSession)).withColumns({"file_name": name, "file_stem": classify.stem("path"), "suffix": classify.suffix("path")})


def validated(files: DataFrame) -> DataFrame:
    """Identified files with ``error`` (null if they may be parsed) and ``warnings``."""
    large = F.lit(None).cast("bigint")
    for parser, n in LARGE.items():
        large = F.when(F.col("parser") == parser, n).otherwise(large)
    error = F.when(F.col("parser").isNull(), F.concat(F.lit("unsupported format: "), F.col("suffix"))).when(F.col("length") == 0, "file is empty").when((F.col("length") > MOST_BYTES) & ~F.col("parser").isin(*READ_ON), F.concat(F.lit("file too large: "), text.byte_size("length")))
    warnings = F.array_compact(F.array(F.when(F.col("length") > large, F.concat(F.lit("large file: "), text.byte_size("length")))))
    return files.withColumns({"error": error, "warnings": warnings})


def texts(files: DataFrame) -> DataFrame:
    """Files with ``text`` decoded; bytes that are no UTF-8 are read as Latin-1 with a warning."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    note = F.when(~valid, F.lit("encoding: not UTF-8, read as Latin-1"))
    prior = F.col("warnings") if "warnings" in files.columns else F.array().cast("array<string>")
    return files.withColumns({"text": text.decoded("content"), "warnings": F.array_compact(F.concat(prior, F.array(note)))})
