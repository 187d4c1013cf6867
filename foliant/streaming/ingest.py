"""Files that arrive over time become documents: each batch of new files is parsed and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import classify
from ..plans.documents import parse_files, released
from ..sources.files import MOST_BYTES, READ_ON, identified, validated

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 1000, max_bytes: int = MOST_BYTES) -> DataFrame:
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    readable = (F.col("length") <= max_bytes) | classify.suffix("path").isin(*[f".{p}" for p in READ_ON])
    return stream.withColumn("content", F.when(readable, F.col("content")))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, options: dict | None = None, formats: list[str] | None = None, files_per_trigger: int = 1000) -> StreamingQuery:
    """Parses what is new below ``folder`` and ends. Documents go to out/documents, errors to out/errors, in a folder for each
    batch that a rerun of the batch replaces; the checkpoint remembers which files were seen."""

    def batch(files: DataFrame, number: int) -> None:
        found = validated(identified(files))
        with released():
            docs, errors = parse_files(found, options, formats)
            docs.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
            errors.write.mode("overwrite").parquet(f"{out}/errors/batch={number}")

    return arriving(spark, folder, files_per_trigger).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
