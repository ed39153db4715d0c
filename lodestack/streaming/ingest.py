"""Keeping a chunk table current from a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files


def file_stream(spark: SparkSession, root: files.Root, per_batch: int = 1_000) -> DataFrame:
    """New files below a root as they appear: (source_path, source_file, document_type, suffix, file_hash, content)."""
    raw = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files.glob_of(tuple(files.READERS))).option("maxFilesPerTrigger", per_batch).load(root.path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    found = raw.select(files.source_path(F.col("path"), root, "").alias("source_path"), name.alias("source_file"), files.document_type(F.col("path"), root).alias("document_type"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"), F.sha2("content", 256).alias("file_hash"), "content")
    return found.where(F.col("suffix").isin(*files.READERS) & ~F.startswith("source_file", F.lit("~$")))


def upsert_stream(stream: DataFrame, upsert: Callable[[DataFrame], object], checkpoint: str):
    """Start a query that hands each micro-batch's units to upsert; a batch that is run again replaces what it wrote."""
    return stream.writeStream.foreachBatch(lambda batch, _: upsert(files.extract(batch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
