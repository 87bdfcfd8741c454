"""Listings that arrive as files, parsed as they come by the same operators as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import asm
from ..functions.text import stem
from ..operators.listing import extract_functions


def arriving_listings(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(program_id, text, arrived) of whole listing files as they appear in a folder."""
    read = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return read.select(stem(F.col("_metadata.file_path")).alias("program_id"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))


def cleaned(listings: DataFrame) -> DataFrame:
    return listings.select("program_id", "arrived", asm.clean_assembly(F.col("text")).alias("cleaned"))


def functions_sink(listings: DataFrame, path: str, checkpoint: str):
    """Start a query that appends each batch's functions to a table."""

    def write(batch: DataFrame, _: int) -> None:
        extract_functions(batch.select("program_id", "text")).write.mode("append").parquet(path)

    return listings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
