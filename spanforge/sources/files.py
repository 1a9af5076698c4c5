"""Files as rows: listing by suffix, first of each path; binary decoders are the caller's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """path, length, content of the files of a folder whose names end so, whatever their case, by path."""
    found = spark.read.format("binaryFile").load(folder)
    return found.filter(F.lower("path").endswith(suffix.lower())).select("path", "length", "content").orderBy("path")


def decode(files: DataFrame, decoder: Callable, schema: str) -> DataFrame:
    """Run a decoder (batches of path, content in; record batches of ``schema`` out) on the workers."""
    return files.select("path", "content").mapInArrow(decoder, schema)
