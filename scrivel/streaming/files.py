"""Documents that arrive in a folder, read by the same plan: it keeps nothing between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrivel.limits import Limits
from scrivel.operators.parse import parse
from scrivel.sources.rtf import from_files

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def parse_stream(spark: SparkSession, path: str, limits: Limits | None = None) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(SCHEMA).load(path)
    limits = limits or Limits()
    return parse(from_files(files, limits.max_input_bytes), limits)
