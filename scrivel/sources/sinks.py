"""Results out. Existing output is an error unless it is to be replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.operators import parse as P

TABLES = ("nodes", "inlines", "warnings", "sections", "generated")


def write_tables(parsed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Every table of what was read, as Parquet below path, with stats and failures. `parsed` is read once for each: give a written one."""
    for name in TABLES:
        P.table(parsed, name).write.mode(mode).parquet(f"{path}/{name}")
    P.stats(parsed).write.mode(mode).parquet(f"{path}/stats")
    P.failures(parsed).write.mode(mode).parquet(f"{path}/failures")


def write_ir(parsed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One line of JSON for each document: its id and its model."""
    rows = parsed.where("error_type IS NULL")
    rows.select(F.concat(F.lit('{"doc_id":'), F.to_json(F.array("doc_id")).substr(F.lit(2), F.length(F.to_json(F.array("doc_id"))) - 2), F.lit(',"document":'), F.col("ir"), F.lit("}")).alias("value")).write.mode(mode).text(path)


def write_reports(parsed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    stats = F.struct("paragraph_count", "run_count", "bytes_processed", "duration_ms").alias("stats")
    parsed.where("error_type IS NULL").select("doc_id", "warnings", stats).write.mode(mode).json(path)


def write_rendered(rendered: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rendered documents (doc_id, output, reasons) as Parquet: files of their own would be one small object for each document."""
    rendered.write.mode(mode).parquet(path)
