"""Documents in: files, string columns, and encoders that write table rows as rich text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def read_files(spark: SparkSession, path: str, limit_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """(doc_id, rtf, read_error) of each file; doc_id is its path. Bytes that aren't UTF-8, and files beyond the limit, have an error and no text; parse() passes the error on."""
    return from_files(spark.read.format("binaryFile").load(path), limit_bytes)


def from_files(files: DataFrame, limit_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """The same of rows of the binaryFile source."""
    # try_validate keeps what is valid; null means it isn't
    text = F.try_validate_utf8(F.col("content").cast("string"))
    big = F.col("length") > limit_bytes
    error = F.when(big, "input_too_large").when(text.isNull(), "invalid_utf8")
    return files.select(F.col("path").alias("doc_id"), F.when(~big, text).alias("rtf"), error.alias("read_error"))


def from_column(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("rtf"))


def escaped(text: str | Column) -> Column:
    """Text as the body of a document: braces and backslashes escaped, line ends as \\par, other characters beyond ASCII as \\uN?.

    Characters beyond the basic plane go as two surrogates, control characters other than line ends are left out. What a text doesn't hold isn't looked for again.
    """
    given = F.col(text) if isinstance(text, str) else text
    c = F.when(given.rlike(r"[\\{}]"), F.regexp_replace(given, r"([\\{}])", r"\\$1")).otherwise(given)
    c = F.when(given.rlike(r"[\x00-\x09\x0b-\x1f\x7f-\x9f]"), F.regexp_replace(c, r"[\x00-\x09\x0b-\x1f\x7f-\x9f]", "")).otherwise(c)
    units = F.regexp_extract_all(c, F.lit(r"(?s)([^\x00-\x7f]+|[\x00-\x7f]+)"), F.lit(1))
    pairs = lambda run: F.regexp_extract_all(F.hex(F.encode(run, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    signed = lambda h: F.conv(h, 16, 10).cast("int") - F.when(F.conv(h, 16, 10).cast("int") > 32767, 65536).otherwise(0)
    one = lambda run: F.when(F.ascii(run) < 128, run).otherwise(F.array_join(F.transform(pairs(run), lambda h: F.concat(F.lit("\\u"), signed(h).cast("string"), F.lit("?"))), ""))
    c = F.when(given.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(units, one), "")).otherwise(c)
    return F.replace(c, F.lit("\n"), F.lit("\\par "))


def document(body: Column, head: str = "") -> Column:
    return F.concat(F.lit("{\\rtf1\\ansi " + head), body, F.lit("}"))


def encode_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), document(escaped(F.coalesce(F.col(text_col), F.lit("")))).alias("rtf"))


def encode_rows(df: DataFrame, id_col: str, order_col: str, cells: list[str], width: int = 1440) -> DataFrame:
    """One document for each id: a table with a row for each of its rows, in order, and a cell for each of the columns."""
    define = "\\trowd" + "".join(f"\\cellx{width * (i + 1)}" for i in range(len(cells))) + " "
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = [escaped(said(c)) if isinstance(df.schema[c].dataType, StringType) else said(c) for c in cells]  # digits need no escapes
    row = F.concat(F.lit(define), *(x for b in body for x in (F.lit("\\pard\\intbl "), b, F.lit("\\cell "))), F.lit("\\row "))
    rows = df.select(F.col(id_col).alias("doc_id"), F.struct(F.col(order_col).alias("o"), row.alias("r")).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["r"]), "")
    return rows.groupBy("doc_id").agg(document(body).alias("rtf"))
