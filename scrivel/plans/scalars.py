"""Queries on files, on limits, and on single values: bytes, names of fonts, colors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scrivel.functions import columns as C
from scrivel.limits import Limits
from scrivel.operators import slices as S
from scrivel.operators import tokens as T
from scrivel.operators.lineage import shared_dir
from scrivel.plans.queries import joined, of_parts, query, read
from scrivel.sources.rtf import document, escaped, read_files

#: Bytes of a file, at most, in file_scan.
MOST = 20_000


@query("""
SELECT c_custkey // 50 AS doc_id, CASE WHEN c_custkey // 50 % 4 = 3 THEN 'input_too_large' END AS read_error,
  CASE WHEN c_custkey // 50 % 4 < 3 THEN md5(string_agg(c_name || ' ' || c_mktsegment || chr(10), '' ORDER BY c_custkey)) END AS digest FROM customer GROUP BY c_custkey // 50
""")
def file_scan(spark, sf_dir):
    """A file for every fifty customers, every fourth file longer than MOST bytes: the text of those that can be read, the error of the others."""
    line = F.concat(escaped("c_name"), F.lit(" "), escaped("c_mktsegment"), F.lit("\\par "))
    docs = read(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 50).alias("g")).agg(joined(line, F.col("c_custkey")).alias("body"))
    long = F.when(F.col("g") % 4 == 3, F.repeat(F.lit("{\\b0}"), MOST // 5)).otherwise("")
    path = f"{shared_dir(spark)}/scrivel/{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}"
    docs.select("g", document(F.concat("body", long)).alias("rtf")).write.partitionBy("g").text(path)
    files = read_files(spark, f"{path}/*/*.txt", MOST)
    number = F.regexp_extract("doc_id", "/g=([0-9]+)/", 1).cast("long").alias("doc_id")
    text = T.plain_text(files.where("read_error IS NULL")).select(number, F.lit(None).cast("string").alias("read_error"), F.md5(F.col("text").cast("binary")).alias("digest"))
    return text.unionByName(files.where("read_error IS NOT NULL").select(number, "read_error", F.lit(None).cast("string").alias("digest")))


@query("""
SELECT p_partkey AS doc_id, limits, CASE WHEN limits = 'small' AND 14 + 12 * p_size > 300 THEN 'input_too_large' WHEN limits = 'small' AND 6 * p_size + 1 > 20 OR limits = 'default' AND 6 * p_size + 1 > 256 THEN 'group_depth_exceeded' END AS error_type
FROM part, (SELECT unnest(['default', 'small', 'unlimited']) AS limits) WHERE error_type IS NOT NULL
""")
def parser_limits(spark, sf_dir):
    """Groups within groups, under the limits that hold unless others are given, under small ones, and under none."""
    n = (F.col("p_size") * 6).cast("int")
    docs = of_parts(spark, sf_dir, F.concat(F.repeat(F.lit("{"), n), F.lit("x"), F.repeat(F.lit("}"), n)))
    kinds = {"default": Limits(), "small": Limits(max_input_bytes=300, max_group_depth=20), "unlimited": Limits.unlimited()}
    found = [S.errors(docs, limits).select("doc_id", F.lit(name).alias("limits"), "error_type") for name, limits in kinds.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


#: The characters of bytes 128 to 159, in order: those of Windows-1252, and for the five that it leaves open control characters.
HIGH = ", ".join(f"chr({ord(bytes([b]).decode('cp1252', 'ignore') or chr(b))})" for b in range(128, 160))


@query(f"""
SELECT o_orderkey AS doc_id, CASE WHEN b BETWEEN 128 AND 159 THEN [{HIGH}][b - 127] ELSE chr(CAST(b AS INTEGER)) END AS character FROM (SELECT o_orderkey, 32 + o_orderkey % 224 AS b FROM orders)
""")
def windows_1252_bytes(spark, sf_dir):
    """The characters of bytes in hexadecimal digits."""
    digits = F.lower(F.lpad(F.hex(32 + F.col("o_orderkey") % 224), 2, "0"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), C.windows_1252(digits).alias("character"))


@query(r"""
SELECT doc_id, md5(regexp_replace(substr(text, 1, 200) || '"; } é_中-x', '[^\p{L}\p{N} _-]', '', 'g')) AS name FROM documents
""")
def font_names(spark, sf_dir):
    """Whatever a document begins with as the name of a font: letters, digits, spaces, lines below and hyphens of it."""
    said = F.concat(F.substring("text", 1, 200), F.lit('"; } é_中-x'))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(C.font_name(said).cast("binary")).alias("name"))


def shaded(c: str) -> str:
    return f"CASE WHEN s IS NULL THEN {c} ELSE CAST(floor(CAST(CAST({c} AS FLOAT) * (CAST(1 AS FLOAT) - CAST(s AS FLOAT) / CAST(255 AS FLOAT)) AS FLOAT) + CAST(0.5 AS FLOAT)) AS INTEGER) END"


def tinted(c: str) -> str:
    return f"CASE WHEN t IS NULL THEN {c} ELSE CAST(floor(CAST({c} AS FLOAT) + (CAST(255 AS FLOAT) - CAST({c} AS FLOAT)) * (CAST(t AS FLOAT) / CAST(255 AS FLOAT)) + CAST(0.5 AS FLOAT)) AS INTEGER) END"


@query(f"""
WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS own, CASE WHEN p_partkey % 5 < 3 THEN p_size * 4 END AS t, CASE WHEN p_partkey % 4 < 2 THEN p_size * 3 END AS s,
  ['FFFFFF', '000000', 'E7E6E6', '44546A', '4472C4', 'ED7D31', 'A5A5A5', 'FFC000', '5B9BD5', '70AD47', '0563C1', '954F72'][p_partkey % 14 + 1] AS h FROM part),
b AS (SELECT *, CAST('0x' || h[1:2] AS INTEGER) AS r, CAST('0x' || h[3:4] AS INTEGER) AS g, CAST('0x' || h[5:6] AS INTEGER) AS b FROM p),
d AS (SELECT k, own, t, {", ".join(f"{shaded(c)} AS {c}" for c in "rgb")} FROM b), l AS (SELECT k, own, {", ".join(f"{tinted(c)} AS {c}" for c in "rgb")} FROM d)
SELECT k AS doc_id, coalesce(own, r) AS r, CASE WHEN own IS NULL THEN g ELSE 7 END AS g, CASE WHEN own IS NULL THEN b ELSE 9 END AS b FROM l
""")
def resolved_colors(spark, sf_dir):
    """Entries with a color of their own, ones of the theme with or without shade and tint, and ones of neither."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("int")
    own = F.when(k % 3 == 0, F.struct(s.alias("r"), F.lit(7).alias("g"), F.lit(9).alias("b")))
    color = C.resolved_color(own, (k % 14).cast("int"), F.when(k % 5 < 3, s * 4), F.when(k % 4 < 2, s * 3))
    return read(spark, sf_dir, "part").select(k.alias("doc_id"), color.alias("c")).select("doc_id", "c.r", "c.g", "c.b")
