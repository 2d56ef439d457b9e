"""A content-addressed web archive: payload bytes once under their SHA-256, exact record headers apart, records through a join.

Every record has an id of its own, a date, and its page's id in a field of ours, percent-encoded, so that ids of any type and
with any character come back; a revisit names the record that it refers to by that record's id, and by its page.

An archive grows by further calls: payloads that it holds are not stored again, and new records of a payload that has a response
revisit that one, whatever their ids, as records once written stay as they are. A call that broke off is repeated: what it stored
of payloads is found there.

Defined cases: a null payload is empty; of equal payloads of `least` bytes or more, the records with the smallest id are
responses and the others revisit them; smaller payloads are all responses, and stored once all the same; a record without an
id comes after all others; a null url has no field, an empty one an empty field; repeated rows are repeated records, each with
its own record id; an empty table gives an empty archive.
"""

from __future__ import annotations

import datetime

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.llm.common import filtered, scratch, written

#: Fixed values of the format.
VERSION, LINE = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Tables of an archive.
PAYLOADS, RECORDS = "digest string, payload binary", "digest string, header binary"
#: Fields of ours.
PAGE, PAGE_TYPE, REFERS = "Scrivel-Page-ID", "Scrivel-Page-ID-Type", "Scrivel-Refers-To-Page-ID"


def one_line(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")


def field(name: str, value: Column) -> Column:
    """A header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))


def value(name: str) -> Column:
    """What the field of a header says, null where it isn't there."""
    return F.get(F.regexp_extract_all(F.decode("header", "UTF-8"), F.lit(rf"\r\n{name}: ([^\r\n]*)\r\n"), F.lit(1)), F.lit(0))


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A table of an archive, None where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def record_id(call: str, row: Column) -> Column:
    """The id of a call's record, of the custom version of uuids."""
    h = F.md5(F.concat(F.lit(call), row.cast("string")).cast("binary"))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12)), F.lit(">"))


def header_block(record: DataFrame, date: str) -> Column:
    """The header of a record, up to and with the empty line. Content-Length is of the record's own block: none for a revisit."""
    revisit = F.col("record_type") == "revisit"
    id_type = record.schema["page_id"].dataType.simpleString()
    return F.concat(
        F.lit(VERSION + LINE),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", one_line(F.col("url"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field(PAGE_TYPE, F.lit(id_type)),
        field(PAGE, F.url_encode(F.col("page_id").cast("string"))),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{LINE}"), field("WARC-Refers-To", F.col("refers_to_record")), field(REFERS, F.url_encode(F.col("refers_to").cast("string"))))).otherwise(""),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit(LINE),
    )


def write_archive(pages: DataFrame, path: str, least: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: datetime.datetime | None = None) -> None:
    """Adds to path/payloads (digest, payload) and path/records (digest, header), or begins them. Payloads are shuffled once, by digest; headers never with them.

    `date` (now, if none is given) is the date of every record. Ids of another type than those of the archive are an error.
    """
    with scratch(pages.sparkSession):
        add(pages, path.rstrip("/"), least, id_col, url_col, payload_col, (date or datetime.datetime.now(datetime.UTC)).astimezone(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))


def add(pages: DataFrame, path: str, least: int, id_col: str, url_col: str, payload_col: str, stamp: str) -> None:
    spark, kind, call = pages.sparkSession, pages.schema[id_col].dataType.simpleString(), uuid.uuid4().hex
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    fresh, old = rows, stored(spark, f"{path}/records", RECORDS)
    if old is not None and (one := old.select(value(PAGE_TYPE).alias("t")).first()) and one.t != kind:
        raise ValueError(f"the archive has ids of type {one.t}, the pages of type {kind}")
    if (payloads := stored(spark, f"{path}/payloads", PAYLOADS)) is not None:  # of payloads that it holds, digests alone are shuffled
        new = written(rows.select("digest").distinct().join(payloads.select("digest"), "digest", "left_anti"), "new")
        fresh = filtered(rows, "digest", new).where("may").select("digest", "payload").join(new, "digest", "left_semi")
    fresh.groupBy("digest").agg(F.first("payload").alias("payload")).write.mode("append").parquet(f"{path}/payloads")
    sized = written(rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"), F.monotonically_increasing_id().alias("row")), "sized")  # from here on, no payload is read or hashed again
    sized = sized.withColumn("record_id", record_id(call, F.col("row")))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id")))
    firsts = sized.where(F.col("size") >= least).groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).withColumn("before", F.lit(False))
    if old is not None:
        held = old.where((value("WARC-Type") == "response") & (value("Content-Length").cast("long") >= least) & value(PAGE).isNotNull())
        known = held.groupBy("digest").agg(F.min(F.struct(F.url_decode(value(PAGE)).cast(kind).alias("page_id"), value("WARC-Record-ID").alias("record_id"))).alias("first"))
        both = firsts.unionByName(known.select("digest", "first", F.lit(0).cast("long").alias("n"), F.lit(True).alias("before")))
        firsts = both.groupBy("digest").agg(F.max_by("first", "before").alias("first"), F.sum("n").alias("n"), F.max("before").alias("before")).where("n > 0")
    firsts = written(firsts.where("n > 1 OR before").drop("n"), "firsts")
    revisits = F.col("first").isNotNull() & (F.col("before") | F.col("page_id").isNull() | (F.col("page_id") > F.col("first.page_id")))
    typed = sized.join(firsts, "digest", "left").withColumn("record_type", F.when(revisits, "revisit").otherwise("response"))
    typed = typed.withColumns({"refers_to": F.when(revisits, F.col("first.page_id")).cast(kind), "refers_to_record": F.when(revisits, F.col("first.record_id"))})
    typed.select("digest", header_block(typed, stamp).cast("binary").alias("header")).write.mode("append").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str, id_type: str | None = None) -> DataFrame:
    """(page_id, url, record_type, refers_to, digest, header, payload) of each record, rebuilt by a join. Ids have the type that the records name, or `id_type`. A payload that isn't what its digest says raises an error."""
    payloads = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    true = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("digest"))).cast("binary"))
    records = spark.read.schema(RECORDS).parquet(f"{path}/records")
    if id_type is None:
        one = records.select(value(PAGE_TYPE).alias("t")).first()
        id_type = one.t if one else "bigint"
    parsed = records.select(
        "digest", "header", F.url_decode(value(PAGE)).cast(id_type).alias("page_id"), value("WARC-Target-URI").alias("url"), value("WARC-Type").alias("record_type"), F.url_decode(value(REFERS)).cast(id_type).alias("refers_to"),
    )
    return parsed.join(payloads.select("digest", true.alias("payload")), "digest").select("page_id", "url", "record_type", "refers_to", "digest", "header", "payload")


def record_bytes(records: DataFrame) -> Column:
    """A record as it stands in a WARC file: header, own block (none for a revisit), two line ends."""
    return F.concat(F.col("header"), F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")), F.lit((LINE * 2).encode()))
