"""Incremental secret scans over a ledger of content-addressed blobs, with DataFrame functions alone.

Every version of a text is a blob named by the SHA-256 of its bytes. The ledger holds which blobs were scanned under which
version of the rules, what was found, and which paths ever held which blob; a run scans only pairs that aren't in it, each blob
once however many paths hold it, and joins findings back to all paths. Names of blobs are compared first: of known blobs no
text is shuffled.

Defined cases: a null text is empty; ids may be null or repeated, each row gets its blob's findings; matches of one rule don't
overlap, those of different rules may; an empty table gives no rows and leaves the ledger as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivel.llm.common import filtered, replaced, scratch, sha256_hex, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches of a pattern, kept if a group of the match has enough characters."""

    kind: str
    pattern: str
    group: int
    least: int


#: Kinds in the order in which findings at the same place are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)


def version_of(rules: tuple[Rule, ...]) -> str:
    """The name under which a ledger keeps what these rules found: it changes with any part of any rule, and with their order."""
    return sha256_hex(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]))[:24]


FOUND = "blob string, rules string, kind int, start long, end long"


def blob_id(text: str | Column) -> Column:
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"), 256)


class Ledger:
    """Three Parquet tables below a shared path: scanned (blob, rules), found (blob, rules, kind, start, end) and versions (path, blob)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing has been written yet

    def scanned(self) -> DataFrame:
        return self.table("scanned", "blob string, rules string")

    def found(self) -> DataFrame:
        return self.table("found", FOUND)

    def add(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
        """Scans the blobs of docs that weren't scanned by these rules. Findings are written first, so a run that breaks off is repeated, not lost; findings that were then written twice are read once."""
        version = version_of(rules)
        with scratch(self.spark):
            seen = self.scanned().where(F.col("rules") == version).select("blob")
            blobs = docs.select(blob_id(text_col).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            new = written(blobs.select("blob").distinct().join(seen, "blob", "left_anti"), "new")
            if new.isEmpty():
                return
            # the filter lets few known blobs through; of the others only texts that some rule matches are shuffled, to be joined exactly and taken apart once each
            flags = [f"has_{i}" for i in range(len(rules))]
            likely = filtered(blobs, "blob", new.select("blob")).where("may").select("blob", "text", *(F.col("text").rlike(r.pattern).alias(f) for r, f in zip(rules, flags, strict=True)))
            hit = likely.where(" OR ".join(flags)).groupBy("blob").agg(*(F.first(c).alias(c) for c in ("text", *flags)))
            self.taken_apart(hit.join(new, "blob", "left_semi"), rules, version).write.mode("append").parquet(f"{self.path}/found")
            new.select("blob", F.lit(version).alias("rules")).write.mode("append").parquet(f"{self.path}/scanned")

    def taken_apart(self, blobs: DataFrame, rules: tuple[Rule, ...], version: str) -> DataFrame:
        """Rows of found, for each of the blobs (blob, text, and has_i for each rule)."""
        parts = F.array(*(F.when(F.col(f"has_{i}"), pieces(r, i)) for i, r in enumerate(rules)))
        hit = blobs.select("blob", F.explode(F.flatten(F.filter(parts, lambda x: x.isNotNull()))).alias("m")).select("blob", "m.*")
        before = Window.partitionBy("blob", "kind").orderBy("i")
        end = F.sum(F.col("gap") + F.col("size")).over(before.rowsBetween(Window.unboundedPreceding, 0))
        return hit.withColumn("end", end).where("kept").select("blob", F.lit(version).alias("rules"), "kind", (F.col("end") - F.col("size")).alias("start"), "end")

    def versions(self) -> DataFrame:
        return self.table("versions", "path string, blob string").distinct()

    def record(self, docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> None:
        """Keeps which blob each path holds now, beside those that it held before."""
        now = docs.select(F.col(path_col).cast("string").alias("path"), blob_id(text_col).alias("blob")).distinct()
        known = self.versions().withColumnsRenamed({"path": "known_path", "blob": "known_blob"})
        now.join(known, F.col("path").eqNullSafe(F.col("known_path")) & (F.col("blob") == F.col("known_blob")), "left_anti").write.mode("append").parquet(f"{self.path}/versions")

    def history(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(path, blob, spans): findings of every version that any recorded path ever held."""
        return self.versions().join(self.findings(rules), "blob").select("path", "blob", "spans")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, spans) of the blobs with findings: an array of (start, kind, end), in that order."""
        rows = self.found().where(F.col("rules") == version_of(rules)).select("blob", "start", "kind", "end").distinct()
        return rows.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def pieces(rule: Rule, kind: int) -> Column:
    """Of each match: its number, the characters between it and the one before, its own, and whether it is kept. What a split leaves between matches tells where they are."""
    whole = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(whole))
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part"))
    one = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["whole"]).cast("long").alias("size"), (F.length(x["part"]) >= rule.least).alias("kept"))
    return F.transform(zipped, one)


def scan(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """docs with `spans`, the findings of each row's text (empty if there are none): an array of (start, kind, end) in code points, the end exclusive; kind is the rule's number. A column `spans` of docs is replaced.

    Rows are joined with findings by blob. A bit filter of fixed size, which is broadcast, tells most rows without findings
    beforehand: their columns aren't shuffled. path_col: the ledger also records that each path holds its text now.
    """
    ledger.add(docs, rules, text_col)
    if path_col:
        ledger.record(docs, path_col, text_col)
    found = written(ledger.findings(rules), "findings").select(F.col("blob").alias("scan_blob"), F.col("spans").alias("scan_spans"))
    kept = [c for c in docs.columns if c != "spans"]
    # whatever the columns of docs are called, they don't clash
    rows = docs.select(blob_id(text_col).alias("scan_key"), *(F.col(c).alias(f"in_{i}") for i, c in enumerate(kept)))
    marked = filtered(rows, "scan_key", found.select("scan_blob"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    held = marked.where("may").join(found, F.col("scan_key") == F.col("scan_blob"), "left").withColumn("spans", F.coalesce("scan_spans", none))
    out = marked.where("NOT may").withColumn("spans", none).select(*(f"in_{i}" for i in range(len(kept))), "spans").union(held.select(*(f"in_{i}" for i in range(len(kept))), "spans"))
    return out.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(kept)), "spans")


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; spans that overlap are one."""
    return replaced(text, spans, mark)
