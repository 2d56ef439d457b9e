"""From raw documents to packed sequences: the stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
documents. All but the last return the columns of documents; n_chars follows a text that a stage changes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.llm.common import filtered, replaced, run_dir, scratch, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def changed(found: DataFrame, text: Column) -> DataFrame:
    """Rows with spans get the new text, and its length; others stay as they are."""
    clean = F.size("spans") == 0
    return found.withColumn("text", F.when(clean, F.col("text")).otherwise(text)).withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(F.length("text").cast("long")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds toxic go."""
    from scrivel.llm.toxicity import toxicity, train

    model = train(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model, keep=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that with the smallest id, rows without an id last, of those the smallest digest of its text.

    Rows with the same id and different texts are rows of their own. Of rows alike in id and text, the smallest in the other columns stays.
    """
    from scrivel.llm.near_copies import digest, near_copies

    docs = docs.select(*COLUMNS, digest(F.col("text")).alias("digest"))
    named = (F.col("row.doc_id").alias("id"), F.col("row.digest").alias("of"))
    with scratch(spark):
        rows = written(docs.groupBy("doc_id", "digest").agg(F.count("*").alias("n")), "rows")
        labels = near_copies(docs).withColumnRenamed("node", "digest")
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
        groups = written(rows.join(labels, "digest", "left").select(order.alias("row"), "n", F.coalesce("label", "digest").alias("component")), "groups")
        first = written(groups.groupBy("component").agg(F.min("row").alias("first"), F.count("*").alias("size")).where("size > 1").drop("size"), "first")
        gone = written(groups.join(first, "component").where("row <> first").select(*named), "gone", outer=True)
        again = written(groups.where("n > 1").select(*named).join(gone.withColumnsRenamed({"id": "gone_id", "of": "gone_of"}), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("of") == F.col("gone_of")), "left_anti"), "again", outer=True)
    key = F.xxhash64("id", "of").alias("key")
    rows = filtered(docs.withColumn("key", F.xxhash64("doc_id", "digest")), "key", gone.select(key).union(again.select(key)))
    sure, asked = rows.where("NOT may").select(*COLUMNS), rows.where("may").drop("may", "key")  # most rows aren't shuffled
    same = lambda other: F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))
    kept = asked.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return sure.unionByName(kept.select(*COLUMNS))
    least = asked.join(again, same(again), "left_semi").groupBy("doc_id", "digest").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return sure.unionByName(kept.join(again, same(again), "left_anti").select(*COLUMNS)).unionByName(least)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go. In those that hold a little of it, below the bound, the spans of its words are cut."""
    from scrivel.llm.decontamination import contamination

    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:]).where(~F.col("contaminated"))
    return changed(found, replaced(F.col("text"), F.col("spans"), "")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    from scrivel.llm.secret_scan import Ledger, redacted, scan

    found = scan(docs.select(*COLUMNS), Ledger(spark, f"{run_dir(spark)}/ledger-{uuid.uuid4().hex}"), path_col="doc_id")
    return changed(found, redacted(F.col("text"), F.col("spans"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, packed into windows."""
    import public_tokenizers

    from scrivel.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination), ("secret_scans", secrets), ("packing", packing)]
#: Training and packing can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
