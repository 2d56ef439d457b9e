"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.llm.common import run_dir, table


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivel.llm.warc import read_archive, write_archive

    path = f"{run_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivel.llm.decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from scrivel.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivel.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from scrivel.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivel.llm.secret_scan import RULES, Ledger, listed, scan

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, Ledger(spark, spark.conf.get("spark.scrivel.secrets.ledger", None) or f"{run_dir(spark)}/ledger-{uuid.uuid4().hex}"), path_col="doc_id")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    names = listed(F.col("spans"))
    return found.select("doc_id", *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(RULES)), F.sha2(names, 256).alias("base_sha256"), names.alias("spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivel.llm.substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivel.llm.toxicity import held_out, toxicity, train

    docs = table(spark, sf_dir, "documents")
    found = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivel.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivel.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivel.llm.clustering import k_means

    return k_means(table(spark, sf_dir, "embeddings"), 40)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivel.llm.sharding import shard

    found = shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivel.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")}


OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k(kind, name, pat, grp, least) AS (VALUES
  (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 18), (2, 'hex', '[0-9a-f]{16,}', 0, 16)),
m AS (SELECT r, kind, name, least,
  CASE kind WHEN 0 THEN regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) ELSE regexp_extract_all(t, '[0-9a-f]{16,}', 0) END AS w,
  CASE kind WHEN 0 THEN regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) ELSE regexp_extract_all(t, '[0-9a-f]{16,}', 0) END AS g,
  CASE kind WHEN 0 THEN string_split_regex(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') WHEN 1 THEN string_split_regex(t, 'AKIA[A-Z0-9]+') ELSE string_split_regex(t, '[0-9a-f]{16,}') END AS gaps
  FROM d, k),
u AS (SELECT r, kind, name, least, unnest(w) AS w, unnest(g) AS g, unnest(gaps[1:len(w)]) AS gap, unnest(range(len(w))) AS i FROM m WHERE len(w) > 0),
p AS (SELECT *, sum(length(gap) + length(w)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM u),
s AS (SELECT r, kind, name, e - length(w) AS b, e FROM p WHERE length(g) >= least),
f AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h,
  string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (r)
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, octet_length(encode(t)) AS n, sha256(t) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM q LEFT JOIN f USING (h)
"""


OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
di AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM di),
h AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, g)),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""


FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def rounds_of_k_means(rounds: int = 5) -> str:
    """Lloyd's rounds, one after another, without trees."""
    away = "list_dot_product(e.v, e.v) - 2 * list_dot_product(e.v, c.v) + list_dot_product(c.v, c.v)"
    parts = [
        f"e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) = 64 AND {FINITE})",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM e QUALIFY c < 40)",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, first(c.c ORDER BY {away}, c.c) AS c, min({away}) AS d FROM e, c{i} c GROUP BY r)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, i, sum(CAST(v[i] AS BIGINT)) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, 65)) AS i FROM a{i} JOIN e USING (r)) GROUP BY c, i)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT c, list(CAST((s - (s % n + n) % n) // n AS DOUBLE) ORDER BY i) AS v FROM s{i} GROUP BY c) m USING (c))")
    last = f"a{rounds} JOIN e USING (r) JOIN c{rounds} c USING (c)"
    columns = "e.vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256"
    return f"WITH {', '.join(parts)} SELECT {columns} FROM {last}"


OP13 = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {FINITE}),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON len(a.v) = len(b.v) AND a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS nth FROM s WHERE same QUALIFY nth <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.nth ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (r) WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3)
SELECT anchor_id, vec_id AS positive_id, CAST(rank AS INTEGER) AS rank, negative_id, score AS positive_score, negative_score FROM n
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": OP1, "op3_warc": OP3, "op4_decontamination": OP4, "op11_clustering": rounds_of_k_means(), "op13_hard_negatives": OP13}
