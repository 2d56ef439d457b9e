"""The pipeline's stages, each held against what it may keep and change, on a small corpus."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrivel.llm import near_copies, simhash
from test_documents import labelled, spans_of, words


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    texts, labels = labelled(spark)
    bench = words(40, 77)
    more = [(2000, words(80, 1)), (2001, words(80, 1)), (2002, words(20, 3) + " " + bench), (2003, words(30, 4) + " token=abcdefghijklmnop " + words(30, 5)), (2004, ""), (None, words(50, 6)), (2005, None), (2006, f"{words(300, 8)} {' '.join(bench.split()[:14])}. {words(300, 9)}")]
    docs = texts.unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.repartition(3).write.parquet(f"file://{path}/documents.parquet")
    labels.withColumn("quality", F.lit(1)).write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(f"file://{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{name}")
        out[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in out.items()}
    clean = {i for i in range(900) if i % 4}
    assert len(clean - ids["toxicity"]) <= 5 and len({i for i in range(0, 900, 4)} & ids["toxicity"]) <= 15
    assert 2000 in ids["simhash_near_dedup"] and 2001 not in ids["simhash_near_dedup"] and None in ids["simhash_near_dedup"]
    assert ids["simhash_near_dedup"] >= clean & ids["toxicity"]
    assert ids["simhash_near_dedup"] - ids["benchmark_decontamination"] == {2002}
    assert ids["secret_scans"] == ids["benchmark_decontamination"] == ids["packing"]
    cut = out["benchmark_decontamination"].where("doc_id = 2006").first()
    assert cut.text == f"{words(300, 8)} . {words(300, 9)}" and cut.n_chars == len(cut.text)
    assert all(not spans_of(r.text or "") for r in out["secret_scans"].collect())
    whole = out["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert whole.where("n <> t AND doc_id IS NOT NULL").count() == 0


def test_run_and_an_empty_corpus(spark, corpus, tmp_path):
    assert corpus_pipeline.run(spark, corpus).count() > 600
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_near_copies_that_share_most_shingles_go(spark, tmp_path):
    """Copies with similarity 0.8 or more go, however many bits their fingerprints differ in; others stay. Small and large buckets."""
    def replaced(text, at, word="replaced"):
        w = text.split()
        for i in at:
            w[i] = word
        return " ".join(w)

    def similarity(a, b):
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
        return len(a & b) / len(a | b)

    rows, gone = [], set()
    for k in range(40):
        text = words(200, 70_000 + k)
        near, far = replaced(text, (50, 100, 150)), replaced(text, range(3, 200, 12))
        assert 0.8 <= similarity(text, near) < 1 and similarity(text, far) < 0.8 and similarity(near, far) < 0.8
        rows += [(10 * k, text), (10 * k + 1, near), (10 * k + 2, far)]
        gone.add(10 * k + 1)
    text = words(200, 80_000)
    rows += [(1000 + i, replaced(text, (i,), f"other{i}")) for i in range(150)]
    gone |= set(range(1001, 1150))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()}
    assert kept == {i for i, _ in rows} - gone


def test_near_dedup_decides_by_row(spark):
    """Different texts under one id stay; copies without an id go; which row stays is defined."""
    a, b, c = (words(60, 90_000 + k) for k in range(3))
    rows = [(1, a, "y"), (1, b, "x"), (2, b, "x"), (3, c, "x"), (3, c, "w"), (None, a, "x"), (None, words(60, 91_000), "x"), (None, words(60, 91_000), "w"), (4, words(60, 92_000), "x"), (4, words(60, 93_000), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    kept = [(r.doc_id, r.text, r.lang) for r in corpus_pipeline.near_dedup(spark, docs.repartition(4), "").collect()]
    want = [(1, a, "y"), (1, b, "x"), (3, c, "w"), (None, words(60, 91_000), "w"), (4, words(60, 92_000), "x"), (4, words(60, 93_000), "x")]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_no_link_is_lost_in_large_buckets(spark, monkeypatch):
    """Texts of one template, hundreds of them in every bucket, some of which are near copies of one another: the components are those of a full comparison."""
    r = random.Random(1)
    template = words(120, 95_000).split()

    def changed(text, n, seed):
        text, own = list(text), random.Random(seed)
        for at in own.sample(range(len(text)), n):
            text[at] = f"w{own.randrange(10**9)}"
        return text

    texts = []
    for k in range(220):
        first = changed(template, r.randint(2, 7), 3 * k)
        texts.append(first)
        if k % 2:
            texts.append(changed(first, r.randint(1, 3), 3 * k + 1))
    texts += [changed(template, 1, 10_000 + k) for k in range(30)]
    texts = [" ".join(t) for t in texts]
    sets = [near_copies.shingles(t.encode()) for t in texts]
    prints = [int(simhash.fingerprint(t.encode())) & (1 << 64) - 1 for t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    n_links = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) or (prints[i] ^ prints[j]).bit_count() <= 2:
                label[root(i)] = root(j)
                n_links += 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    named = docs.select("doc_id", near_copies.digest(F.col("text")).alias("node"))
    for shingles in (near_copies.BLOCK_SHINGLES, 1000):
        monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", shingles)
        found = named.join(near_copies.near_copies(docs), "node", "left").select("doc_id", F.coalesce("label", "node").alias("label")).collect()
        of = {x.doc_id: bytes(x.label) for x in found}
        pairs = {(i, j) for i in range(len(texts)) for j in range(i) if root(i) == root(j)}
        assert {(i, j) for i in range(len(texts)) for j in range(i) if of[i] == of[j]} == pairs and len(pairs) > 100 and n_links < 20_000
