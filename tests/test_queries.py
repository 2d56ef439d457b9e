"""Every query against its SQL, and the two ways to read tokens against one another."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from scrivel.operators import analytics as A
from scrivel.operators import parse as P
from scrivel.operators import tokens as T
from scrivel.parser.shown import shown_text
from scrivel.plans import queries as Q
from scrivel.sources import rtf as S


def plain(v):
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", Q.QUERIES)
def test_query(spark, sf_dir, duck, name):
    df = Q.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert got
    if name in Q.ORACLES:
        cur = duck.execute(Q.ORACLES[name])
        at = {d[0]: i for i, d in enumerate(cur.description)}
        assert sorted(at) == names
        assert got == sorted(tuple(plain(r[at[c]]) for c in names) for r in cur.fetchall())


def test_hidden_destinations_of_every_document(spark, sf_dir):
    docs = Q.read(spark, sf_dir, "documents")
    assert docs.where(F.col("text").contains("\n")).count() > 0
    assert Q.QUERIES["destination_skip"](spark, sf_dir).count() == docs.count()


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "{\\rtf1 a\\par b}"), (1, "{\\rtf1 c{\\b d}}"), (None, "{\\rtf1 e}"), (2, None)], "doc_id long, rtf string")
    assert sorted((r.doc_id or 0, r.text) for r in T.plain_text(docs).collect()) == [(0, "e"), (1, "a\nb"), (1, "cd")]
    assert sorted((r.doc_id or 0, r.ord, r.text) for r in T.paragraphs(docs).collect()) == [(0, 0, "e"), (1, 0, "a"), (1, 0, "cd"), (1, 1, "b")]
    assert sorted((r.text, r.bold) for r in T.style_in_force(docs.where("doc_id = 1"), {"b": "bold"}).collect() if r.text != "ab") == [("c", None), ("d", 1)]
    stats = A.text_stats(spark.createDataFrame([(1, "a b"), (1, "c d e c"), (None, "x\n"), (3, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.lines, r.words, r.unique_words, r.most_common_word) for r in stats) == [(0, 1, 1, 1, "x"), (1, 1, 2, 2, "a"), (1, 1, 4, 3, "c"), (3, 0, 0, 0, None)]


def test_visible_text_of_odd_documents():
    for rtf, text in ((r"{\rtf1 \u8364 ?\u-10179?\u-9063?x\u233 \'e9y}", "€💙xéy"), (r"{\rtf1 {\info{\title t}}{\*\odd x{y}}{\*\shppict z}\~\_\{\line w}", "z\u00a0\u2011{\nw"), ("", ""), ("{{\\fonttbl f;}a}}b", "ab")):
        assert shown_text(rtf).replace("\u00a0", " ") == text.replace("\u00a0", " "), rtf


def test_tokens_and_reader_agree(spark, sf_dir):
    docs = Q.encoded_documents(spark, sf_dir)
    a = T.paragraphs(docs).where("text <> ''").select("doc_id", F.md5(F.col("text").cast("binary")).alias("t"))
    b = P.table(P.parse(docs), "nodes").where("node_type = 'paragraph'").select("doc_id", F.md5(F.col("text").cast("binary")).alias("t"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_files(spark, tmp_path):
    (tmp_path / "a.rtf").write_text("{\\rtf1 hello}")
    (tmp_path / "b.rtf").write_bytes(b"{\\rtf1 \xff\xfe}")
    rows = {r.doc_id.rsplit("/", 1)[1]: r for r in S.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.rtf"].rtf == "{\\rtf1 hello}" and rows["b.rtf"].read_error == "invalid_utf8" and rows["b.rtf"].rtf is None
    (tmp_path / "c.rtf").write_text("{\\rtf1 " + "x" * 100 + "}")
    parsed = P.parse(S.read_files(spark, str(tmp_path), limit_bytes=50))
    assert {r.doc_id.rsplit("/", 1)[1]: r.error_type for r in P.failures(parsed).collect()} == {"b.rtf": "invalid_utf8", "c.rtf": "input_too_large"}
    assert sorted(r.status for r in P.status(parsed).collect()) == [0, 2, 3]


def test_failed_documents_have_no_rows(spark):
    docs = spark.createDataFrame([(1, "{\\rtf1 a\\par b}"), (2, "{\\rtf1 a"), (3, None)], "doc_id long, rtf string")
    parsed = P.parse(docs)
    assert {r.doc_id for r in P.failures(parsed).collect()} == {2, 3} and {r.doc_id for r in P.table(parsed, "nodes").collect()} == {1}
    assert {r.doc_id: r.status for r in P.status(parsed).collect()} == {1: 0, 2: 2, 3: 2}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 100 and set(entry.oracle_sql()) <= set(entry.queries())


def test_stream(spark, tmp_path):
    from scrivel.streaming.files import parse_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.rtf").write_text("{\\rtf1 a\\par b}")
    q = parse_stream(spark, str(tmp_path / "in")).select("doc_id", "paragraph_count").writeStream.format("memory").queryName("parsed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.paragraph_count for r in spark.table("parsed").collect()] == [2]


def test_pictures_of_a_group_may_be_more_than_a_document_holds(spark, tmp_path):
    n = 24_000  # of one brand: 12 MB of text
    rows = spark.range(n).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 2 == 0, "even").when(F.col("id") > 5, "odd").otherwise("few").alias("p_brand"), F.lit(50).alias("p_size"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    expected = duckdb.sql(Q.ORACLES["image_budget"].replace("FROM part", f"FROM read_parquet('{tmp_path}/part.parquet/*.parquet') part")).fetchall()
    got = [tuple(r[c] for c in ("doc_id", "total", "failed_at")) for r in Q.QUERIES["image_budget"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expected) and {r[2] for r in got} == {None, 10}


def test_budgets_of_documents_in_parts(spark):
    parts = [(d, p, [(d * 7 + p * 3 + i) % 5 for i in range((p * d) % 4)]) for d in range(1, 9) for p in range(6)]
    images = [(d, p * 10 + i, x) for d, p, sizes in parts for i, x in enumerate(sizes)]
    ranks = {d: {pos: k for k, pos in enumerate(sorted(p for e, p, _ in images if e == d))} for d in range(1, 9)}
    whole = A.within_budget(spark.createDataFrame([(d, ranks[d][pos], x) for d, pos, x in images], "doc_id long, pos long, size long"), 9)
    split = A.within_budget_of_parts(spark.createDataFrame(parts, "doc_id long, part long, sizes array<long>"), 9)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))


def test_long_work_on_short_rows_is_dealt_out(spark, tmp_path):
    spark.range(0, 2000, 1, 1).select(F.col("id").alias("p_partkey"), F.lit(7).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    found = Q.QUERIES["pdf_running_heads"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 4
    assert Q.spread(spark.range(0)).count() == 0
