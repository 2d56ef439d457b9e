"""The data source and sink of files, and functions in SQL."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from scrivel import sql
from scrivel.operators import parse as P
from scrivel.operators.render import convert_to_html
from scrivel.sources.datasource import RtfFiles, as_documents


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    spark.dataSource.register(RtfFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = tmp_path_factory.mktemp("files")
    (path / "sub").mkdir()
    (path / "a.rtf").write_text("{\\rtf1 a}")
    (path / "sub" / "b.rtf").write_text("{\\rtf1 bbb\\par c}")
    (path / "bad.rtf").write_bytes(b"{\\rtf1 \xff}")
    (path / "big.rtf").write_text("{\\rtf1 " + "x" * 200 + "}")
    (path / "other.txt").write_text("no")
    yield str(path)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_files_and_their_errors(spark, files):
    df = spark.read.format("rtf_files").option("limit_bytes", 100).option("part_bytes", 20).load(files)
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.rtf, r.read_error) for r in df.collect()}
    assert got == {"a.rtf": (9, "{\\rtf1 a}", None), "b.rtf": (17, "{\\rtf1 bbb\\par c}", None), "bad.rtf": (9, None, "invalid_utf8"), "big.rtf": (208, None, "input_too_large")}
    assert df.rdd.getNumPartitions() == 3
    parsed = P.parse(as_documents(df))
    assert sorted(r.error_type for r in P.failures(parsed).collect()) == ["input_too_large", "invalid_utf8"]
    html = {r.doc_id.rsplit("/", 1)[1]: r.error_type for r in convert_to_html(as_documents(df)).collect()}
    assert html == {"a.rtf": None, "b.rtf": None, "bad.rtf": "invalid_utf8", "big.rtf": "input_too_large"}


def test_filters_reach_the_files(spark, files):
    df = spark.read.format("rtf_files").load(files).where((F.col("size") > 10) & F.col("path").endswith("b.rtf") & (F.length("rtf") > 1))
    assert [r.rtf for r in df.collect()] == ["{\\rtf1 bbb\\par c}"]
    said = io.StringIO()
    with redirect_stdout(said):
        df.explain("formatted")
    assert "PushedFilters: [GreaterThan(size,10), StringEndsWith(path,b.rtf)]" in said.getvalue()


def test_new_files_as_a_stream(spark, files, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.rtf").write_text("{\\rtf1 a}")
    q = spark.readStream.format("rtf_files").load(str(tmp_path / "in")).select("path", "rtf").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (tmp_path / "in" / "b.rtf").write_text("{\\rtf1 b}")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.rtf for r in spark.table("arrived").collect()) == ["{\\rtf1 a}", "{\\rtf1 b}"]


def test_sink_shows_all_or_nothing(spark, files, tmp_path):
    out = tmp_path / "out"
    docs = spark.range(40).selectExpr("concat('d', id % 3, '/', id, '.rtf') AS path", "CAST(0 AS BIGINT) AS size", "CAST(0 AS BIGINT) AS modified", "concat('{\\\\rtf1 ', id, '}') AS rtf", "CAST(NULL AS STRING) AS read_error").repartition(4)
    broken = docs.withColumn("rtf", F.when(F.col("path").endswith("/17.rtf"), F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("rtf")))
    with pytest.raises(Exception, match="killed"):
        broken.write.format("rtf_files").mode("append").save(str(out))
    assert not list(out.rglob("*.rtf")) and not list(out.glob("_writing*"))
    docs.write.format("rtf_files").mode("append").save(str(out))
    assert len(list(out.rglob("*.rtf"))) == 40 and not list(out.glob("_writing*")) and (out / "d2" / "17.rtf").read_text() == "{\\rtf1 17}"
    assert spark.read.format("rtf_files").load(str(out)).count() == 40
    with pytest.raises(Exception, match="exist already"):
        docs.write.format("rtf_files").mode("append").save(str(out))


def test_functions_in_sql(spark):
    sql.register(spark)
    row = spark.sql("SELECT rtf_color('zz') AS none, rtf_color('0a0B0c').b AS b, rtf_theme(4) AS t, rtf_theme(12) AS beyond, rtf_escape_css(concat('a', char(0), '''')) AS css, rtf_pixels(31) AS px, rtf_tint(NULL, 3) AS nothing").first()
    assert (row.none, row.b, row.t, row.beyond, row.css, row.px, row.nothing) == (None, 12, "4472C4", None, "a\\'", 2, None)
    docs = spark.createDataFrame([(1, "{\\rtf1 a{\\b b}\\par c}"), (2, "{\\rtf1 x"), (3, None)], "id int, rtf string")
    ask = lambda q: sorted(tuple(r) for r in spark.sql(q, docs=docs).collect())
    assert ask("SELECT id, p.ord, p.text FROM {docs}, LATERAL rtf_paragraphs(rtf) p WHERE id = 1") == [(1, 0, "ab"), (1, 1, "c")]
    assert ask("SELECT id, max(t.depth) FROM {docs}, LATERAL rtf_tokens(rtf) t GROUP BY id") == [(1, 2), (2, 1)]
    assert ask("SELECT id, i.text, i.bold FROM {docs}, LATERAL rtf_inlines(rtf) i") == [(1, "a", False), (1, "b", True), (1, "c", False)]
    assert ask("SELECT id, e.error_type FROM {docs}, LATERAL rtf_errors(rtf) e") == [(2, "unbalanced_groups")]
