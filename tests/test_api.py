import json

import pytest

import scrivel
from scrivel import api, cli
from scrivel.operators import parse as P
from scrivel.sources import sinks


def test_parse_and_write():
    d = scrivel.parse("{\\rtf1 {\\b x}\\nosuch }")
    assert d.stats["run_count"] == 1 and d.warnings_of("warning") and not d.has_errors and json.loads(d.to_json()) == d.to_dict()
    assert "<strong>x</strong>" in api.to_html(d, wrapper=False) and api.to_docx_bytes(d)[:2] == b"PK" and api.to_pdf(d)[:4] == b"%PDF"
    assert "nosuch" in api.report_text(d) and json.loads(api.report_json(d))["stats"]["duration_ms"] == 0
    with pytest.raises(scrivel.ParseError) as e:
        scrivel.parse("x")
    assert e.value.kind == "missing_rtf_header"
    with pytest.raises(scrivel.WriterError):
        api.to_pdf(d, "a9")
    assert scrivel.Parser(scrivel.Limits.unlimited()).parse("{\\rtf1 " + "{" * 300 + "x" + "}" * 300 + "}").stats["run_count"] == 1


def test_exit_codes(tmp_path, capsys):
    doc, bad, dropped = tmp_path / "a.rtf", tmp_path / "b.rtf", tmp_path / "c.rtf"
    doc.write_text("{\\rtf1 x}")
    bad.write_text("x")
    dropped.write_text("{\\rtf1 {\\obj x}y}")
    run = lambda *a: cli.main(["convert", *map(str, a)])
    out = tmp_path / "a.html"
    assert run(doc) == 0 and "paragraph_count: 1" in capsys.readouterr().out
    assert run(doc, "-o", out) == 0 and "x" in out.read_text()
    assert run(doc, "-o", out) == 3 and run(doc, "-o", out, "--force") == 0
    assert run(doc, "-o", out, "--to", "pdf") == 2 and run(doc, "--profile", "nosuch") == 2 and run(bad) == 2 and run(tmp_path / "none.rtf") == 3
    assert run(dropped) == 0 and run(dropped, "--strict", "--emit-ir", tmp_path / "c.json") == 4 and (tmp_path / "c.json").exists()
    for name in ("a.docx", "a.pdf", "a.typ"):
        assert run(doc, "-o", tmp_path / name, "--page-size", "100x200", "--docx-profile", "--page-numbers", "always") == 0
    assert b"/MediaBox [0 0 283.46 566.93]" in (tmp_path / "a.pdf").read_bytes()
    assert run(doc, "-o", tmp_path / "none" / "a.pdf") == 3 and run(doc, "-o", tmp_path, "--to", "pdf") == 3 and run(doc, "-o", tmp_path / "b.pdf", "--page-size", "a9") == 2
    picture = tmp_path / "p.rtf"
    picture.write_text("{\\rtf1 {\\pict\\jpegblip 00}x}")
    assert run(picture, "-o", tmp_path / "p.pdf", "--strict") == 4 and run(picture, "-o", tmp_path / "p.docx", "--strict") == 4 and run(picture, "-o", tmp_path / "p.odd", "--to", "pdf", "--verbose") == 0


def test_errors_and_warnings_of_writers():
    d = scrivel.parse("{\\rtf1 {\\pict\\jpegblip 00}{\\endnote n}x}")
    for error, write in ((api.HtmlWriterError, lambda: api.to_html(d, profile="x")), (api.DocxWriterError, lambda: api.to_docx_bytes(d, "x")), (api.PdfRenderError, lambda: api.to_pdf(d, (0, 1))), (api.TypstWriterError, lambda: api.to_typst(d, numbering="x")), (api.ReportError, lambda: api.report_json(api.Document({}, [{"type": {1}}])))):
        with pytest.raises(error):
            write()
        assert issubclass(error, api.ScrivelError)
    more = api.with_mapping_warnings(d, api.to_pdf_with_warnings(d)[1])
    assert [(w["type"], w["reason"]) for w in more.warnings[len(d.warnings) :]] == [("dropped_content", "Dropped malformed JPEG image payload"), ("partial_support", "partial_support_endnote_ref")]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "{\\rtf1 a{\\b b}\\nosuch }"), (2, "x")], "doc_id long, rtf string")
    parsed = P.parse(docs)
    sinks.write_tables(parsed, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t/inlines").count() == 2 and spark.read.parquet(f"{tmp_path}/t/failures").count() == 1
    sinks.write_ir(parsed, f"{tmp_path}/ir")
    assert [json.loads(r.value)["doc_id"] for r in spark.read.text(f"{tmp_path}/ir").collect()] == [1]
    sinks.write_reports(parsed, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").select("stats.run_count").first()[0] == 2
    with pytest.raises(Exception, match="already exists"):
        sinks.write_reports(parsed, f"{tmp_path}/r")
