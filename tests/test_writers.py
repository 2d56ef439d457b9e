import io
import zipfile
import zlib
from xml.dom import minidom

from scrivel.parser.reader import FLAGS, Reader
from scrivel.render import pictures, styles
from scrivel.render.docx import docx, extent
from scrivel.render.grid import borders, fill, rowspans
from scrivel.render.html import css_string, escape, html
from scrivel.render.pdf import pdf, pdf_text, roman, split_alpha
from scrivel.render.typst import kind_of, typst, typst_with_warnings

BODY = (
    "{\\header top}{\\b\\fs28 1 Head}\\par a{\\footnote n}{\\field{\\*\\fldinst HYPERLINK \"https://x.y/?a=1&b\"}{\\fldrslt l<k}}\\par "
    "\\trowd\\clvmgf\\clbrdrb\\brdrs\\brdrw4\\cellx100\\cellx300 p\\cell q\\cell\\row\\trowd\\clvmrg\\cellx100\\cellx300 \\cell s\\cell\\row\\pard {\\pict\\pngblip 89504e47}"
)


def document(body=BODY):
    return Reader().read("{\\rtf1 " + body + "}")["document"]


def test_html():
    out, reasons = html(document(), wrapper=False)
    assert '<header class="rtf-header-footer rtf-header-default">' in out and '<a href="https://x.y/?a=1&amp;b" class="rtf-link">l&lt;k</a>' in out
    assert '<td rowspan="2" style="width: 5.0pt; border-bottom: 2.0pt solid currentColor;">' in out and not reasons
    assert html(document())[0].startswith("<!doctype html>") and html(document("a"), profile=None, custom_css="p{}")[0].count("<style>") == 1
    assert escape("<'\"&>") == "&lt;&#39;&quot;&amp;&gt;" and css_string("a'\n") == "a\\'\\A "


def test_levels_that_jump_are_cut():
    head = "{\\*\\listtable{\\list{\\listlevel\\levelnfc23}\\listid1}}{\\*\\listoverridetable{\\listoverride\\listid1\\ls1}}"
    out, reasons = html(document(head + "\\ls1 a\\par\\ls1\\ilvl3 b\\par\\ls1 c\\par"), wrapper=False)
    assert reasons == ["list_nesting_semantics"] and out.count("<ul") == out.count("</ul>") == 2 and out.count("<li>") == out.count("</li>") == 3


def test_grid():
    t = next(b for b in document()["blocks"] if b["type"] == "tableblock")
    assert rowspans(t) == [[2, 1], [0, 1]] and borders(t, 0, 0)["bottom"]["width_half_pts"] == 4 and "top" not in borders(t, 1, 0)
    assert fill({"fill_color": {"r": 255, "g": 255, "b": 255}, "pattern": "percent25"}) == {"r": 191, "g": 191, "b": 191}


def test_docx():
    data, _ = docx(document())
    z = zipfile.ZipFile(io.BytesIO(data))
    assert {"word/document.xml", "word/footnotes.xml", "word/header_default.xml", "word/media/image1.png", "[Content_Types].xml"} <= set(z.namelist())
    for name in z.namelist():
        if name.endswith((".xml", ".rels")):
            minidom.parseString(z.read(name))
    assert b"<w:vMerge/>" in z.read("word/document.xml") and docx(document())[0] == data


def test_typst_and_pdf():
    out, _ = typst(document("a\\par [x]*_$\\par"))
    assert "\\[x\\]\\*\\_\\$" in out and "#set page(width: 210mm, height: 297mm" in out
    data, reasons = pdf(document(), "letter")
    assert data.startswith(b"%PDF-") and reasons == ["Dropped malformed PNG image payload"] and b"/MediaBox [0 0 612.00 792.00]" in data
    assert pdf_text(data) == [["1", "Head", "a", "1", "l<k", "p", "q", "s", "1", "n", "top"]]


def test_profiles():
    assert not any(styles.problems(p) for p in styles.PROFILES.values()) and styles.profile(" Report ") is styles.REPORT
    assert [styles.profile(n)["space"]["table-cell-padding-y"] for n in styles.NAMES] == [2.0, 5.0, 2.0] and {k: len(v) for k, v in styles.REPORT.items() if k != "name"} == {"color": 8, "type": 13, "space": 9, "layout": 5, "component": 11}
    bad = styles.changed("compact", color={"text_muted": "red"}, type={"size_body": 0, "line_height_body": 0.5}, layout={"page_margin_top": -1.0}, component={"list_marker_gap": -2.0})
    assert len(styles.problems(bad)) == 5
    sheet = styles.css(styles.profile("classic"))
    assert '--doc-font-body: "Libertinus Serif";' in sheet and "--doc-page-margin-top: 25.4mm;" in sheet and "--doc-table-stripe-fill: transparent;" in sheet and "--doc-table-header-emphasis: true;" in sheet
    source = styles.typst(styles.profile("compact"))
    assert "size: 9pt" in source and "fill: (x, y)" not in source and "indent: 12pt, body-indent: 4pt, spacing: 2pt" in source


def png(wide=2, high=3, color=2, interlaced=0, rows=None):
    part = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    channels = pictures.CHANNELS[color]
    rows = rows if rows is not None else b"".join(b"\0" + bytes(range(10 * k, 10 * k + wide * channels)) for k in range(high))
    head = wide.to_bytes(4, "big") + high.to_bytes(4, "big") + bytes((8, color, 0, 0, interlaced))
    palette = part(b"PLTE", bytes(range(30))) if color == 3 else b""
    return pictures.SIGNATURE + part(b"IHDR", head) + palette + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def jpeg(wide=7, high=5):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + high.to_bytes(2, "big") + wide.to_bytes(2, "big") + b"\x01\x01\x11\x00\xff\xd9"


def test_pictures():
    assert pictures.size("png", png()) == (2, 3) and pictures.size("jpeg", jpeg()) == (7, 5)
    for broken in (b"", png()[:-3], png(rows=b"\0"), png()[:40] + b"x" + png()[41:], jpeg()[:-2], jpeg()[:8]):
        assert pictures.size("png" if broken[:1] == b"\x89" else "jpeg", broken) is None
    picture = lambda data, kind="png", more="": "{\\pict\\%sblip%s %s}" % (kind, more, data.hex())
    sizes = {"": (2 * 9525, 3 * 9525), "\\picwgoal1000": (635_000, 952_500), "\\pichgoal300": (127_000, 190_500), "\\picwgoal10\\pichgoal20": (6350, 12_700)}
    for more, want in sizes.items():
        assert extent(document(picture(png(), more=more))["blocks"][0]) == want
    assert extent(document(picture(b"\x00", "png"))["blocks"][0]) == (914_400, 914_400)
    data, reasons = docx(document(picture(jpeg()[:-2], "jpeg")))
    assert reasons == ["Dropped malformed JPEG image payload"] and not any("media" in n for n in zipfile.ZipFile(io.BytesIO(data)).namelist())
    for kind in (0, 2, 3, 4, 6):
        data, warnings = pdf(document(picture(png(color=kind))))
        assert not warnings and b"/Subtype /Image" in data and (b"/SMask" in data) == (kind in (4, 6))
    assert b"/DCTDecode" in pdf(document(picture(jpeg(), "jpeg")))[0] and b"/DeviceGray" in pdf(document(picture(png(interlaced=1))))[0]


def test_transparency_is_parted():
    rows = b"".join(bytes([how, *range(8)]) for how in (0, 1, 2, 3, 4))
    plain, alpha = split_alpha(pictures.Png(png(2, 5, 6, rows=rows)))
    before, want = [0] * 8, []
    for how in range(5):
        row = []
        for i in range(8):
            a, b, c = row[i - 4] if i >= 4 else 0, before[i], before[i - 4] if i >= 4 else 0
            p = a + b - c
            nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            row.append((i + (0, a, b, (a + b) // 2, nearest)[how]) & 255)
        before = row
        want += row
    assert list(alpha) == want[3::4] and list(plain) == [v for i, v in enumerate(want) if i % 4 != 3]


TABLE = (
    "{\\colortbl;\\red255\\green0\\blue0;}\\trowd\\trqc\\trleft200\\trgaph50\\trrh-400\\trftsWidth2\\trwWidth2500\\clbrdrt\\brdrdb\\brdrw6\\clbrdrl\\brdrdash\\brdrcf1\\clvertalc\\clcbpat1\\clpadl100\\clpadfl3\\cellx1440\\clmgf\\cellx2880\\clmrg\\cellx4320 "
    "\\pard\\intbl a\\cell b\\cell\\cell\\row\\pard end"
).replace("Width", "width")


def test_typst_tables_and_their_warnings():
    out, warnings = typst_with_warnings(document(TABLE))
    assert "columns: (1in, auto, auto)" in out and "rows: (20.0pt,)" in out and "gutter: 5.0pt" in out and "colspan: 2" in out and "#align(center)[" in out and "#pad(left: 10.0pt)[" in out and "#block(width: 25.0%)[" in out
    assert 'stroke: (top: 3.0pt + black, left: (paint: rgb(255, 0, 0), thickness: 0.5pt, cap: "butt", dash: (4.0pt, 2.0pt)))' in out and "inset: (left: 5.0pt)" in out and "fill: rgb(255, 0, 0)" in out
    assert "table.hline(y: 0, start: 0, end: 1, position: bottom, stroke: 3.0pt + black)" in out and "#box(stroke: (top: 3.0pt + black), inset: 1.0pt)[" in out
    assert [c for c, _ in warnings] == ["cell_vertical_align_dropped", "partial_support_exact_row_height", "partial_support_double_border_style"]


def test_mapping_warnings():
    cases = {
        "{\\field{\\*\\fldinst PAGEREF gone \\\\h}{\\fldrslt 7}}": ["unresolved_page_reference_gone"],
        "{\\*\\bkmkstart a b}x{\\*\\bkmkend a b}{\\field{\\*\\fldinst PAGEREF \"a b\" \\\\* roman}{\\fldrslt 7}}": ["partial_support_bookmark_anchor"],
        "{\\field{\\*\\fldinst SECTIONPAGES}{\\fldrslt 1}}": ["partial_support_section_pages"],
        "{\\field{\\*\\fldinst MERGEFIELD n}{\\fldrslt 1}}": ["partial_support_mergefield"],
        "{\\field{\\*\\fldinst REF gone}{\\fldrslt 1}}": ["partial_support_unresolved_cross_reference"],
        "{\\field{\\*\\fldinst HYPERLINK \\\\l x}{\\fldrslt 1}}": ["partial_support_internal_hyperlink"],
        "a{\\endnote n}": ["partial_support_endnote_ref"],
        "{\\headerf h}x": ["partial_support_header_first_even"],
        "{\\pict\\jpegblip 00}": ["Dropped malformed JPEG image payload"],
    }
    for body, want in cases.items():
        codes = typst(document(body))[1]
        assert codes[: len(want)] == want, body
    mixed = {"blocks": [{"type": "listblock", "list_id": 1, "kind": "mixed", "items": [{"level": n, "blocks": [{"type": "paragraph", "alignment": "left", "inlines": [{"type": "run", "text": "x", **dict.fromkeys(FLAGS, False)}]}]} for n in (0, 3)]}]}
    out, codes = typst(mixed)
    assert codes == ["list_mixed_kind_fallback_to_bullet", "list_level_skip_0_to_3"] and "\n- x\n      - x\n" in out
    assert [kind_of(c) for c in codes] == ["dropped_content", "partial_support"]
    striped = {"blocks": [{"type": "paragraph", "alignment": "justify", "shading": {"fill_color": {"r": 1, "g": 2, "b": 3}, "pattern": "horz_stripe"}, "inlines": mixed["blocks"][0]["items"][0]["blocks"][0]["inlines"]}]}
    out, codes = typst(striped)
    assert codes == ["pattern_degraded_paragraph_shading"] and "justify: true" in out and "#highlight(fill: rgb(1, 2, 3))[x]" in out


def test_typst_text():
    out, _ = typst(document("{\\b a}{\\b b}{\\i\\fs25 c}{\\ul\\strike d}"))
    assert "*ab*_#text(size: 12.5pt)[c]_#strike[#underline[d]]" in out
    out, _ = typst(document("{\\header {\\field{\\*\\fldinst PAGE \\\\* ROMAN}{\\fldrslt I}}}x"), size=(100, 200), numbering="never")
    assert '#set page(header: [#context numbering("I", counter(page).get().at(0))])' in out and "width: 100mm, height: 200mm" in out and "numbering: " not in out
    assert 'numbering: "1"' in typst(document("x"), numbering="always")[0] and 'numbering: "i"' in typst(document("\\pgnlcrm{\\field{\\*\\fldinst PAGE}{\\fldrslt 1}}"))[0]


def test_docx_says_what_the_model_holds():
    z = zipfile.ZipFile(io.BytesIO(docx(document("{\\headerf first}{\\headerl even}{\\footer foot}\\pgnlcrm\\pgnstarts4 " + TABLE), "report")[0]))
    body = z.read("word/document.xml").decode()
    for said in ('<w:tblW w:w="2500" w:type="pct"/><w:jc w:val="center"/><w:tblCellSpacing w:w="50" w:type="dxa"/><w:tblInd w:w="200" w:type="dxa"/><w:tblBorders>', '<w:gridCol w:w="1440"/>', '<w:trHeight w:val="400" w:hRule="exact"/>', '<w:top w:val="double" w:sz="24"', '<w:left w:val="dashed" w:sz="8" w:space="0" w:color="FF0000"/>', '<w:gridSpan w:val="2"/>', "<w:titlePg/>", '<w:pgNumType w:fmt="lowerRoman" w:start="4"/>', '<w:headerReference w:type="first"', '<w:headerReference w:type="even"', '<w:tcMar><w:left w:w="100" w:type="dxa"/></w:tcMar>', '<w:vAlign w:val="center"/>'):
        assert said in body, said
    assert "<w:evenAndOddHeaders/>" in z.read("word/settings.xml").decode() and 'w:styleId="Heading3"' in z.read("word/styles.xml").decode()
    toc = docx(document("{\\b\\fs28 1 A}\\par {\\b\\fs28 1.1 B}\\par {\\b\\fs28 2 C}\\par x"))[0]
    body = zipfile.ZipFile(io.BytesIO(toc)).read("word/document.xml").decode()
    assert 'TOC \\o "1-3" \\h' in body and body.count('w:val="Heading1"') == 2 and body.count('w:val="Heading2"') == 1


def test_pdf_pages():
    body = "{\\headerf first}{\\headerl even}{\\headerr odd}{\\footer page {\\field{\\*\\fldinst PAGE}{\\fldrslt 1}} of {\\field{\\*\\fldinst NUMPAGES}{\\fldrslt 1}}}"
    text = "\\par ".join(f"{{\\b line}} {i} {{\\ul under}}" for i in range(150))
    link = "{\\field{\\*\\fldinst HYPERLINK \"http://x.y\"}{\\fldrslt go}}{\\field{\\*\\fldinst PAGEREF far}{\\fldrslt 9}}{\\*\\bkmkstart far}!{\\*\\bkmkend far}"
    data, _ = pdf(document(body + text + "\\par " + link), stamp="2020-01-02T03:04:05Z")
    pages = pdf_text(data)
    n = len(pages)
    assert n > 2 and "first" in pages[0] and "even" in pages[1] and "odd" in pages[2] and pages[1][-4:] == ["page", "2", "of", str(n)] or pages[1][-3:] == ["2", "of", str(n)]
    assert sum(p.count("line") for p in pages) == 150 and str(n) in pages[-1] and b"/URI (http://x.y)" in data and b"(D:20200102030405Z)" in data and b"/Courier-Bold " in data
    assert data == pdf(document(body + text + "\\par " + link), stamp="2020-01-02T03:04:05Z")[0] and [roman(x) for x in (4, 9, 14, 1999)] == ["iv", "ix", "xiv", "mcmxcix"]
    data, _ = pdf(document(TABLE), "a4", "classic", "always")
    assert pdf_text(data)[0][:3] == ["a", "b", "end"] and pdf_text(data)[0][-1] == "1"
    long = pdf_text(pdf(document("x" * 500))[0])[0]
    assert "".join(long) == "x" * 500 and len(long) > 5
