"""The reader on small documents of our own, with expectations worked out by hand."""

import json

import pytest

from scrivel.limits import Limits
from scrivel.parser import fields
from scrivel.parser.lexer import InvalidDocument, tokens
from scrivel.parser.reader import Reader


def read(body, limits=None, head="\\rtf1\\ansi "):
    return Reader(limits).read("{" + head + body + "}")


def blocks(body, **k):
    return read(body, **k)["document"]["blocks"]


def runs(body, **k):
    return [x for b in blocks(body, **k) for x in b["inlines"]]


def warned(body, **k):
    return [w["type"] for w in read(body, **k)["warnings"]]


def reasons(body):
    return [w["reason"] for w in read(body)["warnings"] if w["type"] == "dropped_content"]


def test_tokens():
    assert [t[:2] for t in tokens("{\\b0 a\\'e9\\~\\'zz}")] == [("open", None), ("word", "b"), ("text", "a"), ("text", "é"), ("symbol", "~"), ("symbol", "'"), ("text", "zz"), ("close", None)]
    assert tokens("{\\u99999999999 }")[1] == ("word", "u", None)
    assert [t[1] for t in tokens("a\nb")] == ["a", "b"]


@pytest.mark.parametrize(("text", "kind"), [("", "empty_input"), ("{\\rtf1", "unbalanced_groups"), ("}", "unmatched_group_end"), ("x", "missing_rtf_header"), ("{\\rtf1 \x00}", "tokenization"), ("{\\b x}", "missing_rtf_header")])
def test_invalid(text, kind):
    with pytest.raises(InvalidDocument) as e:
        Reader().read(text)
    assert e.value.kind == kind


def test_line_ends_a_paragraph_and_empty_ones_vanish():
    assert [b["inlines"][0]["text"] for b in blocks("a\\line b\\par\\par c")] == ["a", "b", "c"]
    assert [r["text"] for r in runs("a\\tab b\\emdash c")] == ["abc"]


def test_style_belongs_to_its_group():
    found = runs("a{\\b b{\\b0 c}d}e\\plain f")
    assert [(r["text"], r["bold"]) for r in found] == [("a", False), ("b", True), ("c", False), ("d", True), ("ef", False)]


def test_unicode():
    assert runs("\\u233?x\\'80")[0]["text"] == "éx€"
    assert runs("\\uc2\\u8364??x")[0]["text"] == "€x"
    assert runs("\\u-3?")[0]["text"] == chr(65533)
    # a character right after a change of style joins the run before
    assert [(r["text"], r["bold"]) for r in runs("a{\\b\\u233?b}")] == [("aé", False), ("b", True)]


def test_fonts_and_colors():
    head = "\\rtf1\\deff1{\\fonttbl{\\f0 Serif;}{\\f1 Sans;}}{\\colortbl;\\red255;\\themecolor4\\ctint128;;}"
    found = runs("a\\f0\\cf1\\fs25 b\\f9\\cf2\\fs0 c\\cf3 d", head=head)
    assert [r.get("font_family") for r in found] == ["Sans", "Serif", "Sans", "Sans"]
    assert [r.get("color") for r in found] == [None, {"r": 255, "g": 0, "b": 0}, {"r": 162, "g": 185, "b": 226}, None]
    assert found[1]["font_size"] == 12.5 and "font_size" not in found[2]
    # entries need groups of their own
    assert "font_family" not in runs("a", head="\\rtf1{\\fonttbl\\f0 Serif;}")[0]


def test_destinations():
    assert [r["text"] for r in runs("a{\\info{\\title x}}{\\*\\nosuch y}{\\object z}b")] == ["azb"]
    assert warned("{\\*\\nosuch y}a") == ["unknown_destination", "dropped_content"]
    assert warned("a{\\nosuch}") == ["unsupported_control_word"]


LISTS = "{\\*\\listtable{\\list{\\listlevel\\levelnfc0}{\\listlevel\\levelnfc23}\\listid-1}}{\\*\\listoverridetable{\\listoverride\\listid-1\\ls1}}"


def test_lists():
    found = blocks(LISTS + "\\ls1 a\\par\\ls1\\ilvl1 b\\par\\ls1 c\\par\\ls7 d\\par e")
    assert [b["type"] for b in found] == ["listblock", "listblock", "listblock", "paragraph", "paragraph"]
    assert found[0]["list_id"] == 2**32 - 1 and [b.get("kind") for b in found[:3]] == ["ordered_decimal", "bullet", "ordered_decimal"]
    assert "unresolved_list_override" in warned(LISTS + "\\ls7 d")
    assert warned("\\ilvl9 x") == ["unsupported_nesting_level"]


def test_table():
    row = "\\trowd\\trrh-300\\clmgf\\cellx100\\clmrg\\cellx300\\cellx250 a\\cell b\\cell c\\cell\\row "
    (table,) = blocks(row)
    cells = table["rows"][0]["cells"]
    assert [c.get("width_twips") for c in cells] == [100, 200, None] and cells[0]["merge"] == {"horizontal_start": {"span": 2}} and cells[1]["merge"] == "horizontal_continue"
    assert table["rows"][0]["row_props"] == {"height_rule": "exact", "height_twips": 300}
    assert warned(row) == ["malformed_table_structure"]
    assert warned("\\trowd\\clmrg\\cellx1 a\\cell\\row") == ["merge_conflict", "dropped_content"]
    assert reasons("\\trowd\\cellx1\\cellx2 a\\cell\\row") == ["Table cell count mismatch"]
    assert reasons("x\\cell") == ["Table cell control outside table context"]
    assert "unclosed_table_row" in warned("\\trowd\\cellx1 a\\cell\\par")


def test_nested_table():
    (outer,) = blocks("\\trowd\\cellx900 o\\par\\itap2\\trowd\\cellx400 i\\nestcell\\nestrow\\cell\\row")
    inner = outer["rows"][0]["cells"][0]["blocks"]
    assert [b["type"] for b in inner] == ["paragraph", "tableblock"] and inner[1]["rows"][0]["cells"][0]["blocks"][0]["inlines"][0]["text"] == "i"


def test_fields():
    link = lambda url, result="r": f'{{\\field{{\\*\\fldinst HYPERLINK "{url}"}}{{\\fldrslt {result}}}}}'
    assert runs(link("https://a.b"))[0]["target"] == {"type": "external_url", "value": "https://a.b"}
    assert reasons(link("ftp://a.b")) == ["Unsupported hyperlink URL scheme"] and reasons(link("https://a.b", "")) == ["Field with no result text"]
    assert runs('{\\field{\\*\\fldinst HYPERLINK \\\\l "m"}{\\fldrslt r}}')[0]["target"] == {"type": "internal_bookmark", "value": "m"}
    ref = runs("{\\field{\\*\\fldinst REF gone}{\\fldrslt r}}")[0]
    assert ref["resolved"] is False and ref["reference"] == {"kind": "ref", "target": "gone", "fallback_text": "r"}
    assert "resolved" not in runs("{\\*\\bkmkstart here}x{\\field{\\*\\fldinst REF here}{\\fldrslt r}}")[-1]
    assert fields.parse('TOC \\o "2-4" \\h \\z')[1:] == ({"type": "table_of_contents", "options": {"levels": [2, 4], "hyperlinks": True}}, ["\\z"])


def test_toc_and_headings():
    heading = "{\\b\\fs28 1 Heading}\\par text\\par "
    managed = read(heading * 3)["document"]["page_management"]
    assert managed["generated_blocks"][0]["explicit"] is False and "page_management" not in read(heading * 2)["document"]
    explicit = read("a\\par{\\field{\\*\\fldinst TOC}{\\fldrslt x}}\\par b")["document"]
    assert explicit["page_management"]["generated_blocks"][0]["insertion_index"] == 1 and len(explicit["blocks"]) == 2


def test_channels():
    d = read("{\\header h}a{\\footnote n}b{\\footer f}")["document"]
    assert [x["type"] for x in d["blocks"][0]["inlines"]] == ["run", "note_ref", "run"]
    assert d["structure"]["notes"][0]["blocks"][0]["inlines"][0]["text"] == "n" and set(d["structure"]["headers"]) == {"default"}


def test_pictures_and_limits():
    picture = "{\\pict\\pngblip\\picwgoal100\\picscalex50 0a0b}"
    assert blocks(picture)[0] == {"type": "imageblock", "format": "png", "data": [10, 11], "width_twips": 50}
    assert len(reasons("{\\pict\\pngblip 0a0}a")) == 1
    for body, limits, kind in ((picture, Limits(max_image_bytes_total=1), "image_bytes_exceeded"), ("{{{x}}}", Limits(max_group_depth=3), "group_depth_exceeded"), ("x" * 50, Limits(max_input_bytes=20), "input_too_large"), ("\\trowd\\cellx1\\cellx2 a\\cell b\\cell\\row", Limits(max_cells_per_row=1), "invalid_structure")):
        with pytest.raises(InvalidDocument) as e:
            read(body, limits)
        assert e.value.kind == kind
    assert len(read("\\nosuch " * 30, Limits(max_warnings=4))["warnings"]) == 4
    assert [w["type"] for w in read("\\nosuch " * 5 + "{\\obj x}{\\obj y}", Limits(max_warnings=3))["warnings"]] == ["unsupported_control_word"] * 2 + ["dropped_content"]


def test_counts():
    assert read("a\\par{\\b b}c")["stats"] == {"paragraph_count": 2, "run_count": 3, "bytes_processed": len("{\\rtf1\\ansi a\\par{\\b b}c}"), "duration_ms": 0}


def test_sections():
    s = read("a\\pgnlcrm\\sect\\pgnrestart\\pgnstarts5 b\\pgnstarts0 ")
    assert [x["number_format"] for x in s["document"]["page_management"]["sections"]] == ["roman_lower"] * 2
    assert [w["type"] for w in s["warnings"]] == ["section_numbering_fallback"]


def test_the_model_is_json():
    assert json.loads(json.dumps(read("a{\\footnote n}\\trowd\\cellx1 x\\cell\\row")["document"]))
