"""DOCX packages, with the standard library alone. Images go in as they are; a JPEG that is broken is left out and named in the reasons."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

from scrivel.parser.reader import heading, shown
from scrivel.render import pictures, styles
from scrivel.render.grid import borders, rowspans

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
LINE = {"none": "nil", "single": "single", "double": "double", "dotted": "dotted", "dashed": "dashed"}
#: Fixed values, in English metric units: of a twip and of a pixel, and the side of a picture that doesn't tell its size.
EMU, PIXEL, UNKNOWN = 635, 9525, 914_400
NUMBERS = {"arabic": "decimal", "roman_lower": "lowerRoman", "roman_upper": "upperRoman"}
WORDPROCESSING = "application/vnd.openxmlformats-officedocument.wordprocessingml"
SIDES = ("top", "left", "bottom", "right")


def rgb(c: dict) -> str:
    return f"{c['r']:02X}{c['g']:02X}{c['b']:02X}"


def shading(s: dict | None) -> str:
    """A fill, with its pattern and the pattern's color as they are."""
    if not s:
        return ""
    kind, back = s.get("pattern", "clear"), rgb(s["fill_color"])
    front = rgb(s["pattern_color"]) if "pattern_color" in s else "auto"
    share = kind.removeprefix("percent")
    said = f"pct{share}" if kind != share else kind
    if said == "solid":  # a whole pattern covers the fill
        front = back if front == "auto" else front
    return f'<w:shd w:val="{said}" w:color="{front}" w:fill="{back}"/>'


def border(side: str, b: dict) -> str:
    """Widths are eighths of a point; one point where none is given."""
    return f'<w:{side} w:val="{LINE[b["style"]]}" w:sz="{b["width_half_pts"] * 4 if "width_half_pts" in b else 8}" w:space="0" w:color="{rgb(b["color"]) if "color" in b else "000000"}"/>'


def margins(tag: str, pad: dict) -> str:
    inner = "".join(f'<w:{s} w:w="{max(pad[s], 0)}" w:type="dxa"/>' for s in SIDES if pad.get(s) is not None)
    return f"<w:{tag}>{inner}</w:{tag}>" if inner else ""


def width(tag: str, w: dict) -> str:
    kind, value = {"auto": ("auto", 0), "percent": ("pct", w.get("value", 0)), "twips": ("dxa", max(w.get("value", 0), 0))}[w["type"]]
    return f'<w:{tag} w:w="{value}" w:type="{kind}"/>'


def extent(b: dict) -> tuple[int, int]:
    """Width and height of a picture: as it is told; a side that isn't, from the other by the picture's own proportion; neither, by its pixels."""
    known = pictures.size(b["format"], bytes(b["data"]))
    told = [max(b[k], 1) * EMU if b.get(k, 0) > 0 else None for k in ("width_twips", "height_twips")]
    wide, high = known or (96, 96)
    if told == [None, None]:
        return (wide * PIXEL, high * PIXEL) if known else (UNKNOWN, UNKNOWN)
    return told[0] or max(told[1] * wide // high, 1), told[1] or max(told[0] * high // wide, 1)


class Package:
    def __init__(self, document: dict, profile: dict | None = None):
        self.document, self.files, self.relations, self.reasons, self.numbers = document, {}, [], [], {}
        self.bookmarks, self.profile = 0, profile
        self.generated = document.get("page_management", {}).get("generated_blocks", [])

    def relate(self, kind: str, target: str, external: bool = False) -> str:
        self.relations.append((kind, target, external))
        return f"rId{len(self.relations)}"

    def number(self, b: dict) -> int:
        """Lists with the same id and kind share a numbering; the first has number 2."""
        levels = frozenset(i["level"] for i in b["items"])
        held = self.numbers.setdefault((b["list_id"], b["kind"]), [len(self.numbers) + 2, set()])
        held[1] |= levels
        return held[0]

    def run(self, r: dict) -> str:
        p = [f'<w:rFonts w:ascii={quoteattr(r["font_family"])} w:hAnsi={quoteattr(r["font_family"])}/>' if "font_family" in r else "", "<w:b/>" * r["bold"], "<w:i/>" * r["italic"], "<w:caps/>" * (r["all_caps"] or r["small_caps"]), "<w:strike/>" * r["strikethrough"]]
        p.append(f'<w:color w:val="{rgb(r["color"])}"/>' if "color" in r else "")
        half = round(r.get("font_size", 0) * 2)
        p.append(f'<w:sz w:val="{min(half, 1638)}"/>' if half >= 1 else "")
        p.append('<w:u w:val="single"/>' if r["underline"] else "")
        p.append(f'<w:shd w:val="clear" w:color="auto" w:fill="{rgb(r["background_color"])}"/>' if "background_color" in r else "")
        said = "".join(p)
        return f"<w:r>{f'<w:rPr>{said}</w:rPr>' if said else ''}<w:t xml:space=\"preserve\">{escape(r['text'])}</w:t></w:r>"

    def field(self, instruction: str, inner: str) -> str:
        return f'<w:fldSimple w:instr={quoteattr(instruction)}>{inner}</w:fldSimple>'

    def inline(self, x: dict) -> str:
        kind = x["type"]
        if kind == "run":
            return self.run(x)
        plain = f'<w:r><w:t xml:space="preserve">{escape(shown(x))}</w:t></w:r>'
        if kind == "hyperlink":
            inner = "".join(map(self.run, x["runs"]))
            if x["target"]["type"] == "internal_bookmark":
                return f'<w:hyperlink w:anchor={quoteattr(x["target"]["value"])}>{inner}</w:hyperlink>'
            return f'<w:hyperlink r:id="{self.relate("hyperlink", x["target"]["value"].strip(), True)}">{inner}</w:hyperlink>'
        if kind == "bookmark_anchor":
            self.bookmarks += 1
            return f'<w:bookmarkStart w:id="{self.bookmarks}" w:name={quoteattr(x["name"])}/><w:bookmarkEnd w:id="{self.bookmarks}"/>'
        if kind == "note_ref":
            return f'<w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:footnoteReference w:id="{x["id"]}"/></w:r>'
        if kind == "page_field":
            name = {"current_page": "PAGE", "total_pages": "NUMPAGES", "section_pages": "SECTIONPAGES"}.get(x["kind"])
            return self.field(name or f"PAGEREF {x['target']}", plain)
        if kind == "semantic_field":
            ref = x["reference"]
            name = {"ref": "REF", "note_ref": "NOTEREF", "sequence": "SEQ", "doc_property": "DOCPROPERTY", "merge_field": "MERGEFIELD"}[ref["kind"]]
            inner = "".join(map(self.run, x["runs"])) or plain
            return self.field(f"{name} {ref.get('target') or ref.get('identifier') or ref['name']}", inner) if x.get("resolved", True) else inner
        return ""

    def paragraph(self, p: dict, numbering: str = "") -> str:
        align = {"center": "center", "right": "right", "justify": "both"}.get(p["alignment"])
        style = f'<w:pStyle w:val="Heading{self.level(p)}"/>' if self.generated and not numbering and heading(p) else ""
        said = style + numbering + shading(p.get("shading")) + (f'<w:jc w:val="{align}"/>' if align else "")
        return f"<w:p>{f'<w:pPr>{said}</w:pPr>' if said else ''}{''.join(map(self.inline, p['inlines']))}</w:p>"

    def level(self, p: dict) -> int:
        number = "".join(map(shown, p["inlines"])).split()[0].strip(".").split(".")
        return min(len(number), 3) if all(x.isdigit() for x in number) else 1

    def contents(self, kind: dict) -> str:
        """A table of contents, which the reader of the file fills."""
        options = kind.get("options", {})
        levels = options.get("levels") or [1, 3]
        said = f'TOC \\o "{levels[0]}-{levels[1]}"' + " \\h" * bool(options.get("hyperlinks", True))
        return f"<w:p>{self.field(said, '<w:r><w:t>Contents</w:t></w:r>')}</w:p>"

    def blocks(self, blocks: list[dict]) -> str:
        return "".join(getattr(self, b["type"])(b) for b in blocks)

    def listblock(self, b: dict) -> str:
        n, out = self.number(b), []
        for item in b["items"]:
            for x in item["blocks"]:
                mark = f'<w:numPr><w:ilvl w:val="{item["level"]}"/><w:numId w:val="{n}"/></w:numPr>'
                out.append(self.paragraph(x, mark) if x["type"] == "paragraph" else getattr(self, x["type"])(x))
        return "".join(out)

    def table_properties(self, t: dict) -> str:
        first, own = t["rows"][0].get("row_props", {}), t.get("table_props", {})
        said = [width("tblW", own.get("preferred_width", {"type": "auto"}))]
        if first.get("alignment") in ("center", "right"):
            said.append(f'<w:jc w:val="{first["alignment"]}"/>')
        if first.get("cell_gap_twips", 0) > 0:  # each cell keeps half of the gap
            said.append(f'<w:tblCellSpacing w:w="{first["cell_gap_twips"] // 2}" w:type="dxa"/>')
        if first.get("left_indent"):
            said.append(f'<w:tblInd w:w="{first["left_indent"]}" w:type="dxa"/>')
        p, pad = self.profile, first.get("default_padding")
        if p:
            line = f'w:val="single" w:sz="{max(1, round(p["component"]["table-border-width"] * 8))}" w:space="0" w:color="{p["color"]["border-default"][1:]}"'
            said.append("<w:tblBorders>" + "".join(f"<w:{s} {line}/>" for s in (*SIDES, "insideH", "insideV")) + "</w:tblBorders>")
            if not pad:
                x, y = (round(p["space"][f"table-cell-padding-{c}"] * 20) for c in "xy")
                pad = {"top": y, "bottom": y, "left": x, "right": x}
        said.append(margins("tblCellMar", pad or {}))
        return "".join(said)

    def grid(self, t: dict) -> str:
        """Widths of the columns: of each, the first that a cell of one column says."""
        wide: dict[int, int] = {}
        count = max(len(r["cells"]) for r in t["rows"])
        for r in t["rows"]:
            for j, c in enumerate(r["cells"]):
                if not isinstance(c.get("merge"), dict) and c.get("width_twips", 0) > 0:
                    wide.setdefault(j, c["width_twips"])
        return "".join(f'<w:gridCol w:w="{wide[j]}"/>' if j in wide else "<w:gridCol/>" for j in range(count))

    def tableblock(self, t: dict) -> str:
        rows = []
        spans = rowspans(t)
        for i, row in enumerate(t["rows"]):
            cells, covered = [], 0
            for j, c in enumerate(row["cells"]):
                merge = c.get("merge")
                if merge == "horizontal_continue" and covered:
                    covered -= 1
                    continue
                n = merge["horizontal_start"]["span"] if isinstance(merge, dict) else 1
                covered = n - 1
                told = c.get("preferred_width") or ({"type": "twips", "value": c["width_twips"]} if "width_twips" in c else None)
                p = [width("tcW", told) if told else "", f'<w:gridSpan w:val="{n}"/>' if n > 1 else "", "<w:vMerge/>" if spans[i][j] == 0 else '<w:vMerge w:val="restart"/>' if merge == "vertical_start" else ""]
                if drawn := borders(t, i, j):
                    p.append("<w:tcBorders>" + "".join(border(side, drawn[side]) for side in SIDES if side in drawn) + "</w:tcBorders>")
                p.append(shading(c.get("shading")))
                p.append(margins("tcMar", c.get("padding", {})))
                if "v_align" in c:
                    p.append(f'<w:vAlign w:val="{c["v_align"]}"/>')
                inner = self.blocks(c.get("blocks", []))
                cells.append(f"<w:tc><w:tcPr>{''.join(p)}</w:tcPr>{inner if inner.endswith('</w:p>') else inner + '<w:p/>'}</w:tc>")
            props = row.get("row_props", {})
            said = (f'<w:trHeight w:val="{props["height_twips"]}" w:hRule="{"exact" if props["height_rule"] == "exact" else "atLeast"}"/>' if "height_twips" in props else "") + (f'<w:jc w:val="{props["alignment"]}"/>' if "alignment" in props else "")
            rows.append(f"<w:tr>{f'<w:trPr>{said}</w:trPr>' if said else ''}{''.join(cells)}</w:tr>")
        return f"<w:tbl><w:tblPr>{self.table_properties(t)}</w:tblPr><w:tblGrid>{self.grid(t)}</w:tblGrid>{''.join(rows)}</w:tbl>"

    def imageblock(self, b: dict) -> str:
        if b["format"] == "jpeg" and pictures.size("jpeg", bytes(b["data"])) is None:
            self.reasons.append("Dropped malformed JPEG image payload")
            return ""
        n = sum(k.startswith("word/media/") for k in self.files) + 1
        name = f"media/image{n}.{b['format']}"
        self.files["word/" + name] = bytes(b["data"])
        wide, high = extent(b)
        return (
            f'<w:p><w:r><w:drawing><wp:inline><wp:extent cx="{wide}" cy="{high}"/><wp:docPr id="{n}" name="image{n}"/><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic><pic:nvPicPr><pic:cNvPr id="{n}" name="image{n}"/><pic:cNvPicPr/></pic:nvPicPr>'
            f'<pic:blipFill><a:blip r:embed="{self.relate("image", name)}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{wide}" cy="{high}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>'
        )

    def numbering(self) -> str:
        kinds = {k: i for i, k in enumerate(sorted({(kind, tuple(sorted(levels))) for (_, kind), (_, levels) in self.numbers.items()}), 1)}
        level = lambda kind, i: f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{"decimal" if kind == "ordered_decimal" else "bullet"}"/><w:lvlText w:val="{f"%{i + 1}." if kind == "ordered_decimal" else "•"}"/><w:pPr><w:ind w:left="{720 * (i + 1)}" w:hanging="360"/></w:pPr></w:lvl>'
        abstract = "".join(f'<w:abstractNum w:abstractNumId="{n}">{"".join(level(kind, i) for i in range(9))}</w:abstractNum>' for (kind, _), n in kinds.items())
        return f"{HEAD}<w:numbering {W}>{abstract}{''.join(f'<w:num w:numId="{n}"><w:abstractNumId w:val="{kinds[kind, tuple(sorted(levels))]}"/></w:num>' for (_, kind), (n, levels) in self.numbers.items())}</w:numbering>"

    def page(self) -> str:
        """A4, margins of the profile, and numbers of pages as the last section has them."""
        side = lambda s: round((self.profile["layout"][f"page-margin-{s}"] if self.profile else 25.4) * 1440 / 25.4)
        said = f'<w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="{side("top")}" w:right="{side("right")}" w:bottom="{side("bottom")}" w:left="{side("left")}" w:header="708" w:footer="708" w:gutter="0"/>'
        last = self.document.get("page_management", {}).get("sections", [{}])[-1]
        start = f' w:start="{last["start_page"]}"' if last.get("start_page") else ' w:start="1"' if last.get("restart_page_numbering") else ""
        return said + (f'<w:pgNumType w:fmt="{NUMBERS[last["number_format"]]}"{start}/>' if last else "")

    def styles(self) -> str:
        p = self.profile or styles.profile("classic")
        t, part = p["type"], p["component"]
        font = lambda name: f"<w:rFonts w:ascii={quoteattr(name)} w:hAnsi={quoteattr(name)}/>"
        size = lambda points: f'<w:sz w:val="{round(points * 2)}"/>'
        color = f'<w:color w:val="{p["color"]["text-primary"][1:]}"/>'
        default = f"<w:docDefaults><w:rPrDefault><w:rPr>{font(t['font-body'])}{color}{size(t['size-body'])}</w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:spacing w:after=\"{round(p['space']['paragraph-gap'] * 20)}\" w:line=\"{round(t['line-height-body'] * 240)}\" w:lineRule=\"auto\"/></w:pPr></w:pPrDefault></w:docDefaults>" if self.profile else ""
        normal = '<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>'
        heads = "".join(
            f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/><w:basedOn w:val="Normal"/><w:pPr><w:spacing w:before="{round(part[f"heading-spacing-above-h{i}"] * 20)}" w:after="{round(part[f"heading-spacing-below-h{i}"] * 20)}"/><w:outlineLvl w:val="{i - 1}"/></w:pPr><w:rPr>{font(t["font-heading"])}<w:b/>{size(t[f"size-h{i}"])}</w:rPr></w:style>'
            for i in (1, 2, 3)
        )
        return default + normal + heads

    def bytes(self) -> bytes:
        d, structure = self.document, self.document.get("structure", {})
        parts, section = [], ""
        body = ""
        for i in range(len(d["blocks"]) + 1):
            body += "".join(self.contents(g["kind"]) for g in self.generated if g["insertion_index"] == i) + self.blocks(d["blocks"][i : i + 1])
        for part, tag in (("header", "hdr"), ("footer", "ftr")):
            for kind, blocks in structure.get(part + "s", {}).items():
                name = f"{part}_{kind}.xml"
                self.files["word/" + name] = f"{HEAD}<w:{tag} {W}>{self.blocks(blocks)}</w:{tag}>".encode()
                section += f'<w:{part}Reference w:type="{kind}" r:id="{self.relate(part, name)}"/>'
                parts.append((f"/word/{name}", f"application/vnd.openxmlformats-officedocument.wordprocessingml.{part}+xml"))
        if notes := structure.get("notes"):
            rule = "".join(f'<w:footnote w:type="{kind}" w:id="{i}"><w:p><w:r><w:{tag}/></w:r></w:p></w:footnote>' for i, kind, tag in ((-1, "separator", "separator"), (0, "continuationSeparator", "continuationSeparator")))
            inner = rule + "".join(f'<w:footnote w:id="{n["id"]}">{self.blocks(n["blocks"])}</w:footnote>' for n in notes)
            self.files["word/footnotes.xml"] = f"{HEAD}<w:footnotes {W}>{inner}</w:footnotes>".encode()
            self.relate("footnotes", "footnotes.xml")
            parts.append(("/word/footnotes.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.footnotes+xml"))
        if self.numbers:
            self.files["word/numbering.xml"] = self.numbering().encode()
            self.relate("numbering", "numbering.xml")
            parts.append(("/word/numbering.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.numbering+xml"))
        has = lambda kind: any(structure.get(part, {}).get(kind) for part in ("headers", "footers"))
        for name, inner in (("styles", self.styles()), ("settings", "<w:evenAndOddHeaders/>" if has("even") else "")):
            self.files[f"word/{name}.xml"] = f"{HEAD}<w:{name} {W}>{inner}</w:{name}>".encode()
            self.relate(name, f"{name}.xml")
            parts.append((f"/word/{name}.xml", f"{WORDPROCESSING}.{name}+xml"))
        parts.append(("/word/document.xml", f"{WORDPROCESSING}.document.main+xml"))
        section += self.page() + "<w:titlePg/>" * has("first")
        self.files["word/document.xml"] = f"{HEAD}<w:document {W}><w:body>{body}<w:sectPr>{section}</w:sectPr></w:body></w:document>".encode()
        links = "".join(f'<Relationship Id="rId{i}" Type="{REL}/{kind}" Target={quoteattr(target)}{" TargetMode=\"External\"" if external else ""}/>' for i, (kind, target, external) in enumerate(self.relations, 1))
        ns = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
        self.files["word/_rels/document.xml.rels"] = f"{HEAD}<Relationships {ns}>{links}</Relationships>".encode()
        self.files["_rels/.rels"] = f'{HEAD}<Relationships {ns}><Relationship Id="rId1" Type="{REL}/officeDocument" Target="word/document.xml"/></Relationships>'.encode()
        kinds = "".join(f'<Override PartName="{name}" ContentType="{kind}"/>' for name, kind in parts)
        self.files["[Content_Types].xml"] = f'{HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Default Extension="jpeg" ContentType="image/jpeg"/>{kinds}</Types>'.encode()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name in sorted(self.files):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), self.files[name], zipfile.ZIP_DEFLATED)
        return out.getvalue()


def docx(document: dict, profile: str | None = None) -> tuple[bytes, list[str]]:
    """The package, and reasons for what was left out. profile: of styles, borders and margins; None leaves them to the reader."""
    p = Package(document, styles.profile(profile) if profile else None)
    return p.bytes(), p.reasons
