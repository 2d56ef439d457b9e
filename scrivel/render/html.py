"""HTML of a document. What can't be shown as it is, is named in the list of reasons."""

from __future__ import annotations

import base64
import re

from scrivel.parser.fields import supported_url
from scrivel.render import styles
from scrivel.render.grid import borders, fill, hex_color, rowspans

WRAPS = (("bold", "<strong>", "</strong>"), ("italic", "<em>", "</em>"), ("underline", '<span class="rtf-u">', "</span>"), ("strikethrough", '<span class="rtf-s">', "</span>"), ("small_caps", '<span class="rtf-sc">', "</span>"), ("all_caps", '<span class="rtf-ac">', "</span>"))
LINES = {"single": "solid", "double": "double", "dotted": "dotted", "dashed": "dashed"}
VALIGN = {"top": "top", "center": "middle", "bottom": "bottom"}


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")


def css_string(text: str) -> str:
    """Text within a CSS string."""
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("'", "\\'").replace("\n", "\\A ").replace("\r", "\\D ").replace("\0", "")


def attributes(**given) -> str:
    return "".join(f' {k.rstrip("_")}="{escape(str(v))}"' for k, v in given.items() if v not in (None, ""))


def points(twips: int) -> str:
    return f"{twips / 20:.1f}pt"


class Writer:
    def __init__(self):
        self.reasons: list[str] = []

    def reason(self, text: str) -> None:
        if text not in self.reasons:
            self.reasons.append(text)

    def run(self, r: dict) -> str:
        if not r["text"]:
            return ""
        family = "".join(c for c in r.get("font_family", "") if c.isalnum() or c in " -_")
        said = [f'font-family: "{family}"' if family else "", f"font-size: {r['font_size']:g}pt" if "font_size" in r else "", f"color: {hex_color(r['color'])}" if "color" in r else "", f"background-color: {hex_color(r['background_color'])}" if "background_color" in r else ""]
        style = "; ".join(x for x in said if x)
        on = [w for w in WRAPS if r[w[0]]]
        inner = "".join(w[1] for w in on) + escape(r["text"]) + "".join(w[2] for w in reversed(on))
        return f"<span{attributes(style=style + ';')}>{inner}</span>" if style else inner

    def runs(self, runs: list[dict]) -> str:
        return "".join(map(self.run, runs))

    def inline(self, x: dict) -> str:
        kind = x["type"]
        if kind == "run":
            return self.run(x)
        if kind == "hyperlink":
            inner, value = self.runs(x["runs"]), x["target"]["value"].strip() if x["target"]["type"] == "external_url" else x["target"]["value"]
            if x["target"]["type"] == "internal_bookmark":
                return f'<a href="#{escape(value)}" class="rtf-link">{inner}</a>'
            return f'<a href="{escape(value)}" class="rtf-link">{inner}</a>' if supported_url(value) else inner
        if kind == "bookmark_anchor":
            return f'<a id="{escape(x["name"])}"></a>'
        if kind == "note_ref":
            return f'<a href="#note-{x["id"]}" class="rtf-note-ref rtf-{x["kind"]}-ref"><sup>{x["id"]}</sup></a>'
        if kind == "page_field":
            name = {"current_page": "page", "total_pages": "numpages", "section_pages": "sectionpages", "page_ref": "pageref"}[x["kind"]]
            return f'<span class="rtf-page-field" data-field="{name}">{escape(x.get("fallback_text") or x["target"]) if name == "pageref" else 1}</span>'
        if kind == "generated_block_marker":
            return '<nav class="rtf-generated-toc"></nav>'
        ref = x["reference"]
        inner = self.runs(x["runs"]) if x["runs"] else escape(ref.get("fallback_text") or ref.get("target") or ref.get("identifier") or ref["name"])
        if ref["kind"] in ("ref", "note_ref"):
            return f'<a href="#{escape(ref["target"])}" class="rtf-link rtf-semantic-field" data-field="ref">{inner}</a>' if x.get("resolved", True) else inner
        return f'<span class="rtf-semantic-field" data-field="{ {"sequence": "seq", "doc_property": "docproperty", "merge_field": "mergefield"}[ref["kind"]] }">{inner}</span>'

    def blocks(self, blocks: list[dict]) -> str:
        return "".join(getattr(self, b["type"])(b) for b in blocks)

    def paragraph(self, p: dict) -> str:
        align = "" if p["alignment"] == "left" else f" rtf-align-{p['alignment']}"
        back = fill(p.get("shading"))
        return f"<p{attributes(class_='rtf-p' + align, style=f'background-color: {hex_color(back)};' if back else None)}>{''.join(map(self.inline, p['inlines']))}</p>"

    def imageblock(self, b: dict) -> str:
        data = base64.b64encode(bytes(b["data"])).decode()
        size = "".join(f' {side}="{b[side + "_twips"] // 15}"' for side in ("width", "height") if side + "_twips" in b)
        return f'<figure class="rtf-image"><img src="data:image/{b["format"]};base64,{data}" alt=""{size} /></figure>'

    def listblock(self, b: dict) -> str:
        """Items carry levels; each step down opens one list within the item before it."""
        tag = "ol" if b["kind"] == "ordered_decimal" else "ul"
        begin = f'<{tag} class="rtf-list{" rtf-list-mixed" if b["kind"] == "mixed" else ""}">'
        out, root = [begin], b["items"][0]["level"] if b["items"] else 0
        now, any_open = root, False
        for item in b["items"]:
            to = item["level"]
            if to > now + 1:
                self.reason("list_nesting_semantics")
                to = now + 1
            if to > now:
                if not any_open:
                    self.reason("list_nesting_semantics")
                    out.append("<li>")
                out.append(begin)
            else:
                out.append("</li>" * any_open + f"</{tag}></li>" * (now - to))
            now, any_open = to, True
            out.append("<li>" + self.blocks(item["blocks"]))
        return "".join([*out, "</li>" * any_open, f"</{tag}></li>" * (now - root), f"</{tag}>"])

    def tableblock(self, t: dict) -> str:
        spans = rowspans(t)
        rows = [self.row(t, i, spans) for i in range(len(t["rows"]))]
        plain = all(n <= 1 for n in spans[0]) if spans else False
        inner = f"<thead>{rows[0]}</thead><tbody>{''.join(rows[1:])}</tbody>" if len(rows) > 1 and plain else "".join(rows)
        return f"<table{attributes(class_='rtf-table', style=self.table_style(t))}>{inner}</table>"

    def table_style(self, t: dict) -> str:
        first, said = t["rows"][0].get("row_props", {}), []
        if first.get("alignment") in ("center", "right"):
            said += ["margin-left: auto", f"margin-right: {'auto' if first['alignment'] == 'center' else '0'}"]
        elif first.get("left_indent"):
            said.append(f"margin-left: {points(first['left_indent'])}")
        if first.get("cell_gap_twips", 0) > 0:
            said += ["border-collapse: separate", f"border-spacing: {points(first['cell_gap_twips'])}"]
        width = t.get("table_props", {}).get("preferred_width", {"type": "auto"})
        if width["type"] != "auto":
            said.append(f"width: {points(width['value']) if width['type'] == 'twips' else f'{width["value"] / 100:.1f}%'}")
        return "; ".join(said)

    def row(self, t: dict, i: int, spans: list[list[int]]) -> str:
        props, out, covered = t["rows"][i].get("row_props", {}), [], 0
        height = points(props["height_twips"]) if "height_twips" in props else ""
        style = f"height: {height}" + (f"; max-height: {height}" if props.get("height_rule") == "exact" else "") if height else None
        for j, c in enumerate(t["rows"][i]["cells"]):
            merge = c.get("merge")
            if spans[i][j] == 0:
                continue
            if merge == "horizontal_continue" and covered:
                covered -= 1
                continue
            wide = merge["horizontal_start"]["span"] if isinstance(merge, dict) else 1
            covered = wide - 1
            out.append(self.cell(t, i, j, c, wide, spans[i][j]))
        return f"<tr{attributes(style=style)}>{''.join(out)}</tr>"

    def cell(self, t: dict, i: int, j: int, c: dict, wide: int, high: int) -> str:
        said, width = [], c.get("preferred_width")
        if width:
            if width["type"] == "auto":
                said.append("width: auto")
            elif width["type"] == "percent" or width["value"] > 0:
                said.append(f"width: {points(width['value']) if width['type'] == 'twips' else f'{width["value"] / 100:.1f}%'}")
        elif c.get("width_twips", 0) > 0:
            said.append(f"width: {points(c['width_twips'])}")
        said += [f"padding-{side}: {points(c['padding'][side])}" for side in ("top", "right", "bottom", "left") if side in c.get("padding", {})]
        if back := fill(c.get("shading")):
            said.append(f"background-color: {hex_color(back)}")
        drawn = borders(t, i, j)
        for side in ("top", "left", "bottom", "right"):
            if b := drawn.get(side):
                color = hex_color(b["color"]) if "color" in b else "currentColor"
                said.append(f"border-{side}: " + ("none" if b["style"] == "none" else f"{b.get('width_half_pts', 1) / 2:.1f}pt {LINES[b['style']]} {color}"))
        valign = f"rtf-valign-{VALIGN[c['v_align']]}" if "v_align" in c else None
        return f"<td{attributes(class_=valign, colspan=wide if wide > 1 else None, rowspan=high if high > 1 else None, style='; '.join(said) + ';' if said else None)}>{self.blocks(c.get('blocks', []))}</td>"

    def channel(self, structure: dict, part: str) -> str:
        return "".join(f'<{part} class="rtf-header-footer rtf-{part}-{kind}">\n{self.blocks(structure[part + "s"][kind])}</{part}>\n' for kind in ("default", "first", "even") if structure[part + "s"].get(kind))

    def body(self, document: dict) -> str:
        s = document.get("structure")
        before = self.channel(s, "header") if s else ""
        main = self.blocks(document["blocks"])
        after = self.channel(s, "footer") if s else ""
        if s and s.get("notes"):
            after += '<section class="rtf-notes">\n' + "".join(f'<div id="note-{n["id"]}" class="rtf-note rtf-{n["kind"]}">\n{self.blocks(n["blocks"])}</div>\n' for n in s["notes"]) + "</section>\n"
        return before + main + after


def html(document: dict, wrapper: bool = True, profile: str | None = "report", custom_css: str | None = None) -> tuple[str, list[str]]:
    """The HTML, and the reasons for what was dropped. profile None: no style sheet of ours."""
    w = Writer()
    body = w.body(document)
    if not wrapper:
        return body, w.reasons
    sheets = "".join(f"<style>\n{x}\n</style>\n" for x in (styles.css(styles.profile(profile)) if profile else None, custom_css) if x is not None)
    head = f'<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n{sheets}</head>\n<body>\n<div class="rtf-doc">\n<div class="rtf-content">\n'
    return f"{head}{body}</div>\n</div>\n</body>\n</html>\n", w.reasons


def plain_text(fragment: str) -> str:
    """The text of a fragment of ours, for tests."""
    return re.sub("<[^>]*>", "", fragment)
