"""Reads one document: a fold over its tokens into blocks, warnings and counts.

Blocks are plain dicts in the JSON dialect of the document model (type tags, absent instead of null). Character and
paragraph style belong to the group they are set in; list references, the table that is being built and the number of
characters a Unicode escape replaces do not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import cached_property
from operator import attrgetter

from scrivel.functions import colors
from scrivel.limits import Limits
from scrivel.parser import fields
from scrivel.parser import reasons as why
from scrivel.parser.lexer import InvalidDocument, tokens, validate


def words(text: str) -> frozenset:
    return frozenset(text.split())


#: Destinations by what becomes of them.
METADATA = words("stylesheet info title author operator keywords comment version vern creatim revtim printim buptim edmins nofpages nofwords nofchars nofcharsws id")
DROPPED = words("obj objclass objdata picprop datafield annotation pn pntext pntxtb pntxta pnseclvl")
CHANNELS = {"header": "header_default", "headerr": "header_default", "headerl": "header_even", "headerf": "header_first", "footer": "footer_default", "footerr": "footer_default", "footerl": "footer_even", "footerf": "footer_first"}
TABLES = {"listtable": "lists", "listoverridetable": "overrides", "fonttbl": "fonts", "colortbl": "colors"}
SILENT = words("rtf ansi ansicpg deflang deflangfe adeflang result hwid emdash endash emspace enspace qmspace bullet lquote rquote ldblquote rdblquote tab sub super nosupersub outl shad expnd expndtw kerning charscalex lang langfe langnp langfenp par line sectd nonesttables")
LIST_SILENT = words("listtemplateid listsimple listhybrid listname liststyleid levels levelstartat levelindent levelspace levelfollow levellegal levelnorestart leveljcn levelnfcn levelnfcN listoverridestart listoverridepad")
LEGACY = words("pnlvl pnlvlblt pnlvlbody pnlvlcont pnstart pnindent pntxta pntxtb")
TOGGLES = {"b": "bold", "i": "italic", "ul": "underline", "strike": "strikethrough", "striked": "strikethrough", "scaps": "small_caps", "caps": "all_caps"}
ALIGN = {"ql": "left", "qc": "center", "qr": "right", "qj": "justify"}
BORDERS = {"brdrs": "single", "brdrdb": "double", "brdrdot": "dotted", "brdrdash": "dashed", "brdrnone": "none"}
SIDES = {"t": "top", "l": "left", "b": "bottom", "r": "right", "h": "inside_h", "v": "inside_v"}
PICTURE = {"picw": "w", "pich": "h", "picwgoal": "wgoal", "pichgoal": "hgoal", "picscalex": "scalex", "picscaley": "scaley"}
INFO = words("unknown_destination unsupported_nesting_level")
MERGES = {"clmgf": {"horizontal_start": {"span": 1}}, "clmrg": "horizontal_continue", "clvmgf": "vertical_start", "clvmrg": "vertical_continue"}
FLAGS = ("bold", "italic", "underline", "strikethrough", "small_caps", "all_caps")


CHARACTERS = attrgetter(*FLAGS, "font", "size", "color", "highlight", "background")


@dataclass(frozen=True)
class Style:
    bold: bool = False
    italic: bool = False
    underline: bool = False
    strikethrough: bool = False
    small_caps: bool = False
    all_caps: bool = False
    font: int | None = None
    size: int | None = None
    color: int | None = None
    highlight: int | None = None
    background: int | None = None
    alignment: str = "left"
    cbpat: int | None = None
    cfpat: int | None = None
    shading: int | None = None

    @cached_property
    def characters(self) -> tuple:
        return CHARACTERS(self)


class Group:
    __slots__ = ("style", "fresh", "at_end", "shppict")

    def __init__(self, style: Style):
        self.style, self.fresh, self.at_end, self.shppict = style, True, [], False


class Field:
    def __init__(self, style: Style):
        self.style, self.instruction, self.results, self.reading, self.nested = style, "", [], None, []


class RowDef:
    """What the words between \\trowd and \\row say of a row and its cells."""

    def __init__(self):
        self.right, self.cells, self.cell, self.row, self.border = [], [], {}, {}, {}

    def commit(self) -> None:
        """A border descriptor goes to its target when the next one begins; words before any target wait for one."""
        if "target" in self.border:
            owner, side = self.border["target"]
            (self.cell if owner == "cell" else self.row).setdefault("borders", {})[side] = {k: self.border.get(k) for k in ("style", "width", "color")}
            self.border = {}


class Table:
    def __init__(self, number: int = 0):
        self.number = number
        self.rows, self.row, self.cell, self.define, self.pending = [], None, None, RowDef(), {}


class Reader:
    def __init__(self, limits: Limits | None = None, raw: bool = False):
        """raw: keep what the words say of cells, paragraphs, runs and resources, before it is resolved."""
        self.limits = limits or Limits()
        self.raw: dict[str, list] | None = {"cells": [], "marks": [], "uses": [], "fonts": []} if raw else None
        self.table_count = 0
        self.refers = False  # whether there is a field or a bookmark at all
        self.warnings: list[dict] = []
        self.dropped_kept = False
        self.blocks: list[dict] = []
        self.channels: dict[str, list] = {}
        self.notes: list[dict] = []
        self.sinks: list[tuple[str, list]] = [("body", self.blocks)]
        self.groups: list[Group] = []
        self.style = self.run_style = Style()
        self.text, self.inlines, self.alignment = "", [], "left"
        self.fonts: dict[int, str] = {}
        self.colors: list[tuple | None] = []
        self.default_font: int | None = None
        self.lists: dict[int, list] = {}
        self.overrides: dict[int, int] = {}
        self.ls = self.level = None
        self.uc, self.skip, self.starred, self.intbl = 1, 0, False, False
        self.tables: list[Table] = []
        self.itap, self.nested_props = None, False
        self.field: Field | None = None
        self.bookmark: str | None = None
        self.picture: dict | None = None
        self.image_bytes = self.note_ids = self.paragraphs = self.runs = 0
        self.sections = [{"index": 0, "restart_page_numbering": False, "number_format": "arabic"}]

    # ---- report

    def warn(self, kind: str, **what) -> None:
        """Beyond the cap only the first dropped_content is taken, in the place of the last one kept."""
        w = {"type": kind, **what, "severity": "info" if kind in INFO else "warning"}
        if len(self.warnings) < self.limits.max_warnings:
            self.warnings.append(w)
        elif kind == "dropped_content" and not self.dropped_kept and self.warnings:
            self.warnings[-1] = w
        else:
            return
        self.dropped_kept |= kind == "dropped_content"

    def drop(self, reason: str, size: int | None = None) -> None:
        self.warn("dropped_content", reason=reason, **({"size_hint": size} if size is not None else {}))

    def malformed(self, reason: str) -> None:
        self.warn("malformed_table_structure", reason=reason)

    # ---- the fold

    def read(self, text: str) -> dict:
        size = len(text.encode())
        if size > self.limits.max_input_bytes:
            raise InvalidDocument("input_too_large", f"{size} bytes, at most {self.limits.max_input_bytes}")
        found = tokens(text)
        validate(found)
        i, end, groups = 0, len(found), self.groups
        while i < end:
            kind, value, n = found[i]
            i += 1
            if kind == "text":
                if groups:
                    groups[-1].fresh = False
                # most text: of the style of the text before it, and of the body
                if self.text and self.style is self.run_style and self.field is None and self.picture is None and self.bookmark is None:
                    if self.skip:
                        cut = min(self.skip, len(value))
                        self.skip -= cut
                        value = value[cut:]
                    self.text += value
                else:
                    self.take_text(value)
            elif kind == "word":
                if value == "u" and n is not None and groups and not groups[-1].fresh and self.field is None:
                    self.starred = False
                    self.escape(n)
                else:
                    i = self.take_word(value, n, found, i)
            elif kind == "open":
                if len(groups) + 1 > self.limits.max_group_depth:
                    raise InvalidDocument("group_depth_exceeded", f"depth {len(groups) + 1}, at most {self.limits.max_group_depth}")
                groups.append(Group(self.style))
            elif kind == "close":
                self.close_group()
            else:
                self.take_symbol(value)
        self.end_paragraph()
        while self.tables:
            self.end_table()
        document = self.finished()
        stats = {"paragraph_count": self.paragraphs, "run_count": self.runs, "bytes_processed": size, "duration_ms": 0}
        return {"document": document, "warnings": self.warnings, "stats": stats}

    def close_group(self) -> None:
        group = self.groups.pop()
        self.style = group.style
        self.starred = False
        for action in group.at_end:
            action()

    def skip_group(self, found: list, i: int, inside=None) -> int:
        """To the end of the group that token i is in. inside(kind, value, n, depth) sees what is skipped; depth is 1 in the group itself."""
        depth = 1
        while i < len(found):
            kind, value, n = found[i]
            if kind == "open":
                depth += 1
                if len(self.groups) + depth - 1 > self.limits.max_group_depth:
                    raise InvalidDocument("group_depth_exceeded", f"depth {len(self.groups) + depth - 1}, at most {self.limits.max_group_depth}")
            if inside:
                inside(kind, value, n, depth)
            if kind == "close":
                depth -= 1
                if not depth:
                    break
            i += 1
        return i  # the group's own end is yet to be read

    # ---- text

    def start_paragraph(self) -> None:
        if not self.inlines and not self.text:
            self.alignment = self.style.alignment

    def take_text(self, text: str) -> None:
        if self.field is None:
            if self.picture is not None:
                self.picture["hex"].append(text)
                return
            if self.skip:
                cut = min(self.skip, len(text))
                self.skip -= cut
                text = text[cut:]
                if not text:
                    return
            if self.bookmark is not None:
                self.bookmark += text
                return
            self.start_paragraph()
            if self.style is not self.run_style and self.style.characters != self.run_style.characters:
                self.flush()
                self.run_style = self.style
            self.text += text
            return
        if self.bookmark is not None:
            self.bookmark += text
            return
        reading = self.field.nested[-1] if self.field.nested else self.field.reading
        if reading == "fldrslt":
            if self.skip:
                cut = min(self.skip, len(text))
                self.skip -= cut
                text = text[cut:]
            if text:
                if self.style is not self.run_style and self.style.characters != self.run_style.characters:
                    self.flush()
                    self.run_style = self.style
                self.text += text
        elif reading == "fldinst" and not self.field.nested:
            self.field.instruction += text

    def run(self, text: str) -> dict:
        s = self.run_style
        out = {"text": text, **{f: getattr(s, f) for f in FLAGS}}
        family = self.fonts.get(s.font) or self.fonts.get(self.default_font)
        if family:
            out["font_family"] = family
        if s.size and s.size > 0:
            out["font_size"] = s.size / 2
        if color := self.color(s.color):
            out["color"] = color
        if back := self.color(s.highlight) or self.color(s.background):
            out["background_color"] = back
        return out

    def flush(self) -> None:
        """Text so far becomes a run, of the paragraph or of the field result that is being read."""
        if self.text:
            if self.raw is not None:
                self.raw["uses"].append({"paragraph": self.paragraphs, "font_idx": self.run_style.font, "color_idx": self.run_style.color, "length": len(self.text)})
            inside = self.field is not None and "fldrslt" in (self.field.reading, *self.field.nested)
            (self.field.results if inside else self.inlines).append({"type": "run", **self.run(self.text)})
            self.text = ""

    def color(self, index: int | None) -> dict | None:
        if index is None or index <= 0 or index >= len(self.colors) or self.colors[index] is None:
            return None
        return dict(zip("rgb", self.colors[index], strict=True))

    def shaded(self, fill: int | None, front: int | None, percent: int | None) -> dict | None:
        if not (back := self.color(fill)):
            return None
        out = {"fill_color": back}
        if over := self.color(front):
            out["pattern_color"] = over
        if percent is not None:
            out["pattern"] = colors.pattern(percent)
        elif over:
            out["pattern"] = "solid"
        return out

    # ---- paragraphs and blocks

    def end_paragraph(self) -> None:
        in_row = bool(self.tables) and self.tables[-1].row is not None
        if not in_row:
            if self.intbl and (self.text or self.inlines):
                self.malformed(why.INTBL_OUTSIDE)
                self.drop(why.PARAGRAPH_OUTSIDE)
                self.intbl = False
            if self.tables:
                self.end_table()
                in_row = bool(self.tables) and self.tables[-1].row is not None
        self.flush()
        if self.inlines:
            block = {"type": "paragraph", "alignment": self.alignment, "inlines": self.inlines}
            if shading := self.shaded(self.style.cbpat, self.style.cfpat, self.style.shading):
                block["shading"] = shading
            if self.raw is not None:
                self.raw["marks"].append({"ord": self.paragraphs, "ls": self.ls, "level": self.level or 0, "text": "".join(map(shown, self.inlines))})
            self.paragraphs += 1
            self.runs += sum(1 if x["type"] == "run" else len(x["runs"]) if x["type"] == "hyperlink" else 0 for x in self.inlines)
            into = self.cell()["blocks"] if in_row else self.sinks[-1][1]
            merging = in_row or self.sinks[-1][0] == "body"
            if (kind := self.list_kind()) is not None:
                item = {"level": self.level or 0, "blocks": [block]}
                last = into[-1] if into else None
                if merging and last and last["type"] == "listblock" and (last["list_id"], last["kind"]) == kind:
                    last["items"].append(item)
                else:
                    into.append({"type": "listblock", "list_id": kind[0], "kind": kind[1], "items": [item]})
            else:
                into.append(block)
        self.inlines, self.run_style, self.alignment = [], self.style, self.style.alignment
        self.ls = self.level = None
        self.intbl = False

    def list_kind(self) -> tuple[int, str] | None:
        if self.ls is None:
            return None
        if self.ls not in self.overrides:
            self.warn("unresolved_list_override", ls_id=self.ls)
            self.drop(why.UNRESOLVED_OVERRIDE.format(self.ls))
            return None
        number = self.overrides[self.ls]
        levels = self.lists.get(number, [])
        level = self.level or 0
        return number % 2**32, levels[level] if level < len(levels) else "bullet"

    def cell(self) -> dict:
        table = self.tables[-1]
        if table.cell is None:
            table.cell = {"blocks": []}
        return table.cell

    def place(self, block: dict) -> None:
        if self.text or self.inlines:
            self.end_paragraph()
        if self.tables and self.tables[-1].row is not None:
            self.cell()["blocks"].append(block)
            return
        if self.tables:
            self.end_table()
        self.sinks[-1][1].append(block)

    # ---- control words

    def take_symbol(self, symbol: str) -> None:
        if symbol == "*":
            self.starred = True
        elif symbol in "\\{}":
            self.take_text(symbol)
        elif symbol in "~_":
            self.take_text(" " if symbol == "~" else "‑")

    def escape(self, n: int) -> None:
        code = n % 65536 if n < 0 else n
        if code < 0xD800 or 0xDFFF < code < 0x110000:
            self.text += chr(code)
        self.skip = self.uc

    def take_word(self, word: str, n: int | None, found: list, i: int) -> int:
        if word in ("par", "line"):
            self.end_paragraph()
            return i
        if word in ("cell", "nestcell"):
            self.end_cell_word()
            return i
        if word in ("row", "nestrow"):
            self.end_row_word()
            return i
        group = self.groups[-1] if self.groups else None  # words may follow the last group
        if group is not None and group.fresh:
            to = self.destination(word, found, i)
            if to is not None:
                return to
            group.fresh = False
        self.starred = False
        f = self.field
        if f and f.reading == "fldinst" and not f.nested and word not in ("field", "fldinst", "fldrslt"):
            gap = " " if f.instruction and not f.instruction[-1].isspace() else ""
            f.instruction += f"{gap}\\{word}{'' if n is None else n} "
            return i
        self.plain_word(word, n)
        return i

    def destination(self, word: str, found: list, i: int) -> int | None:
        """Where to read on if the word begins a destination that is skipped or redirected, else None."""
        group, starred = self.groups[-1], self.starred
        if word in METADATA or word == "bkmkend":
            to = self.skip_group(found, i)
        elif word in DROPPED:
            self.drop(why.UNSUPPORTED_DESTINATION)
            to = self.skip_group(found, i)
        elif word in TABLES:
            to = self.skip_group(found, i, getattr(self, f"read_{TABLES[word]}")())
        elif word == "nonshppict" and len(self.groups) > 1 and self.groups[-2].shppict:
            self.drop(why.NONSHPPICT)
            to = self.skip_group(found, i)
        elif word in CHANNELS:
            self.redirect(CHANNELS[word], self.channels.setdefault(CHANNELS[word], []))
            to = i
        elif word in ("footnote", "endnote"):
            self.flush()
            self.note_ids += 1
            self.start_paragraph()
            self.inlines.append({"type": "note_ref", "id": self.note_ids, "kind": word})
            self.redirect("note", [], {"id": self.note_ids, "kind": word})
            to = i
        elif word == "bkmkstart":
            self.bookmark = ""
            group.at_end.append(self.end_bookmark)
            return None
        elif word == "pict":
            self.picture = {"hex": []}
            group.at_end.append(self.end_picture)
            return None
        elif word == "shppict":
            if len(self.groups) > 1:
                self.groups[-2].shppict = True
            return None
        elif word in ("fldinst", "fldrslt"):
            return None  # plain_word begins them
        elif starred and word != "nonshppict":
            self.warn("unknown_destination", destination=word)
            self.drop(why.UNKNOWN_DESTINATION.format(word))
            to = self.skip_group(found, i)
        else:
            return None
        self.starred, group.fresh = False, False
        return to

    def plain_word(self, word: str, n: int | None) -> None:
        if word in TOGGLES:
            self.style = replace(self.style, **{TOGGLES[word]: n != 0})
        elif word == "ulnone":
            self.style = replace(self.style, underline=False)
        elif word in ALIGN:
            self.style = replace(self.style, alignment=ALIGN[word])
        elif word == "plain":
            self.style = replace(Style(font=self.default_font), alignment=self.style.alignment, cbpat=self.style.cbpat, cfpat=self.style.cfpat, shading=self.style.shading)
        elif word == "pard":
            s = self.style
            if s.alignment != "left" or s.cbpat is not None or s.cfpat is not None or s.shading is not None:
                self.style = replace(s, alignment="left", cbpat=None, cfpat=None, shading=None)
            self.ls = self.level = None
            self.intbl = False
        elif word == "u":
            if n is not None:
                self.escape(n)
        elif word == "uc":
            self.uc = n if n is not None and n >= 0 else 1
        elif word in ("f", "fs", "cf"):
            self.style = replace(self.style, **{{"f": "font", "fs": "size", "cf": "color"}[word]: n})
        elif word in ("highlight", "cb"):
            self.style = replace(self.style, **{"highlight" if word == "highlight" else "background": n if n and n > 0 else None})
        elif word == "deff":
            if n is not None:
                self.default_font = n
                if self.style.font is None:
                    self.style = replace(self.style, font=n)
        elif word in ("cbpat", "cfpat", "shading"):
            self.style = replace(self.style, **{word: n})
        elif word == "ls":
            self.ls = n
        elif word == "ilvl":
            level = n if n is not None and 0 <= n <= 255 else 0
            self.level = min(level, 8)
            if level > 8:
                self.warn("unsupported_nesting_level", level=level, max=8)
        elif word in LEGACY:
            self.warn("unsupported_list_control", control_word=word)
            self.drop(why.LEGACY_NUMBERING)
        elif word in ("sect", "pgnrestart", "pgnstarts", "pgndec", "pgnlcrm", "pgnucrm"):
            self.section_word(word, n)
        elif word in ("field", "fldinst", "fldrslt"):
            self.field_word(word)
        elif word in PICTURE or word in ("pngblip", "jpegblip"):
            if self.picture is not None:
                if word in PICTURE:
                    self.picture[PICTURE[word]] = n
                else:
                    self.picture["format"] = word[:-4]
        elif word not in SILENT and word not in ("shppict", "nonshppict", "pict", "bkmkstart") and not self.table_word(word, n):
            self.warn("unsupported_control_word", word=word, **({"parameter": n} if n is not None else {}))

    def section_word(self, word: str, n: int | None) -> None:
        now = self.sections[-1]
        if word == "sect":
            self.end_paragraph()
            self.sections.append({"index": len(self.sections), "restart_page_numbering": False, "number_format": now["number_format"]})
        elif word == "pgnrestart":
            now["restart_page_numbering"] = True
        elif word == "pgnstarts":
            now.pop("start_page", None)
            if n is not None and n > 0:
                now["start_page"] = n
            elif n is not None:
                self.warn("section_numbering_fallback", reason=why.PAGE_START)
        else:
            now["number_format"] = {"pgndec": "arabic", "pgnlcrm": "roman_lower", "pgnucrm": "roman_upper"}[word]

    # ---- tables of resources, within skipped groups

    def read_fonts(self):
        entry: dict = {}

        def inside(kind, value, n, depth):
            if kind == "open" and depth == 2:
                entry.clear()
            elif kind == "word" and value == "f":
                entry["index"] = n or 0
            elif kind == "text":
                entry["name"] = entry.get("name", "") + value
            elif kind == "close" and depth == 2:
                name = entry.get("name", "").strip().removesuffix(";").strip()
                if "index" in entry and name:
                    if self.raw is not None:
                        self.raw["fonts"].append({"font_idx": entry["index"], "pos": len(self.raw["fonts"]), "family": name})
                    self.fonts[entry["index"]] = name
                entry.clear()

        return inside

    def read_colors(self):
        self.colors, entry = [], {}

        def inside(kind, value, n, depth):
            if kind == "word" and n is not None:
                if value in ("red", "green", "blue", "ctint", "cshade"):
                    entry[value] = min(max(n, 0), 255)
                elif value == "themecolor":
                    entry["theme"] = n if 0 <= n < len(colors.THEME) else None
            elif kind == "text":
                for _ in range(value.count(";")):
                    if entry.keys() & {"red", "green", "blue"}:
                        self.colors.append(tuple(entry.get(c, 0) for c in ("red", "green", "blue")))
                    elif entry.get("theme") is not None:
                        self.colors.append(colors.theme_color(entry["theme"], entry.get("ctint"), entry.get("cshade")))
                    else:
                        self.colors.append(None)
                    entry.clear()

        return inside

    def read_lists(self):
        state: dict = {}

        def inside(kind, value, n, depth):
            if kind == "word":
                if value == "list":
                    state.update(id=0, levels=[])
                elif value == "listlevel":
                    state["level"] = "bullet"
                elif value == "levelnfc":
                    if n is not None and "level" in state:
                        state["level"] = "ordered_decimal" if 0 <= n <= 4 else "bullet"
                elif value == "listid":
                    if n is not None and "id" in state:
                        state["id"] = n
                elif value not in LIST_SILENT and value not in ("ls", "listoverride"):
                    self.warn("unsupported_list_control", control_word=value)
            elif kind == "close" and depth == 2 and "id" in state:
                self.lists[state["id"]] = state["levels"]
                state.clear()
            elif kind == "close" and depth == 3 and "level" in state and "id" in state:
                state["levels"].append(state.pop("level"))

        return inside

    def read_overrides(self):
        state: dict = {}

        def inside(kind, value, n, depth):
            if kind == "word":
                if value == "listoverride":
                    state.update(ls=0, id=0)
                elif value in ("ls", "listid"):
                    if n is not None and state:
                        state["ls" if value == "ls" else "id"] = n
                elif value not in LIST_SILENT:
                    self.warn("unsupported_list_control", control_word=value)
            elif kind == "close" and depth == 2 and state:
                self.overrides[state["ls"]] = state["id"]
                state.clear()

        return inside

    # ---- channels, bookmarks, pictures

    def redirect(self, name: str, into: list, note: dict | None = None) -> None:
        """Until the group ends, blocks go to another channel; the paragraph that was begun waits."""
        self.flush()
        kept = self.inlines, self.text, self.alignment
        self.inlines, self.text = [], ""
        self.sinks.append((name, into))

        def back():
            self.end_paragraph()
            if self.tables:  # one that was begun in the channel, or around it
                self.end_table()
            self.sinks.pop()
            if note and into:
                self.notes.append({**note, "blocks": into})
            self.inlines, self.text, self.alignment = kept
            self.run_style = self.style

        self.groups[-1].at_end.append(back)

    def end_bookmark(self) -> None:
        self.refers = True
        name, self.bookmark = (self.bookmark or "").strip(), None
        if name:
            self.start_paragraph()
            self.flush()
            inside = self.field is not None and self.field.reading == "fldrslt"
            (self.field.results if inside else self.inlines).append({"type": "bookmark_anchor", "name": name})

    def end_picture(self) -> None:
        p, self.picture = self.picture, None
        raw = "".join(p["hex"])
        digits = re.sub("[ \t\n\r\f]", "", raw)
        if "format" not in p:
            self.drop(why.IMAGE_FORMAT, len(raw))
        elif len(digits) % 2 or re.search("[^0-9a-fA-F]", digits):
            self.drop(why.IMAGE_HEX, len(raw))
        else:
            data = bytes.fromhex(digits)
            self.image_bytes += len(data)
            if self.image_bytes > self.limits.max_image_bytes_total:
                raise InvalidDocument("image_bytes_exceeded", f"{self.image_bytes} bytes of images, at most {self.limits.max_image_bytes_total}")
            block = {"type": "imageblock", "format": p["format"], "data": list(data)}
            for side, name in (("w", "width_twips"), ("h", "height_twips")):
                size = p[side + "goal"] if p.get(side + "goal") is not None else p.get(side)
                scale = p.get("scalex" if side == "w" else "scaley") or 100
                scaled = max(size or 0, 0) * (scale if scale > 0 else 100) // 100
                if scaled > 0:
                    block[name] = scaled
            self.place(block)

    # ---- fields

    def field_word(self, word: str) -> None:
        if not self.groups:  # after the last group nothing would end it
            return
        if word == "field":
            self.flush()
            if self.field is None:
                self.field = Field(self.run_style)
                self.groups[-1].at_end.append(self.end_field)
            else:
                self.field.nested.append("")
                self.groups[-1].at_end.append(self.end_nested)
        elif self.field is not None:
            if self.field.nested:
                self.field.nested[-1] = word
                self.groups[-1].at_end.append(self.end_nested_part)
            else:
                self.field.reading = word
                self.groups[-1].at_end.append(self.end_part)

    def end_part(self) -> None:
        if self.field:
            self.flush()
            self.field.reading = None

    def end_nested_part(self) -> None:
        if self.field and self.field.nested:
            self.flush()
            self.field.nested[-1] = ""

    def end_nested(self) -> None:
        if self.field and self.field.nested:
            self.field.nested.pop()

    def end_field(self) -> None:
        f = self.field
        if f is None:
            return
        self.refers = True
        self.flush()
        self.field = None
        said, results = f.instruction.strip(), f.results
        family, reference, odd = fields.parse(said) or (None, None, [])
        if results or family in ("page", "semantic", "toc"):
            self.start_paragraph()
        visible = "".join(shown(x) for x in results).strip()
        if family == "hyperlink" and (reference["type"] == "internal_bookmark" or fields.supported_url(reference["value"])):
            self.link(reference, results)
        elif family == "hyperlink":
            self.inlines += results
            self.drop(why.LINK_SCHEME)
        elif family == "page":
            if reference["kind"] == "page_ref" and visible:
                reference["fallback_text"] = visible
            self.inlines.append({"type": "page_field", **reference})
        elif family == "semantic":
            if visible:
                reference["fallback_text"] = visible
            other = any(x["type"] != "run" for x in results)
            runs = [r for x in results for r in projected(x)]
            self.inlines.append({"type": "semantic_field", "reference": reference, "runs": runs, "has_non_run_content": other})
            if reference["kind"] == "merge_field":
                self.warn("unsupported_field", reason=why.MERGE_FIELD)
            if other:
                self.warn("unsupported_field", reason=why.FIELD_DOWNGRADED)
        elif family == "toc":
            for switch in odd:
                self.warn("unsupported_toc_switch", switch=switch)
            self.inlines.append({"type": "generated_block_marker", "kind": reference})
        else:
            self.inlines += results
            if said.upper().startswith("HYPERLINK"):
                self.drop(why.LINK_URL if results else why.FIELD_WITHOUT_RESULT)
            elif said and results:
                self.warn("unsupported_field", reason=why.FIELD_UNRECOGNIZED)
            elif said:
                self.drop(why.UNSUPPORTED_WITHOUT_RESULT)
            else:
                self.drop(why.FIELD_WITHOUT_INSTRUCTION if results else why.FIELD_WITH_NEITHER)
        self.run_style = f.style

    def link(self, target: dict, results: list[dict]) -> None:
        """Runs next to one another share a link; what isn't a run stands between links."""
        before, open_link = len(self.inlines), None
        for x in results:
            if x["type"] == "run":
                if open_link is None:
                    open_link = {"type": "hyperlink", "target": dict(target), "runs": []}
                    self.inlines.append(open_link)
                open_link["runs"].append({k: v for k, v in x.items() if k != "type"})
            else:
                open_link = None
                self.inlines.append(x)
        if not any(x["type"] == "hyperlink" for x in self.inlines[before:]):
            self.drop(why.LINK_WITHOUT_RUNS if results else why.FIELD_WITHOUT_RESULT)

    # ---- tables

    def table_word(self, word: str, n: int | None) -> bool:
        d = self.tables[-1].define if self.tables else RowDef()
        if word == "trowd":
            self.row_definition()
        elif word == "cellx":
            if n is not None:
                d.commit()
                d.right.append(n)
                d.cells.append(d.cell)
                d.cell = {}
        elif word == "intbl":
            self.intbl = True
        elif word == "itap":
            self.itap = n
        elif word == "nesttableprops":
            self.nested_props = True
        elif word in ("trql", "trqc", "trqr"):
            d.row["alignment"] = {"l": "left", "c": "center", "r": "right"}[word[-1]]
        elif word in ("trleft", "trgaph"):
            if n is not None:
                d.row["left_indent" if word == "trleft" else "cell_gap_twips"] = n if word == "trleft" else max(n, 0) * 2
        elif word == "trrh":
            d.row["height"] = n
        elif word in ("trftswidth", "trwwidth"):
            d.row[word[2:]] = n
            if self.tables:
                self.tables[-1].pending.setdefault(word[2:], n)
        elif word in ("clftswidth", "clwwidth"):
            d.cell[word[2:]] = n
        elif m := re.fullmatch("(tr|cl)pad(d?)(f?)([ltrb])", word):
            if (m[1] == "tr") != bool(m[2]):
                return False
            if m[3] and n != 3:
                self.warn("unsupported_table_control", control_word=word)
            (d.row if m[1] == "tr" else d.cell).setdefault("fmt" if m[3] else "pad", {})[SIDES[m[4]]] = n
        elif word in ("clvertalt", "clvertalc", "clvertalb"):
            d.cell["v_align"] = {"t": "top", "c": "center", "b": "bottom"}[word[-1]]
        elif word in MERGES:
            d.cell["merge"] = MERGES[word]
        elif m := re.fullmatch("(cl|tr)(cbpat|cfpat|shdng)", word):
            name = "shading" if m[2] == "shdng" else m[2]
            (d.cell if m[1] == "cl" else d.row)[name] = n
            if m[1] == "tr" and self.tables:
                self.tables[-1].pending.setdefault(name, n)
        elif m := re.fullmatch("(cl|tr)brdr([tlbrhv])", word):
            if m[1] == "cl" and m[2] in "hv":
                return False
            d.commit()
            d.border["target"] = ("cell" if m[1] == "cl" else "row", SIDES[m[2]])
        elif word in BORDERS or word in ("brdrw", "brdrcf"):
            d.border["style" if word in BORDERS else "width" if word == "brdrw" else "color"] = BORDERS[word] if word in BORDERS else max(n, 0) if word == "brdrw" and n is not None else n
        else:
            return False
        return True

    def row_definition(self) -> None:
        depth = max(self.itap if self.itap is not None else 2 if self.nested_props else 1, 1)
        self.itap, self.nested_props = None, False
        while len(self.tables) > depth and len(self.tables) > 1:
            self.end_table()
        if not self.tables and depth > 1:
            self.malformed(why.NESTED_OUTSIDE)
        while self.tables and len(self.tables) < depth:
            if len(self.tables) >= self.limits.max_table_nesting_depth:
                raise InvalidDocument("invalid_structure", f"Table nesting depth exceeds maximum {self.limits.max_table_nesting_depth}")
            if self.tables[-1].row is None:
                self.malformed(why.NESTED_OUTSIDE)
                break
            self.end_paragraph()
            self.cell()
            self.begin_table()
        if self.tables and self.tables[-1].row is not None:
            self.auto_close_cell(why.CELL_AT_ROW_BOUNDARY)
            self.warn("unclosed_table_row")
            self.drop(why.ROW_AT_NEW_ROW)
            self.end_row()
        if not self.tables:  # text that waits goes to the first cell
            self.begin_table()
        self.tables[-1].define, self.tables[-1].row, self.tables[-1].cell = RowDef(), [], None

    def begin_table(self) -> None:
        self.tables.append(Table(self.table_count))
        self.table_count += 1

    def auto_close_cell(self, reason: str) -> None:
        if self.text or self.inlines or self.tables[-1].cell is not None:
            self.warn("unclosed_table_cell")
            self.drop(reason)
            self.end_paragraph()
            self.end_cell()

    def finish_children(self) -> None:
        while len(self.tables) > 1 and self.tables[-1].row is None:
            self.end_table()

    def end_cell_word(self) -> None:
        self.finish_children()
        if not self.tables or self.tables[-1].row is None:
            self.malformed(why.CELL_OUTSIDE)
            self.drop(why.CELL_CONTROL_OUTSIDE)
            self.end_paragraph()
            return
        self.end_paragraph()
        self.end_cell()

    def end_row_word(self) -> None:
        self.finish_children()
        if not self.tables or self.tables[-1].row is None:
            self.malformed(why.ROW_OUTSIDE)
            self.drop(why.ROW_CONTROL_OUTSIDE)
            return
        self.tables[-1].define.commit()
        self.auto_close_cell(why.CELL_AT_ROW_END)
        self.end_row()
        self.intbl = False

    def end_cell(self) -> None:
        t = self.tables[-1]
        cell, d, i = self.cell(), t.define, len(t.row)
        t.cell = None
        said = d.cells[i] if i < len(d.cells) else {}
        if i < len(d.right):
            width = d.right[i] - (d.right[i - 1] if i else 0)
            if width > 0 or not i and d.right[i] > 0:
                cell["width_twips"] = width
            else:
                self.malformed(why.CELL_EDGES.format(i))
        for name in ("merge", "v_align"):
            if name in said:
                cell[name] = said[name]
        for source in (said, d.row, t.pending):
            if shading := self.shaded(source.get("cbpat"), source.get("cfpat"), source.get("shading")):
                cell["shading"] = shading
                break
        if borders := self.borders(said):
            cell["borders"] = borders
        if width := self.width(said, "clftswidth"):
            cell["preferred_width"] = width
        own, row = padding(said), padding(d.row)
        if own or row:
            cell["padding"] = {s: own.get(s, row.get(s)) for s in ("top", "right", "bottom", "left") if s in own or s in row}
        if self.raw is not None:
            self.raw["cells"].append(raw_cell(t, i, said, cell))
        t.row.append(cell)

    def borders(self, said: dict) -> dict | None:
        out = {}
        for side, b in said.get("borders", {}).items():
            out[side] = {"style": b["style"] or "single"}
            if b["width"] is not None:
                out[side]["width_half_pts"] = b["width"]
            if color := self.color(b["color"]):
                out[side]["color"] = color
        return out or None

    def width(self, said: dict, word: str) -> dict | None:
        fts, w = said.get("ftswidth"), said.get("wwidth")
        if fts is None:
            return None
        if fts in (0, 1):
            return {"type": "auto"}
        if fts == 2:
            return {"type": "percent", "value": min(max(w or 0, 0), 10_000)}
        if fts == 3:
            return {"type": "twips", "value": w or 0}
        self.warn("unsupported_table_control", control_word=word)
        return None

    def end_row(self) -> None:
        t = self.tables[-1]
        d, cells = t.define, t.row
        t.row = None
        if d.right and len(cells) != len(d.right):
            self.malformed(why.CELL_COUNTS.format(len(cells), len(d.right)))
            self.drop(why.CELL_COUNT_MISMATCH)
        props = {k: d.row[k] for k in ("alignment", "left_indent", "cell_gap_twips") if k in d.row}
        if shading := self.shaded(d.row.get("cbpat"), d.row.get("cfpat"), d.row.get("shading")):
            props["shading"] = shading
        if borders := self.borders(d.row):
            props["borders"] = borders
        if height := d.row.get("height"):
            props |= {"height_rule": "at_least" if height > 0 else "exact", "height_twips": abs(height)}
        if pad := padding(d.row):
            props["default_padding"] = pad
        self.merge(cells)
        for cell in cells:
            if not cell["blocks"]:
                del cell["blocks"]
        if len(cells) > self.limits.max_cells_per_row:
            raise InvalidDocument("invalid_structure", f"Row has {len(cells)} cells, maximum is {self.limits.max_cells_per_row}")
        if len(t.rows) >= self.limits.max_rows_per_table:
            raise InvalidDocument("invalid_structure", f"Table has {len(t.rows) + 1} rows, maximum is {self.limits.max_rows_per_table}")
        t.rows.append({"cells": cells, **({"row_props": props} if props else {})})

    def merge(self, cells: list[dict]) -> None:
        """A start takes the continuations right after it; a start of none, and a continuation without start, stand alone."""
        starts = lambda c: isinstance(c.get("merge"), dict)
        i = 0
        while i < len(cells):
            if starts(cells[i]):
                to = i + 1
                while to < len(cells) and cells[to].get("merge") == "horizontal_continue":
                    to += 1
                if to - i > 1:
                    cells[i]["merge"] = {"horizontal_start": {"span": to - i}}
                    if to - i > self.limits.max_merge_span:
                        raise InvalidDocument("invalid_structure", f"Merge span {to - i} exceeds maximum {self.limits.max_merge_span}")
                else:
                    del cells[i]["merge"]
                i = to
                continue
            if cells[i].get("merge") == "horizontal_continue":
                del cells[i]["merge"]
                self.warn("merge_conflict", reason=why.ORPHAN_MERGE)
                self.drop(why.MERGE_SEMANTICS)
            i += 1

    def end_table(self) -> None:
        t = self.tables[-1]
        if t.row is not None:
            self.auto_close_cell(why.CELL_AT_DOCUMENT_END)
            self.warn("unclosed_table_row")
            self.drop(why.ROW_AT_END)
            self.end_row()
        self.tables.pop()
        if not t.rows:
            return
        block, props = {"type": "tableblock", "rows": t.rows}, {}
        if shading := self.shaded(t.pending.get("cbpat"), t.pending.get("cfpat"), t.pending.get("shading")):
            props["shading"] = shading
        if width := self.width(t.pending, "trftswidth"):
            props["preferred_width"] = width
        if props:
            block["table_props"] = props
        if self.tables:
            self.cell()["blocks"].append(block)
        else:
            self.sinks[-1][1].append(block)

    # ---- the whole document

    def finished(self) -> dict:
        generated, blocks = [], []
        for b in self.blocks:
            if b["type"] == "paragraph":
                for x in b["inlines"]:
                    if x["type"] == "generated_block_marker":
                        generated.append({"insertion_index": len(blocks), "kind": x["kind"], "explicit": True})
                b["inlines"] = [x for x in b["inlines"] if x["type"] != "generated_block_marker"]
                if not b["inlines"]:
                    continue
            blocks.append(b)
        if not generated and sum(b["type"] == "paragraph" and heading(b) for b in blocks) >= 3:
            generated.append({"insertion_index": 0, "kind": {"type": "table_of_contents", "options": {"levels": [1, 3], "hyperlinks": True}}, "explicit": False})
        channels = {k: v for k, v in self.channels.items() if v}
        out = {"blocks": blocks}
        if channels or self.notes:
            out["structure"] = {
                **{f"{part}s": {k.split("_")[1]: v for k, v in channels.items() if k.startswith(part)} for part in ("header", "footer")},
                **({"notes": self.notes} if self.notes else {}),
            }
        paged = False
        if self.refers:
            everything = [blocks, *channels.values(), *(n["blocks"] for n in self.notes)]
            self.resolve(everything)
            paged = any(x["type"] == "page_field" for part in everything for x in all_inlines(part))
        if paged or generated or len(self.sections) > 1 or channels:
            out["page_management"] = {"sections": self.sections, "running_content": {f"{p}_{s}": f"{p}_{s}" in channels for p in ("header", "footer") for s in ("default", "first", "even")}, **({"generated_blocks": generated} if generated else {})}
        return out

    def resolve(self, everything: list[list]) -> None:
        """References to bookmarks that no paragraph has are marked, and each target is warned of once."""
        marks = {x["name"] for part in everything for x in all_inlines(part) if x["type"] == "bookmark_anchor"}
        warned = set()
        for part in everything:
            for x in all_inlines(part):
                if x["type"] == "semantic_field" and x["reference"]["kind"] in ("ref", "note_ref") and (target := x["reference"]["target"]) not in marks:
                    x["resolved"] = False
                    if target not in warned:
                        warned.add(target)
                        self.warn("unresolved_cross_reference", target=target)


def raw_cell(t: Table, i: int, said: dict, cell: dict) -> dict:
    """What the words say of a cell, its row and its table, unresolved; widths of borders alone, 1 where none is given."""
    d = t.define
    width = lambda owner, side: None if (b := owner.get("borders", {}).get(side)) is None else 1 if b["width"] is None else b["width"]
    merge = said.get("merge")
    sides = ("top", "left", "bottom", "right")
    return {
        "table": t.number, "row": len(t.rows), "col": i, "right": d.right[i] if i < len(d.right) else None, "n_right": len(d.right), "merge": "horizontal_start" if isinstance(merge, dict) else merge, "cell_fill": said.get("cbpat"), "row_fill": d.row.get("cbpat"),
        "table_fill": t.pending.get("cbpat"), "percent": said.get("shading"), **{s: width(said, s) for s in sides[:3]}, "right_border": width(said, "right"), **{f"row_{s}": width(d.row, s) for s in sides}, "row_h": width(d.row, "inside_h"), "row_v": width(d.row, "inside_v"),
        "text": "\n".join("".join(map(shown, b["inlines"])) for b in cell.get("blocks", []) if b["type"] == "paragraph"),
    }


def padding(said: dict) -> dict:
    return {side: n for side, n in said.get("pad", {}).items() if n is not None and said.get("fmt", {}).get(side) in (None, 3)}


def shown(x: dict) -> str:
    """What a reader sees of an inline."""
    return "".join(r["text"] for r in projected(x))


def projected(x: dict) -> list[dict]:
    """An inline as runs."""
    plain = lambda text: {"text": text, **dict.fromkeys(FLAGS, False)}
    if x["type"] == "run":
        return [{k: v for k, v in x.items() if k != "type"}]
    if x["type"] == "hyperlink":
        return x["runs"]
    if x["type"] == "page_field":
        return [plain(x.get("fallback_text") or x["target"] if x["kind"] == "page_ref" else "1")]
    if x["type"] == "semantic_field":
        r = x["reference"]
        return x["runs"] or [plain(r.get("fallback_text") or r.get("target") or r.get("identifier") or r["name"])]
    return [plain(str(x["id"]))] if x["type"] == "note_ref" else []


def heading(block: dict) -> bool:
    """Bold somewhere, 13 points or more somewhere, at most 140 bytes that begin with a digit or a capital, and no bookmark."""
    runs = [r for x in block["inlines"] for r in (x["runs"] if x["type"] == "hyperlink" else [x] if x["type"] == "run" else [])]
    text = "".join(r["text"] for r in runs).strip()
    bold, large = any(r["bold"] for r in runs), max((r.get("font_size", 0) for r in runs), default=0) >= 13
    return bold and large and bool(re.match("[0-9A-Z]", text)) and len(text.encode()) <= 140 and all(x["type"] != "bookmark_anchor" for x in block["inlines"])


def children(block: dict) -> list[list[dict]]:
    if block["type"] == "listblock":
        return [item["blocks"] for item in block["items"]]
    return [c.get("blocks", []) for row in block["rows"] for c in row["cells"]] if block["type"] == "tableblock" else []


def all_inlines(blocks: list[dict]):
    for b in blocks:
        yield from b.get("inlines", ())
        for part in children(b):
            yield from all_inlines(part)
