"""Field instructions: what a field's instruction text asks for."""

from __future__ import annotations

import re

WORD = re.compile(r'"((?:[^"\\]|\\.)*)"?|(\S+)', re.S)
SWITCHES_WITH_VALUE = {"REF": "df", "NOTEREF": "", "SEQ": "rs", "HYPERLINK": "lmot"}
#: Fields that are document properties under their own name.
PROPERTIES = ("AUTHOR", "TITLE", "SUBJECT", "KEYWORDS")
PAGE_FIELDS = {"PAGE": "current_page", "NUMPAGES": "total_pages", "SECTIONPAGES": "section_pages"}


def split_words(text: str) -> list[tuple[str, bool]]:
    """Words and whether they were quoted; within quotes a backslash protects the next character."""
    return [(re.sub(r"\\(.)", r"\1", m[1], flags=re.S), True) if m[1] is not None else (m[2], False) for m in WORD.finditer(text)]


def positional(words: list[tuple[str, bool]], with_value: str) -> list[str]:
    """The arguments that are neither switches nor a switch's value."""
    found, skip = [], False
    for word, quoted in words:
        if skip:
            skip = False
        elif not quoted and word.startswith("\\"):
            skip = len(word) == 2 and word[1].lower() in with_value
        else:
            found.append(word)
    return found


def page_format(text: str) -> str:
    return "roman_upper" if "\\* ROMAN" in text else "roman_lower" if "\\* roman" in text else "arabic"


def hyperlink(words: list[tuple[str, bool]]) -> dict | None:
    url, skip, bookmark = None, None, None
    for word, quoted in words:
        if skip:
            bookmark = word if skip == "l" else bookmark
            skip = None
        elif not quoted and word.startswith("\\"):
            skip = word[1:2].lower() if word[1:2].lower() in SWITCHES_WITH_VALUE["HYPERLINK"] else None
        elif url is None:
            url = word
    if bookmark:
        return {"type": "internal_bookmark", "value": bookmark}
    return {"type": "external_url", "value": url} if url else None


def toc(words: list[tuple[str, bool]]) -> tuple[dict, list[str]]:
    options, odd, i = {"levels": [1, 3], "hyperlinks": True}, [], 0
    while i < len(words):
        word, quoted = words[i]
        i += 1
        if quoted or not word.startswith("\\"):
            continue
        value = words[i][0] if i < len(words) and (words[i][1] or not words[i][0].startswith("\\")) else None
        if word.lower() == "\\o":
            if value is not None:
                i += 1
                if (m := re.fullmatch(r"\s*(\d+)\s*-\s*(\d+)\s*", value)) and 1 <= int(m[1]) <= int(m[2]) <= 255:
                    options["levels"] = [int(m[1]), int(m[2])]
        elif word.lower() == "\\h":
            options["hyperlinks"] = True
        elif word == "\\*":
            i += value is not None
        else:
            odd.append(word)
            i += value is not None
    return options, odd


def parse(text: str) -> tuple[str, dict, list[str]] | None:
    """(family, reference, unsupported switches); families are hyperlink, semantic, page and toc. None: no field that is known."""
    words = split_words(text.strip())
    if not words or words[0][1]:
        return None
    name, rest = words[0][0].upper(), words[1:]
    if name == "HYPERLINK":
        target = hyperlink(rest)
        return ("hyperlink", target, []) if target else None
    first = next(iter(positional(rest, SWITCHES_WITH_VALUE.get(name, ""))), None)
    if name in ("REF", "NOTEREF", "SEQ", "DOCPROPERTY", "MERGEFIELD"):
        if not first:
            return None
        kind, key = {"REF": ("ref", "target"), "NOTEREF": ("note_ref", "target"), "SEQ": ("sequence", "identifier"), "DOCPROPERTY": ("doc_property", "name"), "MERGEFIELD": ("merge_field", "name")}[name]
        return "semantic", {"kind": kind, key: first}, []
    if name in PROPERTIES:
        return "semantic", {"kind": "doc_property", "name": name}, []
    if name in PAGE_FIELDS:
        return "page", {"kind": PAGE_FIELDS[name], "format": page_format(text)}, []
    if name == "PAGEREF":
        return ("page", {"kind": "page_ref", "target": first, "format": page_format(text)}, []) if first else None
    if name == "TOC":
        options, odd = toc(rest)
        return "toc", {"type": "table_of_contents", "options": options}, odd
    return None


def supported_url(url: str) -> bool:
    return re.match(r"(?i)\s*(https?://|mailto:)", url) is not None
