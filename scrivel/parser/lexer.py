"""Tokens of a document. The pattern is the one the DataFrame tokenizer uses."""

from __future__ import annotations

import re

#: In this order: group, byte in hexadecimal, control word, control symbol, text without control characters.
PATTERN = r"[{}]|\\'[0-9a-fA-F]{2}|\\[A-Za-z]+(?:-?[0-9]+)? ?|\\[^A-Za-z]|[^\\{}\x00-\x1f\x7f-\x9f]+"
TOKEN = re.compile(PATTERN, re.S)
WORD = re.compile(r"\\([A-Za-z]+)(-?[0-9]+)? ?")
BLANK = "\n\r\t"
#: Characters of Windows-1252 between 0x80 and 0x9F; the five bytes that it leaves open stay as they are.
CP1252 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def windows_1252(byte: int) -> str:
    return CP1252.get(byte, chr(byte))


class InvalidDocument(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


OPEN, CLOSE = ("open", None, None), ("close", None, None)


def other(t: str) -> tuple:
    """A token that begins with a backslash."""
    if (w := WORD.fullmatch(t)) is not None:
        n = int(w[2]) if w[2] else None
        return "word", w[1], n if n is None or -(2**31) <= n < 2**31 else None
    return ("text", windows_1252(int(t[2:], 16)), None) if t[1] == "'" and len(t) == 4 else ("symbol", t[1], None)


class Known(dict):
    """Tokens that were met; control words are few, so it stays small, and is begun anew where they aren't."""

    def __missing__(self, t: str) -> tuple:
        if len(self) > 50_000:
            self.clear()
        self[t] = found = OPEN if t == "{" else CLOSE if t == "}" else other(t)
        return found


KNOWN = Known()


def tokens(text: str) -> list[tuple]:
    """(kind, value, parameter); kinds are open, close, word, symbol and text. A byte in hexadecimal is text."""
    found = TOKEN.findall(text)
    if sum(map(len, found)) != len(text) and TOKEN.sub("", text).strip(BLANK):
        at = 0
        for m in TOKEN.finditer(text):
            if text[at : m.start()].strip(BLANK):
                break
            at = m.end()
        raise InvalidDocument("tokenization", f"unexpected character at {at}")
    known = KNOWN
    return [known[t] if t[0] in "\\{}" else ("text", t, None) for t in found]


def validate(found: list[tuple]) -> None:
    if not found:
        raise InvalidDocument("empty_input", "the document is empty")
    depth = 0
    for kind, _, _ in found:
        depth += (kind == "open") - (kind == "close")
        if depth < 0:
            raise InvalidDocument("unmatched_group_end", "a group ends that never began")
    if depth:
        raise InvalidDocument("unbalanced_groups", "a group never ends")
    solid = [t for t in found if not (t[0] == "text" and not t[1].strip())][:2]
    if len(solid) < 2 or solid[0][0] != "open" or solid[1][:2] != ("word", "rtf"):
        raise InvalidDocument("missing_rtf_header", "the document doesn't begin with {\\rtf")
