"""What tokens alone say of a document, each in one pass over its text: groups, hidden destinations, visible characters, style in force.

Nested tables, redirected channels, what fields refer to and the order of warnings need the reader. Control characters and what else is
no token is passed over here; `lexer.tokens` refuses it.
"""

from __future__ import annotations

import re
from functools import lru_cache

from scrivel.parser.lexer import PATTERN, TOKEN, WORD, windows_1252
from scrivel.parser.reader import CHANNELS, DROPPED, METADATA, TABLES

#: Destinations whose text a reader doesn't show in the body.
HIDDEN = frozenset(METADATA | DROPPED | {*TABLES, *CHANNELS, "bkmkend", "bkmkstart", "footnote", "endnote", "pict", "fldinst"})
#: Destinations whose text is shown elsewhere.
REDIRECTED = frozenset({*CHANNELS, "footnote", "endnote"})
#: Destinations that a reader knows, though a \* stands before them.
KNOWN = frozenset(("shppict", "nonshppict", "fldrslt"))
SYMBOLS = {"\\": "\\", "{": "{", "}": "}", "~": "\xa0", "_": "\u2011"}
#: A run of escapes, each with a question mark in place of its character, is met as one.
PIECE = re.compile(rf"(?:\\u-?[0-9]+ ?\?)+|{PATTERN}", re.S)
ESCAPE = re.compile(r"-?[0-9]+")
WORDS = re.compile(r"\\([A-Za-z]+)(-?[0-9]+)? ?")


def units(run: str) -> str:
    """The characters of a run of escapes; surrogates of one character are joined, a lone one is none."""
    codes = b"".join((int(n) & 0xFFFF).to_bytes(2, "big") for n in ESCAPE.findall(run))
    return codes.decode("utf-16-be", "ignore")


def hides(found: list[str], i: int) -> bool:
    """Whether the group that opens at token i is a hidden destination: its first word, after an optional \\*, says so."""
    n = len(found)
    word = WORD.fullmatch(found[i + 1]) if i + 1 < n else None
    if word:
        return word[1] in HIDDEN
    if i + 2 < n and found[i + 1] == "\\*":
        word = WORD.fullmatch(found[i + 2])
        return bool(word) and word[1] not in KNOWN
    return False


def visible(text: str):
    """The shown pieces in order: characters, "\\n" for the end of a paragraph or line, and None before and after each group and style word; with each None a token."""
    found = PIECE.findall(text)
    depth, skip_above, fallback = 0, None, False
    for i, t in enumerate(found):
        first = t[0]
        if first == "{":
            depth += 1
            if skip_above is None:
                if hides(found, i):
                    skip_above = depth
                else:
                    yield None, t
            fallback = False
        elif first == "}":
            if skip_above is None:
                yield None, t
            elif depth == skip_above:
                skip_above = None
            depth -= 1
            fallback = False
        elif skip_above is not None:
            continue
        elif first != "\\":
            yield (t[1:] if fallback else t), t
            fallback = False
        elif t[1] == "u" and t[-1] == "?":
            yield units(t), t
            fallback = False
        elif word := WORD.fullmatch(t):
            fallback = word[1] == "u" and word[2] is not None
            if fallback:
                yield units(word[2]), t
            elif word[1] in ("par", "line"):
                yield "\n", t
            else:
                yield None, t
        elif t[1] == "'" and len(t) == 4:
            ch = windows_1252(int(t[2:], 16))
            yield ("" if fallback else ch), t
            fallback = False
        else:
            fallback = False
            if t[1] in SYMBOLS:
                yield SYMBOLS[t[1]], t


def shown_text(text: str) -> str:
    """Paragraphs of the body, joined by line ends."""
    return "".join([piece for piece, _ in visible(text) if piece])


def rows_of_cells(text: str) -> list[list[str]]:
    """The texts of cells, row by row, of tables that aren't nested in one another; paragraphs of a cell are parted by line ends. Cells of a row that doesn't end are none."""
    rows: list[list[str]] = []
    cells: list[str] = []
    held: list[str] = []
    for piece, t in visible(text):
        if piece is not None:
            held.append(piece)
        elif t.startswith("\\cell") and WORDS.fullmatch(t)[1] == "cell":
            cells.append("".join(held))
            held.clear()
        elif t.startswith(("\\row", "\\trowd")) and (word := WORDS.fullmatch(t)[1]) in ("row", "trowd"):
            if word == "row":
                rows.append(cells)
            cells = []
            held.clear()
    return rows


def styled(text: str, words: dict[str, str], reset: str) -> list[tuple]:
    """(number of the piece, characters, value of each property) of the pieces of equal style. words: control word to property; `reset` sets every property to null. A group's end brings back what held before it."""
    names = sorted(set(words.values()))
    state: dict = dict.fromkeys(names)
    stack: list[dict] = []
    out: list[tuple] = []
    held: list[str] = []

    def flush():
        if held:
            out.append((len(out), "".join(held), *(state[n] for n in names)))
            held.clear()

    for piece, t in visible(text):
        if piece is not None:
            if piece != "\n":
                held.append(piece)
        elif t == "{":
            stack.append(state)
        elif t == "}":
            if stack:
                before = stack.pop()
                if before != state:
                    flush()
                state = before
        elif word := WORDS.fullmatch(t):
            if word[1] == reset:
                new = dict.fromkeys(names)
            elif word[1] in words:
                new = {**state, words[word[1]]: int(word[2]) if word[2] else 1}
            else:
                continue
            if new != state:
                flush()
                state = new
    flush()
    return out


def grouped(text: str, around: list[tuple[int, bool]] = (), at: int = 0) -> list[tuple]:
    """(pos, kind, word, param, text, depth, level, group, hidden) of each token.

    depth is that after the token, level that of the group it belongs to, its braces included; group is the position of that group's opening; hidden: whether the group, or one around it, is a hidden destination.
    around: the groups, (position, hides) each, that are open where the text begins, outermost first, if it is a slice; at: the number of tokens before it.
    """
    found = TOKEN.findall(text)
    out, stack = [], []
    for pos, hidden in around:
        stack.append((pos, bool(stack and stack[-1][1]) or hidden))
    for i, t in enumerate(found):
        pos = at + i
        first, word, param, said = t[0], None, None, None
        if first == "{":
            kind = "open"
            stack.append((pos, bool(stack and stack[-1][1]) or hides(found, i)))
        elif first == "}":
            kind = "close"
        elif first != "\\":
            kind, said = "text", t
        elif m := WORD.fullmatch(t):
            kind, word = "word", m[1]
            param = int(m[2]) if m[2] else None
            if param is not None and not -(2**31) <= param < 2**31:
                param = None
        elif t[1] == "'" and len(t) == 4:
            kind, said = "text", windows_1252(int(t[2:], 16))
        else:
            kind, said = "symbol", t[1]
        level = len(stack)
        group, hidden = stack[-1] if stack else (None, False)
        if kind == "close" and stack:
            stack.pop()
        out.append((pos, kind, word, param, said, len(stack), level, group, hidden))
    return out


def pieces(found: list[tuple]) -> list[str | None]:
    """What each token of grouped() shows: characters, "\\n" for the end of a paragraph or line, None for nothing. The one character after an escape stands in its place; two surrogates are one character, shown by the second."""
    out: list[str | None] = []
    fallback, high = False, None
    for _, kind, word, param, said, *_ in found:
        piece = None
        if kind == "text":
            piece = said[1:] if fallback else said
            if not fallback or piece:
                high = None
            fallback = False
        elif kind == "word" and word == "u" and param is not None:
            code = param & 0xFFFF
            if 0xDC00 <= code < 0xE000:
                piece = chr(0x10000 + ((high - 0xD800) << 10) + code - 0xDC00) if high is not None else None
            elif not 0xD800 <= code < 0xDC00:
                piece = chr(code)
            high = code if 0xD800 <= code < 0xDC00 else None
            fallback = True
        else:
            fallback, high = False, None
            if kind == "word" and word in ("par", "line"):
                piece = "\n"
            elif kind == "symbol":
                piece = SYMBOLS.get(said)
        out.append(piece)
    return out


def fields(text: str) -> list[tuple]:
    """(field, outer, depth, instruction, result) of each field that is shown: the position of its opening, that of the field around it, how many fields it lies in, itself included, and what its parts say.

    A field's instruction is what stands in its own instruction part; control words count as text there. Its result is what stands
    in result parts of its own or of fields within it; an inner field's goes to the outer one where it ends, as one piece. Pieces
    are those of pieces(); a brace ends what an escape began, so what is of no part is passed over.
    """
    found = TOKEN.findall(text)
    out: list[tuple] = []  # each with the field around it
    stack: list[tuple] = []
    # of the innermost open group: the innermost field, the part that its text is of, whether it is shown, whether the field is its own
    state = field, part, seen, own = None, None, True, False
    fallback, high = False, None

    def end(field: tuple):
        _, outer, _, _, result = field
        result[:] = ["".join(result)]
        if outer:
            outer[4].extend(result)

    for i, t in enumerate(found):
        if t == "{":
            stack.append(state)
            own, fallback, high = False, False, None
            if seen:
                name, starred = destination(found, i)
                if name in ("fldinst", "fldrslt"):  # here instructions are read
                    part = name if field else part
                elif name is not None and name not in REDIRECTED:
                    if name in HIDDEN or starred and name not in KNOWN:
                        part, seen = None, False
                    elif name == "field":
                        # text between its parts is of none of the parts around it
                        field, part, own = (i, field, field[2] + 1 if field else 1, [], []), None, True
                        out.append(field)
            state = field, part, seen, own
        elif t == "}":
            if own:
                end(field)
            if stack:
                state = field, part, seen, own = stack.pop()
            fallback, high = False, None
        elif part is not None:
            code = None
            if t[0] != "\\":
                piece = t[1:] if fallback else t
                high = None if piece else high
                fallback = False
            elif code := worded(t):
                word, param = code
                piece = "\n" if word in ("par", "line") else None
                fallback = word == "u" and param is not None
                if fallback:
                    unit = param & 0xFFFF
                    if 0xDC00 <= unit < 0xE000:
                        piece = chr(0x10000 + ((high - 0xD800) << 10) + unit - 0xDC00) if high is not None else None
                    elif not 0xD800 <= unit < 0xDC00:
                        piece = chr(unit)
                    high = unit if 0xD800 <= unit < 0xDC00 else None
                else:
                    high = None
            elif t[1] == "'" and len(t) == 4:
                piece = "" if fallback else windows_1252(int(t[2:], 16))
                high = None if piece else high
                fallback = False
            else:
                piece = SYMBOLS.get(t[1])
                fallback, high = False, None
            if part == "fldrslt":
                if piece:
                    field[4].append(piece)
            elif code is None:
                if piece:
                    field[3].append(piece)
            elif code[0] not in ("field", "fldinst", "fldrslt"):
                gap = " " if field[3] and not field[3][-1].endswith(" ") else ""
                field[3].append(f"{gap}\\{code[0]}{'' if code[1] is None else code[1]} ")
    while stack:
        if own:
            end(field)
        field, part, seen, own = stack.pop()
    return [(pos, outer and outer[0], depth, "".join(said).strip(" "), result[0]) for pos, outer, depth, said, result in out]


@lru_cache(1024)
def worded(t: str) -> tuple[str, int | None] | None:
    """The word and number of a control word, as grouped() has them; None if a token is none."""
    m = WORD.fullmatch(t)
    if m is None:
        return None
    param = int(m[2]) if m[2] else None
    return m[1], param if param is not None and -(2**31) <= param < 2**31 else None


def destination(found: list[str], i: int) -> tuple[str | None, bool]:
    """The word that makes the group that opens at token i a destination, if its first word after an optional star does, and whether that star is there."""
    starred = i + 1 < len(found) and found[i + 1] == "\\*"
    at = i + 1 + starred
    code = worded(found[at]) if at < len(found) and found[at][0] == "\\" else None
    return (code and code[0]), starred
