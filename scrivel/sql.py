"""The engine from SQL: functions of colors, escapes and units, and table functions for lateral joins.

    register(spark)
    SELECT d.doc_id, p.text FROM docs d, LATERAL rtf_paragraphs(d.rtf) p WHERE rtf_supported_url(d.url)

Scalar functions are SQL expressions, which the optimizer sees through; table functions read a document where its row stands.
A null document has no rows, a null argument gives null.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from scrivel.functions.colors import PERCENTS, THEME

FLOAT = "CAST({} AS FLOAT)".format
BYTE = FLOAT(255)
ROUNDED = "CAST(floor({} + CAST(0.5 AS FLOAT)) AS INT)".format


def replacing(pairs: list[tuple[str, str]]) -> str:
    """One replace() after another, in order. Every text is given by its code points, so no setting for escapes in literals matters."""
    said = lambda t: "''" if not t else f"concat({', '.join(f'char({ord(c)})' for c in t)})"
    out = "x"
    for raw, safe in pairs:
        out = f"replace({out}, {said(raw)}, {said(safe)})"
    return out


def scalars() -> dict[str, tuple[str, str, str]]:
    """name: (parameters, type of the result, expression)."""
    near = f"array_min(transform(array({', '.join(map(str, PERCENTS))}), p -> struct(abs(least(greatest(x, 0), 10000) - p) AS d, p))).p"
    part = "CAST(conv(substring(ltrim('#', x), {}, 2), 16, 10) AS INT)".format
    return {
        "rtf_tint": ("c INT, t INT", "INT", ROUNDED(f"({FLOAT('c')} + ({BYTE} - {FLOAT('c')}) * CAST({FLOAT('t')} / {BYTE} AS FLOAT))")),
        "rtf_shade": ("c INT, s INT", "INT", ROUNDED(f"CAST({FLOAT('c')} * ({FLOAT(1)} - CAST({FLOAT('s')} / {BYTE} AS FLOAT)) AS FLOAT)")),
        "rtf_color": ("x STRING", "STRUCT<r: INT, g: INT, b: INT>", f"CASE WHEN x RLIKE '^#?[0-9A-Fa-f]{{6}}$' THEN named_struct('r', {part(1)}, 'g', {part(3)}, 'b', {part(5)}) END"),
        "rtf_theme": ("i INT", "STRING", f"get(array({', '.join(f"'{c}'" for c in THEME)}), i)"),
        "rtf_pattern": ("x INT", "STRING", f"CASE WHEN x <= 0 THEN 'clear' WHEN x >= 10000 THEN 'solid' ELSE concat('percent', CAST({near} DIV 100 AS STRING)) END"),
        "rtf_blend": ("b INT, f INT, p INT", "INT", "CAST(floor((b * (100 - p) + f * p + 50) / 100) AS INT)"),
        "rtf_points": ("twips INT", "DOUBLE", "twips / 20"),
        "rtf_pixels": ("twips INT", "INT", "CAST(floor(twips / 15) AS INT)"),
        "rtf_emu": ("twips INT", "BIGINT", "CAST(twips AS BIGINT) * 635"),
        "rtf_escape_html": ("x STRING", "STRING", replacing([("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])),
        "rtf_escape_css": ("x STRING", "STRING", replacing([("\\", "\\\\"), ('"', '\\"'), ("'", "\\'"), ("\n", "\\A "), ("\r", "\\D "), ("\0", "")])),
        "rtf_escape_typst_string": ("x STRING", "STRING", replacing([("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")])),
        "rtf_supported_url": ("x STRING", "BOOLEAN", "lower(ltrim(x)) LIKE 'http://%' OR lower(ltrim(x)) LIKE 'https://%' OR lower(ltrim(x)) LIKE 'mailto:%'"),
    }


@udtf(returnType="ord: bigint, text: string")
class Paragraphs:
    """The body's paragraphs, the empty ones too."""

    def eval(self, rtf: str):
        from scrivel.parser.shown import shown_text

        if rtf is not None:
            yield from enumerate(shown_text(rtf).split("\n"))


@udtf(returnType="pos: bigint, kind: string, word: string, param: int, text: string, depth: bigint, level: bigint, grp: bigint, hidden: boolean")
class Tokens:
    """The tokens with their depth and their group."""

    def eval(self, rtf: str):
        from scrivel.parser.shown import grouped

        if rtf is not None:
            yield from grouped(rtf)


@udtf(returnType="channel: string, ord: int, type: string, text: string, bold: boolean, italic: boolean, target: string")
class Inlines:
    """Runs, links, fields and marks of a document that can be read; of others there are none."""

    def eval(self, rtf: str):
        from scrivel.limits import Limits
        from scrivel.operators.parse import read_one

        if rtf is not None:
            for x in read_one(rtf, Limits(), frozenset(("inlines",)))["inlines"]:
                yield x["channel"], x["ord"], x["inline_type"], x.get("text"), x.get("bold"), x.get("italic"), x.get("target")


@udtf(returnType="error_type: string, error: string")
class Errors:
    """Why a document can't be read, if it can't."""

    def eval(self, rtf: str):
        from scrivel.limits import Limits
        from scrivel.operators.parse import read_one

        if rtf is not None and (found := read_one(rtf, Limits(), frozenset(("error",)))).get("error_type"):
            yield found["error_type"], found["error"]


TABLES = {"rtf_paragraphs": Paragraphs, "rtf_tokens": Tokens, "rtf_inlines": Inlines, "rtf_errors": Errors}


def register(spark: SparkSession) -> None:
    """Makes all functions known to the session, for as long as it lasts."""
    for name, (parameters, kind, body) in scalars().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, one in TABLES.items():
        spark.udtf.register(name, one)
