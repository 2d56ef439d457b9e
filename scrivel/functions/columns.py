"""Scalar functions as Spark columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivel.functions.colors import PERCENTS, THEME
from scrivel.parser.lexer import CP1252


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def windows_1252(hex_byte: Column) -> Column:
    """The character of a byte given in two hexadecimal digits."""
    ours = "".join(map(chr, CP1252))
    return F.translate(F.char(F.conv(hex_byte, 16, 10).cast("int")), ours, "".join(CP1252.values()))


def unicode_char(parameter: Column) -> Column:
    """The character that \\uN stands for: N is a signed 16-bit number. A lone surrogate is no character."""
    code = F.pmod(parameter, F.lit(65536))
    wide = F.lpad(F.hex(code.cast("long")), 4, "0")
    return F.when(code.between(0xD800, 0xDFFF), F.lit("")).otherwise(F.decode(F.unhex(wide), "UTF-16BE"))


def escape_html(c) -> Column:
    out = F.replace(col(c), F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def escape_css_string(c) -> Column:
    out = F.replace(col(c), F.lit("\\"), F.lit("\\\\"))
    for raw, safe in (('"', '\\"'), ("'", "\\'"), ("\n", "\\A "), ("\r", "\\D "), ("\0", "")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def escape_typst(c) -> Column:
    return F.regexp_replace(col(c), r"([\[\]*_@#\\$~])", r"\\$1")


def escape_typst_string(c) -> Column:
    out = F.replace(col(c), F.lit("\\"), F.lit("\\\\"))
    for raw, safe in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def typst_label(c) -> Column:
    return F.regexp_replace(col(c), r"[^\p{L}\p{N}_-]", "-")


def font_name(c) -> Column:
    return F.regexp_replace(col(c), r"[^\p{L}\p{N} _-]", "")


def supported_url(c) -> Column:
    return col(c).rlike(r"(?i)^\s*(https?://|mailto:)")


def from_hex(c) -> Column:
    """struct(r, g, b) of an optional # and six hexadecimal digits, else null."""
    digits = F.regexp_extract(col(c), "^#?([0-9A-Fa-f]{6})$", 1)
    part = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("int")
    return F.when(digits != "", F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def rounded(c: Column) -> Column:
    """Half away from zero, of a float that isn't negative."""
    return F.floor(c + F.lit(0.5).cast("float")).cast("int")


def tint(c, t) -> Column:
    c, t = col(c).cast("float"), col(t).cast("float")
    return rounded(c + (F.lit(255).cast("float") - c) * (t / F.lit(255).cast("float")).cast("float"))


def shade(c, s) -> Column:
    c, s = col(c).cast("float"), col(s).cast("float")
    return rounded((c * (F.lit(1).cast("float") - (s / F.lit(255).cast("float")).cast("float"))).cast("float"))


def theme_base(index: Column) -> Column:
    """struct(r, g, b) of a theme index, null for one that there isn't."""
    return from_hex(F.get(F.array(*map(F.lit, THEME)), index))


def resolved_color(rgb, theme, tinted, shaded) -> Column:
    """struct(r, g, b) of an entry: its own color, else that of its theme index, first shaded and then tinted where it says so, else null."""
    base = theme_base(col(theme))
    dark = lambda c: F.when(col(shaded).isNotNull(), shade(c, shaded)).otherwise(c)
    light = lambda c: F.when(col(tinted).isNotNull(), tint(c, tinted)).otherwise(c)
    return F.coalesce(col(rgb), F.when(base.isNotNull(), F.struct(*(light(dark(base[c])).alias(c) for c in "rgb"))))


def nearest_pattern(percent) -> Column:
    """The shading pattern of a share in hundredths of a percent; of two as near, the lighter one."""
    p = F.least(F.greatest(col(percent), F.lit(0)), F.lit(10_000))
    near = F.array_min(F.array(*(F.struct(F.abs(p - x).alias("d"), F.lit(x).alias("x")) for x in PERCENTS)))["x"]
    return F.when(p == 0, "clear").when(p == 10_000, "solid").otherwise(F.concat(F.lit("percent"), (near / 100).cast("int").cast("string")))


def blend(background, foreground, percent) -> Column:
    b, f, p = col(background).cast("long"), col(foreground).cast("long"), col(percent).cast("long")
    return F.floor((b * (100 - p) + f * p + 50) / 100).cast("int")


def twips_to_points(c) -> Column:
    return col(c) / 20


def twips_to_pixels(c) -> Column:
    return F.floor(col(c) / 15).cast("int")


def twips_to_emu(c) -> Column:
    return col(c).cast("long") * 635


def pict_bytes(hex_text) -> Column:
    """Bytes of a picture's hexadecimal text without its white space; null if it isn't hexadecimal or of odd length."""
    digits = F.regexp_replace(col(hex_text), "[ \t\n\r\f]", "")
    return F.when(digits.rlike("^([0-9A-Fa-f]{2})+$"), F.unhex(digits))
