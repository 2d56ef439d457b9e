"""Colors and shading as plain functions of numbers; scrivel.functions.columns has them as Spark columns."""

from __future__ import annotations

import re

import numpy as np

#: Base colors of the theme, by index.
THEME = ("FFFFFF", "000000", "E7E6E6", "44546A", "4472C4", "ED7D31", "A5A5A5", "FFC000", "5B9BD5", "70AD47", "0563C1", "954F72")
#: Shading patterns with a share of the pattern color, in hundredths of a percent.
PERCENTS = (500, 1000, 2000, 2500, 3000, 4000, 5000, 6000, 7000, 7500, 8000, 9000)


def rounded(x) -> int:
    """Half away from zero."""
    return int(np.floor(np.float32(x) + np.float32(0.5)))


def tint(c: int, t: int) -> int:
    return rounded(np.float32(c) + np.float32(255 - c) * (np.float32(t) / np.float32(255)))


def shade(c: int, s: int) -> int:
    return rounded(np.float32(c) * (np.float32(1) - np.float32(s) / np.float32(255)))


def theme_color(index: int, tinted: int | None, shaded: int | None) -> tuple[int, int, int]:
    """Shade first, then tint."""
    rgb = bytes.fromhex(THEME[index])
    if shaded is not None:
        rgb = [shade(c, shaded) for c in rgb]
    if tinted is not None:
        rgb = [tint(c, tinted) for c in rgb]
    return tuple(rgb)


def pattern(percent: int) -> str:
    """The nearest pattern; of two as near, the lighter one."""
    percent = min(max(percent, 0), 10_000)
    if percent in (0, 10_000):
        return "clear" if percent == 0 else "solid"
    return f"percent{min(PERCENTS, key=lambda p: (abs(p - percent), p)) // 100}"


def blend(background: int, foreground: int, percent: int) -> int:
    return (background * (100 - percent) + foreground * percent + 50) // 100


def hex_digits(said) -> str | None:
    """The six digits of #rrggbb; None for anything else."""
    text = str(said)
    return text[1:] if re.fullmatch("#[0-9A-Fa-f]{6}", text) else None
