"""Geometry that every writer of tables needs: rowspans and the borders that a cell draws."""

from __future__ import annotations


def rowspans(table: dict) -> list[list[int]]:
    """Rows that each cell takes: 0 for a cell below a vertical start, 1 for a cell of its own. Cells meet by their index."""
    rows = [[c.get("merge") for c in r["cells"]] for r in table["rows"]]
    out = [[0 if m == "vertical_continue" else 1 for m in r] for r in rows]
    for i, r in enumerate(rows):
        for j, m in enumerate(r):
            to = i + 1
            while m == "vertical_start" and to < len(rows) and j < len(rows[to]) and rows[to][j] == "vertical_continue":
                to += 1
            if m == "vertical_start":
                out[i][j] = to - i
    return out


def borders(table: dict, i: int, j: int) -> dict[str, dict]:
    """The sides that cell (i, j) draws. An edge between two cells is drawn once: by the cell whose own border it is, else, from the row's inner border, by the upper or left one."""
    rows = table["rows"]

    def has(a, b):
        return 0 <= a < len(rows) and 0 <= b < len(rows[a]["cells"])

    own = lambda a, b, side: rows[a]["cells"][b].get("borders", {}).get(side)
    of_row = lambda a, side: rows[a].get("row_props", {}).get("borders", {}).get(side)
    out = {}
    for side, other, (a, b), inner in (("top", "bottom", (i - 1, j), "inside_h"), ("left", "right", (i, j - 1), "inside_v"), ("bottom", "top", (i + 1, j), "inside_h"), ("right", "left", (i, j + 1), "inside_v")):
        mine = own(i, j, side)
        if not has(a, b):
            drawn = mine or of_row(i, side)
        else:
            first = side in ("bottom", "right")  # the upper or left one of the two wins a tie
            theirs = own(a, b, other)
            row_mine, row_theirs = of_row(i, inner), of_row(a, inner)
            if mine or theirs:
                drawn = mine if mine and (first or not theirs) else None
            else:
                drawn = row_mine if row_mine and (first or not row_theirs) else None
        if drawn:
            out[side] = drawn
    return out


def fill(shading: dict | None) -> dict | None:
    """The color that stands for a shading: its fill, mixed with the pattern's color by the pattern's share."""
    from scrivel.functions.colors import PERCENTS, blend

    if not shading:
        return None
    back, kind = shading["fill_color"], shading.get("pattern", "solid")
    share = next((p // 100 for p in PERCENTS if kind == f"percent{p // 100}"), None)
    if share is None:
        return back
    front = shading.get("pattern_color") or {"r": 0, "g": 0, "b": 0}
    return {c: blend(back[c], front[c], share) for c in "rgb"}


def hex_color(c: dict) -> str:
    return f"#{c['r']:02x}{c['g']:02x}{c['b']:02x}"
