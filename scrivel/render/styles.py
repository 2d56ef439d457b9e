"""Style profiles: values by group, as CSS variables and rules, and as a Typst preamble."""

from __future__ import annotations

import re
from copy import deepcopy

from scrivel.functions.colors import hex_digits

#: Fixed values of the profiles. By line: group, name, then the values of classic, report and compact.
VALUES = """
color text-primary | #000000 | #1A1A1A | #000000
color text-muted | #666666 | #5A5A5A | #555555
color surface-page | #FFFFFF | #FFFFFF | #FFFFFF
color surface-table-header | #E8E8E8 | #E6E9ED | #F0F0F0
color surface-table-stripe | #F5F5F5 | #F4F6F8 | #FFFFFF
color border-default | #000000 | #D1D5DB | #CCCCCC
color link-default | #0000EE | #2563EB | #0066CC
color link-hover | #0000AA | #1D4ED8 | #004499
type font-body | Libertinus Serif | Libertinus Serif | Libertinus Serif
type font-heading | Libertinus Serif | Libertinus Serif | Libertinus Serif
type font-mono | DejaVu Sans Mono | DejaVu Sans Mono | DejaVu Sans Mono
type size-body | 12.0 | 11.0 | 9.0
type size-small | 10.0 | 9.5 | 8.0
type size-h1 | 20.0 | 26.0 | 14.0
type size-h2 | 16.0 | 20.0 | 12.0
type size-h3 | 14.0 | 15.0 | 10.0
type line-height-body | 1.4 | 1.6 | 1.3
type line-height-heading | 1.2 | 1.3 | 1.2
type weight-regular | 400 | 400 | 400
type weight-semibold | 600 | 600 | 600
type weight-bold | 700 | 700 | 700
space space-xs | 2.0 | 3.0 | 1.0
space space-sm | 4.0 | 6.0 | 2.0
space space-md | 8.0 | 10.0 | 4.0
space space-lg | 12.0 | 18.0 | 8.0
space space-xl | 18.0 | 28.0 | 12.0
space paragraph-gap | 8.0 | 12.0 | 4.0
space list-item-gap | 4.0 | 6.0 | 2.0
space table-cell-padding-x | 4.0 | 8.0 | 3.0
space table-cell-padding-y | 2.0 | 5.0 | 2.0
layout content-max-width | 170.0 | 165.0 | 180.0
layout page-margin-top | 25.4 | 25.0 | 15.0
layout page-margin-bottom | 25.4 | 25.0 | 15.0
layout page-margin-left | 25.4 | 22.0 | 15.0
layout page-margin-right | 25.4 | 22.0 | 15.0
component table-border-width | 0.75 | 0.5 | 0.5
component table-stripe-mode | none | alternate-rows | none
component table-header-emphasis | true | true | false
component list-indentation-step | 18.0 | 20.0 | 12.0
component list-marker-gap | 6.0 | 8.0 | 4.0
component heading-spacing-above-h1 | 18.0 | 28.0 | 10.0
component heading-spacing-below-h1 | 10.0 | 14.0 | 6.0
component heading-spacing-above-h2 | 14.0 | 22.0 | 8.0
component heading-spacing-below-h2 | 8.0 | 12.0 | 4.0
component heading-spacing-above-h3 | 12.0 | 16.0 | 6.0
component heading-spacing-below-h3 | 6.0 | 10.0 | 3.0
"""
NAMES = ("classic", "report", "compact")


def value(raw: str):
    return {"true": True, "false": False}.get(raw, float(raw) if re.fullmatch(r"\d+\.\d+", raw) else int(raw) if raw.isdigit() else raw)


def profiles() -> dict[str, dict]:
    out: dict[str, dict] = {name: {"name": name} for name in NAMES}
    for line in VALUES.strip().split("\n"):
        key, *values = line.split(" | ")
        group, name = key.split(" ")
        for profile, v in zip(NAMES, values, strict=True):
            out[profile].setdefault(group, {})[name] = value(v)
    return out


PROFILES = profiles()
REPORT = PROFILES["report"]


def profile(name: str) -> dict:
    """By name, in either case."""
    found = PROFILES.get(name.strip().lower())
    if found is None:
        raise ValueError(f"no style profile {name!r}: {', '.join(PROFILES)}")
    return found


def changed(name: str, **groups: dict) -> dict:
    """A profile like the one of that name, with other values in some groups."""
    out = deepcopy(profile(name))
    for group, values in groups.items():
        out[group] |= {k.replace("_", "-"): v for k, v in values.items()}
    return out


def problems(p: dict) -> list[str]:
    """What is wrong with a profile; empty if nothing."""
    out = [f"color {k}: {v!r} isn't #rrggbb" for k, v in p["color"].items() if hex_digits(v) is None]
    for k, v in p["type"].items():
        if k.startswith("font") and not str(v).strip():
            out.append(f"{k} is empty")
        elif k.startswith("size") and v <= 0:
            out.append(f"{k} isn't above 0")
        elif k.startswith("line") and v < 1:
            out.append(f"{k} is below 1")
        elif k.startswith("weight") and not 100 <= v <= 900:
            out.append(f"{k} isn't within 100 and 900")
    return out + [f"{k} is negative" for g in ("space", "layout", "component") for k, v in p[g].items() if isinstance(v, float) and v < 0]


def css_name(font: str) -> str:
    clean = "".join(c for c in font if c.isprintable()).replace("\\", "\\\\").replace('"', '\\"')
    return f'"{clean}"' if re.search('[ ,"]', clean) else clean


def variables(p: dict) -> dict[str, str]:
    """Every value as CSS writes it, by the name of its variable."""
    out = {}
    for group, values in p.items():
        if group == "name":
            continue
        for k, v in values.items():
            plain = k.startswith(("line-height", "weight"))
            unit = "" if plain else "mm" if group == "layout" else "pt"
            said = css_name(v) if k.startswith("font") else str(v).lower() if isinstance(v, bool | str) and group != "color" else v if isinstance(v, str) else f"{v:g}{unit}"
            out[f"color-{k}" if group == "color" else k] = said
    part, weight = p["component"], p["type"]
    out["table-stripe-fill"] = "transparent" if part["table-stripe-mode"] == "none" else p["color"]["surface-table-stripe"]
    out["table-header-font-weight"] = str(weight["weight-semibold" if part["table-header-emphasis"] else "weight-regular"])
    return out


def css(p: dict, prefix: str = "doc") -> str:
    var = lambda k: f"var(--{prefix}-{k})"
    rules = [
        f".rtf-doc {{ color: {var('color-text-primary')}; background: {var('color-surface-page')}; font-family: {var('font-body')}; font-size: {var('size-body')}; line-height: {var('line-height-body')}; font-weight: {var('weight-regular')}; }}",
        f".rtf-content {{ max-width: {var('content-max-width')}; margin: {var('page-margin-top')} auto {var('page-margin-bottom')}; padding: 0 {var('page-margin-right')} 0 {var('page-margin-left')}; }}",
        f".rtf-p {{ margin: 0 0 {var('paragraph-gap')} 0; }}",
        *(f".rtf-doc h{i} {{ font-family: {var('font-heading')}; font-size: {var(f'size-h{i}')}; line-height: {var('line-height-heading')}; margin: {var(f'heading-spacing-above-h{i}')} 0 {var(f'heading-spacing-below-h{i}')}; }}" for i in (1, 2, 3)),
        ".rtf-align-center { text-align: center; }", ".rtf-align-right { text-align: right; }", ".rtf-align-justify { text-align: justify; }",
        ".rtf-u { text-decoration: underline; }", ".rtf-s { text-decoration: line-through; }", ".rtf-sc { font-variant: small-caps; }", ".rtf-ac { text-transform: uppercase; }",
        f".rtf-link {{ color: {var('color-link-default')}; }}", f".rtf-link:hover {{ color: {var('color-link-hover')}; }}",
        f".rtf-list {{ padding-left: {var('list-indentation-step')}; }}", f".rtf-list > li {{ margin-bottom: {var('list-item-gap')}; padding-left: {var('list-marker-gap')}; }}",
        f".rtf-table {{ border-collapse: collapse; margin-bottom: {var('space-md')}; }}",
        f".rtf-table td {{ padding: {var('table-cell-padding-y')} {var('table-cell-padding-x')}; border: {var('table-border-width')} solid {var('color-border-default')}; }}",
        f".rtf-table thead td {{ background: {var('color-surface-table-header')}; font-weight: {var('table-header-font-weight')}; }}", f".rtf-table tbody tr:nth-child(even) td {{ background: {var('table-stripe-fill')}; }}",
        f".rtf-notes {{ font-size: {var('size-small')}; color: {var('color-text-muted')}; }}", ".rtf-valign-top { vertical-align: top; }", ".rtf-valign-middle { vertical-align: middle; }", ".rtf-valign-bottom { vertical-align: bottom; }",
    ]
    return "\n".join([":root {", *(f"  --{prefix}-{k}: {v};" for k, v in variables(p).items()), "}", *rules])


def typst_font(raw: str) -> str:
    """The first font of a list, as Typst writes strings."""
    first = raw.split(",")[0].strip().strip('"')
    return '"' + "".join(c for c in first if c.isprintable()).replace("\\", "\\\\").replace('"', '\\"') + '"'


def typst(p: dict) -> str:
    """Text, paragraphs, headings, links, tables and lists; pages are the document's."""
    t, s, part = p["type"], p["space"], p["component"]
    paint = lambda k: f'rgb("{p["color"][k][1:]}")'
    stripe = "if calc.rem(y, 2) == 1 { " + paint("surface-table-stripe") + " } else { none }" if part["table-stripe-mode"] == "alternate-rows" else "none"
    fill = f"if y == 0 {{ {paint('surface-table-header')} }} else {{ {stripe} }}" if part["table-header-emphasis"] else stripe
    lists = f"indent: {part['list-indentation-step']:g}pt, body-indent: {part['list-marker-gap']:g}pt, spacing: {s['list-item-gap']:g}pt"
    return "\n".join([
        f"// style profile: {p['name']}",
        f"#set text(font: ({typst_font(t['font-body'])}), size: {t['size-body']:g}pt, fill: {paint('text-primary')}, lang: \"en\")",
        f"#set par(leading: {t['line-height-body']:g}em, spacing: {s['paragraph-gap']:g}pt)",
        *(f"#show heading.where(level: {i}): it => {{ set text(font: ({typst_font(t['font-heading'])}), size: {t[f'size-h{i}']:g}pt, weight: {t['weight-bold' if i == 1 else 'weight-semibold']}); set block(above: {part[f'heading-spacing-above-h{i}']:g}pt, below: {part[f'heading-spacing-below-h{i}']:g}pt); it }}" for i in (1, 2, 3)),
        f"#show link: set text(fill: {paint('link-default')})",
        f"#set table(stroke: {part['table-border-width']:g}pt + {paint('border-default')}, inset: (x: {s['table-cell-padding-x']:g}pt, y: {s['table-cell-padding-y']:g}pt)" + (f", fill: (x, y) => {fill})" if fill != "none" else ")"),
        *([f"#show table.cell.where(y: 0): set text(weight: {t['weight-semibold']})"] if part["table-header-emphasis"] else []),
        f"#set list({lists})", f"#set enum({lists})",
    ])
