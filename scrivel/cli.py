"""python -m scrivel.cli convert in.rtf [--to html|docx|pdf|typst] [-o OUT] [--strict] ... Exit codes: 0, 2 for wrong arguments or documents, 3 for files, 4 for dropped content in strict mode."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from scrivel import api
from scrivel.render import styles
from scrivel.render.typst import kind_of

ENDINGS = {".html": "html", ".htm": "html", ".docx": "docx", ".pdf": "pdf", ".typ": "typst"}
CSS_BYTES = 1 << 20


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scrivel")
    convert = p.add_subparsers(required=True).add_parser("convert")
    convert.add_argument("input")
    convert.add_argument("-o", "--output")
    convert.add_argument("--to", choices=sorted(set(ENDINGS.values())))
    convert.add_argument("--format", choices=("text", "json"), default="text", help="of the report, which is printed if there is no output")
    convert.add_argument("--emit-ir")
    convert.add_argument("--strict", action="store_true")
    convert.add_argument("--force", action="store_true")
    convert.add_argument("--profile", default="report")
    convert.add_argument("--html-css-file")
    convert.add_argument("--page-size", default="a4", help="a4, letter, legal, or width x height in millimeters")
    convert.add_argument("--page-numbers", choices=("auto", "always", "never"), default="auto")
    convert.add_argument("--fixed-date", help="of a PDF, whose bytes depend on nothing else")
    convert.add_argument("--docx-profile", action="store_true", help="styles, borders and margins of the profile in a DOCX, too")
    convert.add_argument("--verbose", action="store_true")
    return p


def fail(code: int, message: str) -> int:
    print(message, file=sys.stderr)
    return code


def unusable(path: Path, force: bool) -> str | None:
    """Why nothing can be written there."""
    if not path.parent.is_dir():
        return f"{path.parent} is no folder"
    if path.is_dir():
        return f"{path} is a folder"
    if not os.access(path.parent, os.W_OK):
        return f"{path.parent} can't be written to"
    return f"{path} exists; --force replaces it" if path.exists() and not force else None


def page(said: str) -> str | tuple[float, float]:
    """A name, or width x height in millimeters."""
    wide, by, high = said.lower().partition("x")
    try:
        return (float(wide), float(high)) if by else said
    except ValueError:
        return said


def main(given: list[str] | None = None) -> int:
    try:
        a = arguments().parse_args(given)
    except SystemExit as e:
        return int(e.code or 0)
    ending = ENDINGS.get(Path(a.output).suffix.lower()) if a.output else None
    if a.to and ending and a.to != ending:
        return fail(2, f"--to {a.to} doesn't fit {a.output}")
    try:
        styles.profile(a.profile)
    except ValueError as e:
        return fail(2, str(e))
    try:
        text = Path(a.input).read_bytes().decode()
    except (OSError, UnicodeDecodeError) as e:
        return fail(3, f"{a.input}: {e}")
    try:
        d = api.parse(text)
    except api.ParseError as e:
        return fail(2, f"{e.kind}: {e}")
    try:
        if a.emit_ir:
            Path(a.emit_ir).write_text(d.to_json() + "\n")
        if a.strict and d.dropped:
            return fail(4, "content was dropped: " + "; ".join(d.dropped))
        if not a.output:
            print(api.report_json(d) if a.format == "json" else api.report_text(d))
            return 0
        if wrong := unusable(Path(a.output), a.force):
            return fail(3, wrong)
        css = None
        if a.html_css_file:
            raw = Path(a.html_css_file).read_bytes()
            if len(raw) > CSS_BYTES:
                return fail(3, f"{a.html_css_file}: more than {CSS_BYTES} bytes")
            css = raw.decode()
        kind, reasons = a.to or ending or "docx", []
        if a.verbose and not ending:
            print(f"{a.output} has another ending than {kind}", file=sys.stderr)
        if kind == "html":
            out, reasons = api.to_html_with_warnings(d, profile=a.profile, custom_css=css)
        elif kind == "typst":
            out, found = api.to_typst_with_warnings(d, a.profile, size=page(a.page_size), numbering=a.page_numbers)
            reasons = [code for code, _ in found if kind_of(code) == "dropped_content"]
        elif kind == "pdf":
            out, found = api.to_pdf_with_warnings(d, page(a.page_size), profile=a.profile, numbering=a.page_numbers, title=Path(a.input).stem, stamp=a.fixed_date)
            reasons = [code for code, _ in found if kind_of(code) == "dropped_content"]
        else:
            out, reasons = api.to_docx_with_warnings(d, a.profile if a.docx_profile else None)
        if a.strict and reasons:
            return fail(4, "content was dropped: " + "; ".join(reasons))
        Path(a.output).write_bytes(out.encode() if isinstance(out, str) else out)
    except api.WriterError as e:
        return fail(2, str(e))
    except (OSError, UnicodeDecodeError) as e:
        return fail(3, str(e))
    return 0


if __name__ == "__main__":
    sys.exit(main())
