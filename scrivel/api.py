"""One document at a time, without Spark: read, look at, write."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from scrivel.limits import Limits
from scrivel.parser.lexer import InvalidDocument
from scrivel.parser.reader import Reader


class ScrivelError(Exception):
    pass


class ParseError(ScrivelError):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class ReportError(ScrivelError):
    pass


class WriterError(ScrivelError):
    pass


class HtmlWriterError(WriterError):
    pass


class DocxWriterError(WriterError):
    pass


class TypstWriterError(WriterError):
    pass


class PdfRenderError(WriterError):
    pass


@dataclass
class Document:
    """What was read: the model, warnings and counts."""

    model: dict
    warnings: list[dict] = field(default_factory=list)
    stats: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return self.model

    def to_json(self, indent: int | None = 2) -> str:
        return json.dumps(self.model, indent=indent, ensure_ascii=False)

    def warnings_of(self, severity: str) -> list[dict]:
        return [w for w in self.warnings if w["severity"] == severity]

    @property
    def has_errors(self) -> bool:
        return any(w["severity"] == "error" for w in self.warnings)

    @property
    def dropped(self) -> list[str]:
        return [w["reason"] for w in self.warnings if w["type"] == "dropped_content"]


class Parser:
    """Reads any number of documents under the same limits."""

    def __init__(self, limits: Limits | None = None):
        self.limits = limits or Limits()

    def parse(self, rtf: str) -> Document:
        try:
            found = Reader(self.limits).read(rtf)
        except InvalidDocument as e:
            raise ParseError(e.kind, str(e)) from e
        return Document(found["document"], found["warnings"], found["stats"])


def parse(rtf: str, limits: Limits | None = None) -> Document:
    return Parser(limits).parse(rtf)


def report_json(d: Document) -> str:
    try:
        return json.dumps({"warnings": d.warnings, "stats": d.stats}, indent=2, ensure_ascii=False)
    except (TypeError, ValueError) as e:
        raise ReportError(str(e)) from e


def with_mapping_warnings(d: Document, warnings: list[tuple[str, str]]) -> Document:
    """The document with a writer's warnings after the reader's."""
    from scrivel.render.typst import kind_of

    more = [{"type": kind_of(code), "reason": code, "detail": reason, "severity": "warning"} for code, reason in warnings]
    return Document(d.model, d.warnings + more, d.stats)


def report_text(d: Document) -> str:
    lines = [f"{k}: {v}" for k, v in d.stats.items()] + [f"warnings: {len(d.warnings)}"]
    return "\n".join(lines + [f"- [{w['severity']}] {w['type']}" + "".join(f" {k}={v}" for k, v in w.items() if k not in ("type", "severity")) for w in d.warnings])


def to_html(d: Document, **options) -> str:
    return to_html_with_warnings(d, **options)[0]


def to_html_with_warnings(d: Document, **options) -> tuple[str, list[str]]:
    from scrivel.render.html import html

    try:
        return html(d.model, **options)
    except ValueError as e:
        raise HtmlWriterError(str(e)) from e


def to_docx_bytes(d: Document, profile: str | None = None) -> bytes:
    return to_docx_with_warnings(d, profile)[0]


def to_docx_with_warnings(d: Document, profile: str | None = None) -> tuple[bytes, list[str]]:
    from scrivel.render.docx import docx

    try:
        return docx(d.model, profile)
    except ValueError as e:
        raise DocxWriterError(str(e)) from e


def to_docx_file(d: Document, path: str, profile: str | None = None) -> None:
    Path(path).write_bytes(to_docx_bytes(d, profile))


def to_typst(d: Document, profile: str = "report", **options) -> str:
    return to_typst_with_warnings(d, profile, **options)[0]


def to_typst_with_warnings(d: Document, profile: str = "report", **options) -> tuple[str, list[tuple[str, str]]]:
    """options: size (a name, or width and height in millimeters) and numbering (auto, always, never)."""
    from scrivel.render.typst import typst_with_warnings

    try:
        return typst_with_warnings(d.model, profile, **options)
    except ValueError as e:
        raise TypstWriterError(str(e)) from e


def to_pdf(d: Document, size: str | tuple[float, float] = "a4", **options) -> bytes:
    return to_pdf_with_warnings(d, size, **options)[0]


def to_pdf_with_warnings(d: Document, size: str | tuple[float, float] = "a4", **options) -> tuple[bytes, list[tuple[str, str]]]:
    """options: profile, numbering, title and stamp, the only date in the file."""
    from scrivel.render.pdf import pdf_with_warnings

    try:
        return pdf_with_warnings(d.model, size, **options)
    except ValueError as e:
        raise PdfRenderError(str(e)) from e
