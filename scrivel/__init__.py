"""scrivel: document analytics over corpora, expressed as Spark DataFrames."""

__version__ = "0.1.0"

from scrivel.api import Document, Parser, ParseError, ScrivelError, WriterError, parse  # noqa: E402
from scrivel.limits import Limits  # noqa: E402

__all__ = ["Document", "Limits", "ParseError", "Parser", "ScrivelError", "WriterError", "parse"]
