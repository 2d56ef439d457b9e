"""Tokens and what follows from them alone, as DataFrame operators: depth, groups, hidden destinations, visible text, style in force.

Tokens themselves are one regular expression in the JVM. What needs the order of tokens is a fold over one document where it
stands: no token is shuffled or sorted, and rows that repeat an id are documents of their own.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scrivel.functions.columns import windows_1252
from scrivel.limits import Limits
from scrivel.operators.keys import KEY, Keys, given
from scrivel.parser import shown
from scrivel.parser.lexer import PATTERN, InvalidDocument, tokens, validate

JAVA = f"(?s)({PATTERN})"
#: Rows of an Arrow batch that a fold gives out at once.
ROWS = 20_000


def tokenize(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, word, param, text) of (doc_id, rtf): one regular expression, no shuffle."""
    rows = docs.select("doc_id", F.posexplode(F.regexp_extract_all("rtf", F.lit(JAVA), F.lit(1))).alias("pos", "t"))
    two = F.substring("t", 1, 2)
    first = F.substring("t", 1, 1)
    word = F.regexp_extract("t", "^\\\\([A-Za-z]+)", 1)
    byte = F.col("t").rlike("^\\\\'[0-9a-fA-F]{2}$")
    kind = F.when(first == "{", "open").when(first == "}", "close").when(first != "\\", "text").when(word != "", "word").when(byte, "text").otherwise("symbol")
    param = F.regexp_extract("t", "^\\\\[A-Za-z]+(-?[0-9]+)", 1).try_cast("int")
    text = F.when(byte, windows_1252(F.substring("t", 3, 2))).when(kind == "text", F.col("t")).when(kind == "symbol", F.substring(two, 2, 1))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), kind.alias("kind"), F.nullif(word, F.lit("")).alias("word"), param.alias("param"), text.alias("text"))


def folded(docs: DataFrame, schema: str, rows_of, keyed: bool = False) -> DataFrame:
    """A row (doc_id, ...) for each row that rows_of(rtf) gives of each document (doc_id, rtf). A null text has none. keyed: with row_key after the id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = StructType.fromDDL(f"doc_id {kind}, {f'{KEY} binary, ' if keyed else ''}{schema}")
    arrow = to_arrow_schema(fields)

    def each(batches):
        ids, rows, key = [], [], Keys()

        def flush():
            columns = [*zip(*ids, strict=True), *zip(*rows, strict=True)]
            out = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            ids.clear(), rows.clear()
            return out

        for batch in batches:
            for i, text, has in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if text is None:
                    continue
                own = (i, key(has, i, text)) if keyed else (i,)
                for row in rows_of(text):
                    ids.append(own)
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield flush()
        if rows:
            yield flush()

    return docs.select("doc_id", "rtf", given(docs)).mapInArrow(each, fields)


def groups(docs: DataFrame, pieces: bool = False) -> DataFrame:
    """The tokens of (doc_id, rtf) with row_key, depth (after the token), level (of the group the token belongs to, its braces included), group (the position of that group's opening) and hidden (whether that group, or one around it, is a hidden destination).

    Only a group's first word, after an optional \\*, makes it a destination. pieces: with piece, the characters that a token shows.
    """

    def told(text: str) -> list[tuple]:
        found = shown.grouped(text)
        return [(*t, piece) for t, piece in zip(found, shown.pieces(found), strict=True)]

    schema = "pos long, kind string, word string, param int, text string, depth long, level long, group long, hidden boolean"
    return folded(docs, schema + ", piece string" if pieces else schema, told if pieces else shown.grouped, keyed=True)


def errors(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(doc_id, error_type): the first check that a document fails, in the order of a reader's checks. Documents without a row are sound in their groups."""
    limits = limits or Limits()

    def failed(text: str):
        try:
            if len(text.encode()) > limits.max_input_bytes:
                raise InvalidDocument("input_too_large", "")
            found = tokens(text)
            validate(found)
            depth = 0
            for kind, _, _ in found:
                depth += (kind == "open") - (kind == "close")
                if depth > limits.max_group_depth:
                    raise InvalidDocument("group_depth_exceeded", "")
        except InvalidDocument as e:
            return [(e.kind,)]
        return []

    return folded(docs.withColumn("rtf", F.coalesce("rtf", F.lit(""))), "error_type string", failed)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, text) of the body's paragraphs, the empty ones too, from tokens alone."""
    return folded(docs, "ord long, text string", lambda rtf: enumerate(shown.shown_text(rtf).split("\n")))


def plain_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text): paragraphs joined by line ends."""
    return folded(docs, "text string", lambda rtf: [(shown.shown_text(rtf),)])


def cells(docs: DataFrame) -> DataFrame:
    """(doc_id, row, cells) of tables that aren't nested, from tokens alone: the texts of each row's cells; rows are counted through a document."""
    return folded(docs, "row long, cells array<string>", lambda rtf: enumerate(shown.rows_of_cells(rtf)))


def fields(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, field, outer, depth, instruction, result) of documents (doc_id, rtf): what structure.fields() says from a table of tokens, in one fold of each document, so that no token is written or shuffled."""
    return folded(docs, "field long, outer long, depth int, instruction string, result string", shown.fields, keyed=True)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word is shown in the bodies of all documents (doc_id, rtf), in lower case. Words are counted where a document stands, and each is sent once for a batch."""
    from scrivel.operators.analytics import split_words

    def each(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0):
                if text.is_valid:
                    counts.update(split_words(shown.shown_text(text.as_py()).lower()))
            yield pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    return docs.select("rtf").mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def style_in_force(docs: DataFrame, words: dict[str, str], reset: str = "plain") -> DataFrame:
    """(doc_id, pos, text, ...): pieces of the body's text with the value of each property in `words` (control word: property), null where nothing set it: the latest setter before them whose group is still open. `reset` sets every property to null."""
    names = sorted(set(words.values()))
    return folded(docs, "pos long, text string, " + ", ".join(f"{n} int" for n in names), lambda rtf: shown.styled(rtf, words, reset))
