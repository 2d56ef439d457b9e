"""Queries over the driver's tables: rows are written as rich text by an encoder, read back by the engine, and analysed.

Each has DuckDB SQL that computes the same from the original columns, without rich text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivel.functions import columns as C
from scrivel.limits import Limits
from scrivel.operators import analytics as A
from scrivel.operators import parse as P
from scrivel.operators import tokens as T
from scrivel.operators.render import all_warnings, convert_to_docx, convert_to_html, convert_to_pdf, convert_to_typst, docx_elements, docx_paragraphs, mapping_warnings, pdf_pages
from scrivel.sources.rtf import document, encode_rows, encode_text, escaped

#: Keys of one document, where a group's rows are more than a document may hold.
PART = 1000
STATS = ("paragraph_count", "run_count", "bytes_processed", "duration_ms")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_text(read(spark, sf_dir, "documents"), "doc_id", "text")


def joined(body: F.Column, order: F.Column) -> F.Column:
    """Pieces of a group's rows, in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), body.alias("b")))), lambda x: x["b"]), "")


def edged(words: F.Column, col: F.Column) -> F.Column:
    """A cell's words and its boundary."""
    return F.concat(words, F.lit("\\cellx"), ((col + 1) * 900).cast("string"))


def table_documents(cells: DataFrame) -> DataFrame:
    """A document with one table for each doc_id, of cells (doc_id, row, col, words, text) and, if there are any, words of their rows."""
    of_row = F.first("row_words") if "row_words" in cells.columns else F.lit("")
    body = F.concat(F.lit("\\pard\\intbl "), F.col("text"), F.lit("\\cell "))
    rows = cells.groupBy("doc_id", "row").agg(F.concat(F.lit("\\trowd"), of_row, joined(F.col("words"), F.col("col")), F.lit(" "), joined(body, F.col("col")), F.lit("\\row ")).alias("r"))
    return rows.groupBy("doc_id").agg(document(joined(F.col("r"), F.col("row"))).alias("rtf"))


def marked_lists(rows: DataFrame, doc: str, order: str, ls: F.Column, level: F.Column, head: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Marks, overrides and levels read from documents with an item for each row."""
    item = F.concat(F.lit("\\pard\\ls"), ls.cast("string"), F.lit("\\ilvl"), level.cast("string"), F.lit(" x\\par "))
    docs = rows.groupBy(F.col(doc).alias("doc_id")).agg(document(joined(item, F.col(order)), head).alias("rtf"))
    parsed = P.parse(docs, want=("marks", "overrides", "list_levels"))
    return P.table(parsed, "marks"), P.table(parsed, "overrides"), P.table(parsed, "list_levels")


# ---- tokens and text


@query(r"""
SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 100
""")
def word_freq_topk(spark, sf_dir):
    return T.word_counts(encoded_documents(spark, sf_dir)).orderBy(F.desc("n"), "word").limit(100)


@query("""
SELECT doc_id, 1 AS n_open, 1 AS n_close, length(text) - length(replace(text, chr(10), '')) AS n_par, length(regexp_replace(text, '[\\x00-\\x7f]', '', 'g')) AS n_unicode FROM documents
""")
def token_kind_counts(spark, sf_dir):
    t = T.tokenize(encoded_documents(spark, sf_dir))
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return t.groupBy("doc_id").agg(count(F.col("kind") == "open", "n_open"), count(F.col("kind") == "close", "n_close"), count(F.col("word") == "par", "n_par"), count(F.col("word") == "u", "n_unicode"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def roundtrip_plaintext(spark, sf_dir):
    return T.plain_text(encoded_documents(spark, sf_dir)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""
SELECT doc_id, count(*) AS n_paragraphs, max(length(p)) AS longest, sum(length(p)) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) WHERE p <> '' GROUP BY doc_id
""")
def paragraph_lengths(spark, sf_dir):
    p = T.paragraphs(encoded_documents(spark, sf_dir)).where("text <> ''")
    return p.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.max(F.length("text")).cast("long").alias("longest"), F.sum(F.length("text")).alias("chars"))


@query("""
SELECT p_partkey AS doc_id, CAST(1 + p_size % 9 AS BIGINT) AS max_depth, CAST(1 + p_size % 9 AS BIGINT) AS n_groups FROM part
""")
def group_depth_stats(spark, sf_dir):
    docs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), document(F.concat(F.expr("repeat('{\\\\b ', p_size % 9)"), F.lit("x"), F.expr("repeat('}', p_size % 9)"))).alias("rtf"))
    g = T.groups(docs)
    return g.groupBy("doc_id").agg(F.max("depth").alias("max_depth"), F.count_distinct("group").alias("n_groups"))


@query("""
SELECT error_type, count(*) AS n FROM (SELECT CASE p_size % 6 WHEN 1 THEN 'unbalanced_groups' WHEN 2 THEN 'unmatched_group_end' WHEN 3 THEN 'missing_rtf_header' WHEN 4 THEN 'tokenization' WHEN 5 THEN 'empty_input' END AS error_type FROM part) WHERE error_type IS NOT NULL GROUP BY error_type
""")
def validation_errors(spark, sf_dir):
    return T.errors(broken_documents(spark, sf_dir)).groupBy("error_type").agg(F.count("*").alias("n"))


@query(ORACLES["validation_errors"])
def reader_errors(spark, sf_dir):
    return P.failures(P.parse(broken_documents(spark, sf_dir), want=("error",))).groupBy("error_type").agg(F.count("*").alias("n"))


def broken_documents(spark, sf_dir):
    forms = F.array(*map(F.lit, ("{\\rtf1 ok}", "{\\rtf1 {open}", "{\\rtf1 x}}", "plain {text}", "{\\rtf1 a\x01b}", "")))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.get(forms, F.col("p_size") % 6).alias("rtf"))


@query("""
SELECT p_partkey AS doc_id, 'group_depth_exceeded' AS error_type FROM part WHERE 1 + p_size % 9 > 6
""")
def limit_errors(spark, sf_dir):
    docs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), document(F.concat(F.expr("repeat('{', p_size % 9)"), F.lit("x"), F.expr("repeat('}', p_size % 9)"))).alias("rtf"))
    return P.failures(P.parse(docs, Limits(max_group_depth=6), want=("error",))).select("doc_id", "error_type")


TEXT_STATS = r"""
WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL),
s AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS words, count(*) AS unique_words, first(word ORDER BY n DESC, word) AS most_common_word FROM c GROUP BY doc_id)
SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS lines, coalesce(words, 0) AS words, length(text) AS chars, CAST(strlen(text) AS BIGINT) AS bytes,
  coalesce(unique_words, 0) AS unique_words, most_common_word FROM documents LEFT JOIN s USING (doc_id)
"""


@query(TEXT_STATS)
def text_stats(spark, sf_dir):
    return A.text_stats(read(spark, sf_dir, "documents"))


@query("""
SELECT d.doc_id, count(p) FILTER (p <> '') AS paragraph_count, count(p) FILTER (p <> '') AS run_count, 0 AS duration_ms FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) d GROUP BY d.doc_id
""")
def document_stats(spark, sf_dir):
    return P.stats(P.parse(encoded_documents(spark, sf_dir), want=STATS)).drop("bytes_processed")


@query("""
SELECT doc_id, length(text) AS shown FROM documents
""")
def destination_skip(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    hidden = F.concat(F.lit("{\\info{\\title "), escaped("text"), F.lit("}}{\\*\\nosuchword "), escaped("text"), F.lit("}{\\header "), escaped("lang"), F.lit("}"))
    rtf = docs.select("doc_id", document(F.concat(hidden, escaped("text"))).alias("rtf"))
    return T.plain_text(rtf).select("doc_id", F.length("text").cast("long").alias("shown"))


# ---- style, fonts, colors


def styled_turns(spark, sf_dir):
    style = F.when(F.col("role") == "user", "\\b ").when(F.col("role") == "assistant", "\\i ").otherwise("\\ul ")
    turn = F.concat(F.lit("{"), style, F.lit(">"), escaped("text"), F.lit("}\\par "))
    return read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(document(joined(turn, F.col("turn"))).alias("rtf"))


@query("""
SELECT conv_id AS doc_id, role = 'user' AS bold, role = 'assistant' AS italic, CAST(sum(1 + length(replace(text, chr(10), ''))) AS BIGINT) AS chars FROM conversations GROUP BY ALL
""")
def styled_run_chars(spark, sf_dir):
    runs = P.table(P.parse(styled_turns(spark, sf_dir), want=("inlines",)), "inlines").where("inline_type = 'run'")
    return runs.groupBy("doc_id", "bold", "italic").agg(F.sum(F.length("text")).alias("chars"))


@query("""
SELECT conv_id AS doc_id, role = 'user' AS bold, role = 'assistant' AS italic, CAST(sum(1 + length(replace(text, chr(10), ''))) AS BIGINT) AS chars FROM conversations GROUP BY ALL
""")
def style_in_force(spark, sf_dir):
    """The same from tokens alone."""
    marked = T.style_in_force(styled_turns(spark, sf_dir), {"b": "bold", "i": "italic"})
    on = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return marked.groupBy("doc_id", on("bold").alias("bold"), on("italic").alias("italic")).agg(F.sum(F.length("text")).alias("chars"))


@query("""
SELECT CASE WHEN event_id % 7 < 5 THEN 'Font ' || (event_id % 7) ELSE 'Font 2' END AS family, count(*) AS n FROM events GROUP BY ALL
""")
def font_resolution(spark, sf_dir):
    run = F.concat(F.lit("{\\f"), (F.col("event_id") % 7).cast("string"), F.lit(" x}"))
    head = "{\\fonttbl{\\f1 Overwritten;}" + "".join(f"{{\\f{i} Font {i};}}" for i in range(5)) + "}\\deff2 "
    docs = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(document(joined(run, F.col("event_id")), head).alias("rtf"))
    parsed = P.parse(docs, want=("uses", "fonts", "default_font"))
    return A.resolve_fonts(*(P.table(parsed, name) for name in ("uses", "fonts", "default_font"))).groupBy("family").agg(F.sum("length").alias("n"))


@query("""
SELECT p_partkey AS doc_id, 1 AS color_idx, p_size AS r, p_size * 3 AS g, 255 AS b FROM part UNION ALL SELECT p_partkey, 3, 0, 7, 0 FROM part
""")
def color_resolution(spark, sf_dir):
    size = F.col("p_size").cast("string")
    body = F.concat(F.lit("{\\colortbl;\\red"), size, F.lit("\\green"), (F.col("p_size") * 3).cast("string"), F.lit("\\blue900;;\\green7;\\red9}x"))
    g = T.groups(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), document(body).alias("rtf"))).where("level = 2")
    # a token of text may hold several semicolons: one row for each, between the words around it
    split = g.select("doc_id", (F.col("pos") * 100).alias("pos"), "word", "param", F.lit(False).alias("semicolon")).where("word IS NOT NULL").unionByName(
        g.where("kind = 'text'").select("doc_id", "pos", F.posexplode(F.regexp_extract_all("text", F.lit("(;)"), F.lit(1))).alias("k", "s")).select("doc_id", (F.col("pos") * 100 + F.col("k")).alias("pos"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("int").alias("param"), F.lit(True).alias("semicolon"))
    )
    return A.color_table(split).select("doc_id", F.col("color_idx").cast("int").alias("color_idx"), "r", "g", "b")


@query("""
SELECT p_partkey AS doc_id, CAST(floor(CAST(100 AS FLOAT) + CAST(155 AS FLOAT) * (CAST(p_size AS FLOAT) / CAST(255 AS FLOAT)) + CAST(0.5 AS FLOAT)) AS INTEGER) AS tinted,
  CAST(floor(CAST(CAST(200 AS FLOAT) * (CAST(1 AS FLOAT) - CAST(p_size AS FLOAT) / CAST(255 AS FLOAT)) AS FLOAT) + CAST(0.5 AS FLOAT)) AS INTEGER) AS shaded,
  ['#FFFFFF', '#000000', '#E7E6E6', '#44546A', '#4472C4', '#ED7D31', '#A5A5A5', '#FFC000', '#5B9BD5', '#70AD47', '#0563C1', '#954F72'][p_partkey % 14 + 1] AS base FROM part
""")
def theme_tint_shade(spark, sf_dir):
    """All twelve entries of the theme, and two indexes beyond it."""
    base = C.theme_base((F.col("p_partkey") % 14).cast("int"))
    hexadecimal = F.concat(F.lit("#"), *(F.lpad(F.hex(base[c]), 2, "0") for c in "rgb"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), C.tint(F.lit(100), "p_size").alias("tinted"), C.shade(F.lit(200), "p_size").alias("shaded"), hexadecimal.alias("base"))


@query("""
WITH k AS (SELECT unnest([500, 1000, 2000, 2500, 3000, 4000, 5000, 6000, 7000, 7500, 8000, 9000]) AS c), p AS (SELECT p_partkey, CAST((p_partkey * 37) % 11000 - 400 AS BIGINT) AS q FROM part),
n AS (SELECT p_partkey, first(c ORDER BY abs(least(greatest(q, 0), 10000) - c), c) AS c FROM p, k GROUP BY p_partkey)
SELECT p_partkey AS doc_id, CASE WHEN q <= 0 THEN 'clear' WHEN q >= 10000 THEN 'solid' ELSE 'percent' || (c // 100) END AS pattern FROM p JOIN n USING (p_partkey)
""")
def shading_nearest_pattern(spark, sf_dir):
    p = (F.col("p_partkey") * 37) % 11000 - 400
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), C.nearest_pattern(p).alias("pattern"))


@query("""
SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN 'cell' WHEN p_size % 3 = 0 THEN 'row' WHEN p_size % 5 = 0 THEN 'table' END AS fill, CAST((200 * (100 - p_size % 100) + 17 * (p_size % 100) + 50) // 100 AS INTEGER) AS blended FROM part
""")
def shading_fallback(spark, sf_dir):
    """The table's fill is what its first row says; the second row's cell falls back to its row, then to the table."""
    own = lambda m, said: F.when(F.col("p_size") % m == 0, said).otherwise("")
    percent = (F.col("p_size") % 100 * 100).cast("string")
    body = F.concat(F.lit("\\trowd"), own(5, "\\trcbpat3"), F.lit("\\cellx900 \\pard\\intbl a\\cell\\row\\trowd"), own(3, "\\trcbpat2"), own(2, "\\clcbpat1"), F.lit("\\clshdng"), percent, F.lit("\\cellx900 \\pard\\intbl b\\cell\\row "))
    parsed = P.parse(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), document(body).alias("rtf")), want=("cells",))
    names = F.create_map(*(F.lit(x) for x in (1, "cell", 2, "row", 3, "table")))
    cells = A.shading(P.table(parsed, "cells").where("row = 1"))
    return cells.select("doc_id", names[F.col("fill")].alias("fill"), C.blend(F.lit(200), F.lit(17), (F.col("percent") / 100).cast("int")).alias("blended"))


# ---- tables


@query("""
SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS quantity, count(DISTINCT l_orderkey) AS tables FROM lineitem GROUP BY ALL
""")
def cell_values_agg(spark, sf_dir):
    docs = encode_rows(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_quantity", "l_returnflag"])
    # the cells of a row stand in one array: no shuffle puts them together
    rows = T.cells(docs).select("doc_id", F.get("cells", F.lit(0)).cast("double").alias("q"), F.get("cells", F.lit(1)).alias("flag"))
    return rows.groupBy("flag").agg(F.count("*").alias("n"), F.sum("q").alias("quantity"), F.count_distinct("doc_id").alias("tables"))


@query("SELECT o_custkey AS doc_id, o_orderkey AS col, o_orderkey % 1000 + 1 AS width FROM orders")
def cell_widths(spark, sf_dir):
    k = F.col("o_orderkey")
    right = F.sum(k % 1000 + 1).over(Window.partitionBy("o_custkey").orderBy(k).rowsBetween(Window.unboundedPreceding, 0))
    cells = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("row"), k.alias("col"), F.concat(F.lit("\\cellx"), right.cast("string")).alias("words"), k.cast("string").alias("text"))
    parsed = P.parse(table_documents(cells), want=("cells",))
    return A.cell_widths(P.table(parsed, "cells")).select("doc_id", F.col("text").cast("long").alias("col"), F.col("width").cast("long").alias("width"))


@query("""
SELECT l_orderkey AS doc_id, 0 AS row, count(*) AS n_cells, count(*) FILTER (l_linenumber <= 3) AS n_boundaries FROM lineitem GROUP BY l_orderkey HAVING count(*) <> count(*) FILTER (l_linenumber <= 3) AND count(*) FILTER (l_linenumber <= 3) > 0
""")
def row_cell_mismatch(spark, sf_dir):
    n = F.col("l_linenumber")
    edge = F.when(n <= 3, F.concat(F.lit("\\cellx"), (n * 500).cast("string"))).otherwise("")
    cells = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("row"), n.alias("col"), edge.alias("words"), F.lit("x").alias("text"))
    cells = P.table(P.parse(table_documents(cells), want=("cells",)), "cells")
    return A.count_mismatches(cells, cells.where("right IS NOT NULL")).drop("row_key")


@query("""
WITH c AS (SELECT p_partkey // 10 AS doc_id, 0 AS row, p_partkey % 10 AS col, CASE p_size % 4 WHEN 0 THEN 'start' WHEN 3 THEN NULL ELSE 'continue' END AS merge FROM part),
n AS (SELECT *, (SELECT min(d.col) FROM c d WHERE d.doc_id = c.doc_id AND d.col > c.col AND d.merge IS DISTINCT FROM 'continue') AS stop, (SELECT max(d.col) FROM c d WHERE d.doc_id = c.doc_id) + 1 AS ends,
  (SELECT arg_max(coalesce(d.merge, 'none'), d.col) FROM c d WHERE d.doc_id = c.doc_id AND d.col < c.col AND d.merge IS DISTINCT FROM 'continue') AS led FROM c)
SELECT doc_id, row, col, merge, CASE WHEN merge = 'start' AND coalesce(stop, ends) - col > 1 THEN coalesce(stop, ends) - col END AS span, coalesce(merge = 'continue' AND coalesce(led, 'none') <> 'start', false) AS orphan FROM n
""")
def hmerge_spans(spark, sf_dir):
    k, merge = F.col("p_partkey"), F.when(F.col("p_size") % 4 == 0, "\\clmgf").when(F.col("p_size") % 4 != 3, "\\clmrg").otherwise("")
    cells = read(spark, sf_dir, "part").select(F.floor(k / 10).alias("doc_id"), F.lit(0).alias("row"), (k % 10).alias("col"), edged(merge, k % 10).alias("words"), F.lit("x").alias("text"))
    parsed = P.table(P.parse(table_documents(cells), want=("cells",)), "cells")
    merges = F.when(F.col("merge") == "horizontal_start", "start").when(F.col("merge") == "horizontal_continue", "continue")
    return A.horizontal_spans(parsed.select("doc_id", "row", "col", merges.alias("merge"))).withColumn("orphan", F.coalesce("orphan", F.lit(False)))


@query("""
WITH c AS (SELECT p_partkey // 50 AS doc_id, (p_partkey % 50) // 5 AS row, p_partkey % 5 AS col, CASE p_size % 3 WHEN 0 THEN 'vstart' WHEN 1 THEN 'vcontinue' END AS merge FROM part),
n AS (SELECT *, (SELECT min(d.row) FROM c d WHERE d.doc_id = c.doc_id AND d.col = c.col AND d.row > c.row AND d.merge IS DISTINCT FROM 'vcontinue') AS stop, (SELECT max(d.row) FROM c d WHERE d.doc_id = c.doc_id AND d.col = c.col) + 1 AS ends FROM c)
SELECT doc_id, row, col, merge, CASE WHEN merge = 'vstart' THEN coalesce(stop, ends) - row END AS rowspan FROM n
""")
def vmerge_rowspans(spark, sf_dir):
    k, merge = F.col("p_partkey"), F.when(F.col("p_size") % 3 == 0, "\\clvmgf").when(F.col("p_size") % 3 == 1, "\\clvmrg").otherwise("")
    cells = read(spark, sf_dir, "part").select(F.floor(k / 50).alias("doc_id"), F.floor(k % 50 / 5).alias("row"), (k % 5).alias("col"), edged(merge, k % 5).alias("words"), F.lit("x").alias("text"))
    parsed = P.table(P.parse(table_documents(cells), want=("cells",)), "cells")
    merges = F.when(F.col("merge") == "vertical_start", "vstart").when(F.col("merge") == "vertical_continue", "vcontinue")
    return A.vertical_spans(parsed.select("doc_id", "row", "col", merges.alias("merge")))


@query("""
WITH c AS (SELECT k // 20 AS d, (k % 20) // 4 AS r, k % 4 AS c, CASE WHEN p_size % 2 = 0 THEN p_size END AS t, CASE WHEN p_size % 3 = 0 THEN p_size + 1 END AS l, CASE WHEN p_size % 5 = 0 THEN p_size + 2 END AS b,
  CASE WHEN p_size % 7 = 0 THEN p_size + 3 END AS g, CASE WHEN (k % 20) // 4 % 2 = 0 THEN 100 END AS h, CASE WHEN (k % 20) // 4 % 3 = 0 THEN 200 END AS v FROM (SELECT *, p_partkey AS k FROM part))
SELECT c.d AS doc_id, c.r AS row, c.c AS col,
  CAST(coalesce(CASE WHEN u.d IS NULL THEN coalesce(c.t, 7) WHEN c.t IS NOT NULL OR u.b IS NOT NULL THEN CASE WHEN u.b IS NULL THEN c.t END WHEN u.h IS NULL THEN c.h END, -1) AS BIGINT) AS draw_top,
  CAST(coalesce(CASE WHEN w.d IS NULL THEN coalesce(c.l, 8) WHEN c.l IS NOT NULL OR w.g IS NOT NULL THEN CASE WHEN w.g IS NULL THEN c.l END WHEN w.v IS NULL THEN c.v END, -1) AS BIGINT) AS draw_left,
  CAST(coalesce(CASE WHEN x.d IS NULL THEN c.b WHEN c.b IS NOT NULL OR x.t IS NOT NULL THEN c.b ELSE c.h END, -1) AS BIGINT) AS draw_bottom,
  CAST(coalesce(CASE WHEN y.d IS NULL THEN c.g WHEN c.g IS NOT NULL OR y.l IS NOT NULL THEN c.g ELSE c.v END, -1) AS BIGINT) AS draw_right
FROM c LEFT JOIN c u ON u.d = c.d AND u.c = c.c AND u.r = c.r - 1 LEFT JOIN c w ON w.d = c.d AND w.r = c.r AND w.c = c.c - 1 LEFT JOIN c x ON x.d = c.d AND x.c = c.c AND x.r = c.r + 1 LEFT JOIN c y ON y.d = c.d AND y.r = c.r AND y.c = c.c + 1
""")
def effective_borders(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    row = F.floor(k % 20 / 4)
    own = lambda m, side, add: F.when(s % m == 0, F.concat(F.lit(f"\\clbrdr{side}\\brdrs\\brdrw"), (s + add).cast("string"))).otherwise("")
    words = edged(F.concat(own(2, "t", 0), own(3, "l", 1), own(5, "b", 2), own(7, "r", 3)), k % 4)
    of_row = F.concat(F.lit("\\trbrdrt\\brdrs\\brdrw7\\trbrdrl\\brdrs\\brdrw8"), F.when(row % 2 == 0, "\\trbrdrh\\brdrs\\brdrw100").otherwise(""), F.when(row % 3 == 0, "\\trbrdrv\\brdrs\\brdrw200").otherwise(""))
    cells = read(spark, sf_dir, "part").select(F.floor(k / 20).alias("doc_id"), row.alias("row"), (k % 4).alias("col"), words.alias("words"), of_row.alias("row_words"), F.lit("x").alias("text"))
    parsed = P.table(P.parse(table_documents(cells), want=("cells",)), "cells").drop("right").withColumnRenamed("right_border", "right")
    return A.effective_borders(parsed).select("doc_id", "row", "col", *(F.coalesce(F.col(f"draw_{side}"), F.lit(-1)).cast("long").alias(f"draw_{side}") for side in ("top", "left", "bottom", "right")))


# ---- lists

LIST_HEAD = "{\\*\\listtable{\\list{\\listlevel\\levelnfc0}{\\listlevel\\levelnfc23}\\listid7}}{\\*\\listoverridetable{\\listoverride\\listid7\\ls1}}"


@query("""
SELECT r_regionkey AS doc_id, level, 'ordered_decimal' AS kind, count(*) AS n FROM (SELECT r_regionkey, 0 AS level FROM region UNION ALL SELECT n_regionkey, 1 FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY ALL
""")
def list_items_by_level(spark, sf_dir):
    """A region's item and its nations' below it are one list as far as their kind is the same: level 1 is a bullet list of its own."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    head = region.select("r_regionkey", F.lit(-1).alias("o"), F.lit(0).alias("level"), F.col("r_name").alias("t"))
    below = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("r_regionkey", F.col("n_nationkey").alias("o"), F.lit(1).alias("level"), F.col("n_name").alias("t"))
    item = F.concat(F.lit("\\pard\\ls1\\ilvl"), F.col("level").cast("string"), F.lit(" "), escaped("t"), F.lit("\\par "))
    head_text = LIST_HEAD.replace("\\levelnfc23", "\\levelnfc2")
    docs = head.unionByName(below).groupBy(F.col("r_regionkey").alias("doc_id")).agg(document(F.concat(F.lit(head_text), joined(item, F.col("o")))).alias("rtf"))
    items = P.table(P.parse(docs, want=("nodes",)), "nodes").where("node_type = 'list_item'")
    return items.groupBy("doc_id", "level", F.col("list_kind").alias("kind")).agg(F.count("*").alias("n"))


@query("""
SELECT unresolved, kind, count(*) AS n FROM (SELECT c_custkey % 5 NOT IN (1, 2, 3) AS unresolved, CASE WHEN c_custkey % 5 = 1 THEN 'ordered_decimal' WHEN c_custkey % 5 IN (2, 3) THEN 'bullet' END AS kind FROM customer) GROUP BY ALL
""")
def unresolved_lists(spark, sf_dir):
    """List 30 isn't in the table of lists: its items are bullets. Override 4 and 0 aren't defined."""
    head = "{\\*\\listtable{\\list{\\listlevel\\levelnfc0}\\listid10}{\\list{\\listlevel\\levelnfc23}\\listid20}}{\\*\\listoverridetable{\\listoverride\\listid10\\ls1}{\\listoverride\\listid20\\ls2}{\\listoverride\\listid30\\ls3}}"
    marks, overrides, levels = marked_lists(read(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", F.col("c_custkey") % 5, F.lit(0), head)
    return A.resolve_lists(marks, overrides, levels).groupBy("unresolved", "kind").agg(F.count("*").alias("n"))


@query("""
WITH i AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderkey // 2 % 2 AS list_id, o_orderstatus AS kind FROM orders),
c AS (SELECT *, CASE WHEN list_id = lag(list_id) OVER w AND kind = lag(kind) OVER w THEN 0 ELSE 1 END AS b FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, CAST(sum(b) AS BIGINT) AS n_blocks, count(*) AS n_items FROM c GROUP BY doc_id
""")
def list_grouping(spark, sf_dir):
    """A list for each of the two numbers and each status."""
    lists = "".join(f"{{\\list{{\\listlevel\\levelnfc{0 if i % 3 else 23}}}\\listid{i}}}" for i in range(1, 7))
    head = f"{{\\*\\listtable{lists}}}{{\\*\\listoverridetable{''.join(f'{{\\listoverride\\listid{i}\\ls{i}}}' for i in range(1, 7))}}}"
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    found = marked_lists(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.floor(F.col("o_orderkey") / 2) % 2 * 3 + status, F.lit(0), head)
    return A.list_blocks(A.resolve_lists(*found)).groupBy("doc_id").agg(F.count_distinct("block").alias("n_blocks"), F.count("*").alias("n_items"))


@query("""
WITH RECURSIVE i AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CAST(o_orderkey * 7 % 9 AS INTEGER) AS level FROM orders),
c AS (SELECT doc_id, n, level, level AS shown FROM i WHERE n = 1 UNION ALL SELECT i.doc_id, i.n, i.level, least(i.level, c.shown + 1) FROM c JOIN i ON i.doc_id = c.doc_id AND i.n = c.n + 1)
SELECT doc_id, CAST(sum(shown) AS BIGINT) AS depth_sum, count(*) FILTER (shown < level) AS n_clamped FROM c GROUP BY doc_id
""")
def list_levels_clamped(spark, sf_dir):
    head = "{\\*\\listtable{\\list" + "{\\listlevel\\levelnfc0}" * 9 + "\\listid7}}{\\*\\listoverridetable{\\listoverride\\listid7\\ls1}}"
    marks, _, _ = marked_lists(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.lit(1), F.col("o_orderkey") * 7 % 9, head)
    return A.clamped_levels(marks.withColumn("block", F.lit(0))).groupBy("doc_id").agg(F.sum("shown").cast("long").alias("depth_sum"), F.count_if(F.col("shown") < F.col("level")).alias("n_clamped"))


@query("""
WITH l AS (SELECT o_custkey AS doc_id, o_orderkey % 4 AS list_id, min(o_orderkey) AS pos, list_sort(list_distinct(list(o_orderkey % 3 % 2))) AS levels FROM orders GROUP BY ALL),
d AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, levels) AS dp, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM l)
SELECT doc_id, list_id, n + 1 AS num_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY dp) AS abstract_id FROM d
""")
def numbering_ids(spark, sf_dir):
    lists = "".join("{\\list" + "{\\listlevel\\levelnfc23}" * 2 + f"\\listid{i}}}" for i in range(4))
    head = f"{{\\*\\listtable{lists}}}{{\\*\\listoverridetable{''.join(f'{{\\listoverride\\listid{i}\\ls{i + 1}}}' for i in range(4))}}}"
    key = F.col("o_orderkey")
    found = marked_lists(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", key % 4 + 1, key % 3 % 2, head)
    uses = A.resolve_lists(*found).withColumnRenamed("ord", "pos")
    return A.numbering_ids(uses).select("doc_id", "list_id", F.col("num_id").cast("long").alias("num_id"), F.col("abstract_id").cast("long").alias("abstract_id"))


# ---- fields and references


@query("""
SELECT scheme, count(*) AS n FROM (SELECT CASE WHEN page_id % 5 = 0 THEN 'dropped' WHEN url LIKE 'https://%' THEN 'https' ELSE 'http' END AS scheme FROM pages) GROUP BY scheme
""")
def hyperlinks_by_scheme(spark, sf_dir):
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("ftp://x/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    field = F.concat(F.lit('{\\field{\\*\\fldinst HYPERLINK "'), escaped(url), F.lit('"}{\\fldrslt link}}'))
    parsed = P.parse(read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), document(field).alias("rtf")))
    links = P.table(parsed, "inlines").where("inline_type = 'hyperlink'").select(F.regexp_extract("target", "^([a-z]+):", 1).alias("scheme"))
    drops = P.table(parsed, "warnings").where("reason = 'Unsupported hyperlink URL scheme'").select(F.lit("dropped").alias("scheme"))
    return links.union(drops).groupBy("scheme").agg(F.count("*").alias("n"))


def cross_references(spark, sf_dir):
    mark = F.concat(F.lit("{\\*\\bkmkstart b"), (F.col("s_suppkey") % 3).cast("string"), F.lit("}here{\\*\\bkmkend b"), (F.col("s_suppkey") % 3).cast("string"), F.lit("}\\par "))
    refs = "{\\field{\\*\\fldinst REF b0 \\\\h}{\\fldrslt zero}}{\\field{\\*\\fldinst NOTEREF b1}{\\fldrslt one}}{\\field{\\*\\fldinst REF b0}{\\fldrslt again}}"
    return P.parse(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), document(F.concat(mark, F.lit(refs))).alias("rtf")))


@query("""
SELECT s_suppkey AS doc_id, 'b' || k AS target FROM supplier, (SELECT unnest([0, 1]) AS k) WHERE s_suppkey % 3 <> k
""")
def unresolved_refs(spark, sf_dir):
    inlines = P.table(cross_references(spark, sf_dir), "inlines")
    refs = inlines.where("kind IN ('ref', 'note_ref') AND inline_type = 'semantic_field'").select("doc_id", "target")
    return A.unresolved(refs, inlines.where("inline_type = 'bookmark_anchor'").select("doc_id", F.col("target").alias("name"))).select("doc_id", "target")


@query("""
SELECT s_suppkey AS doc_id, 'b' || (s_suppkey % 3) AS target, CASE s_suppkey % 3 WHEN 0 THEN 2 ELSE 1 END AS n FROM supplier WHERE s_suppkey % 3 < 2
""")
def resolved_refs(spark, sf_dir):
    inlines = P.table(cross_references(spark, sf_dir), "inlines").where("resolved AND kind IN ('ref', 'note_ref')")
    return inlines.groupBy("doc_id", "target").agg(F.count("*").alias("n"))


FIELDS = ("PAGE", "NUMPAGES \\\\* roman", "SEQ Figure \\\\* ARABIC", "DOCPROPERTY Company", "AUTHOR", "MERGEFIELD name", "PAGEREF here", "NOSUCHFIELD x")


@query("""
SELECT kind, count(*) AS n FROM (SELECT ['current_page', 'total_pages', 'sequence', 'doc_property', 'doc_property', 'merge_field', 'page_ref', 'run'][p_partkey % 8 + 1] AS kind FROM part) GROUP BY kind
""")
def field_kinds(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, FIELDS)), (F.col("p_partkey") % 8).cast("int"))
    field = F.concat(F.lit("{\\field{\\*\\fldinst "), said, F.lit("}{\\fldrslt r}}"))
    docs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), document(field).alias("rtf"))
    return P.table(P.parse(docs, want=("inlines",)), "inlines").groupBy(F.coalesce("kind", "inline_type").alias("kind")).agg(F.count("*").alias("n"))


@query("""
SELECT o_custkey AS doc_id, count(*) FILTER (o_orderkey % 2 = 0) AS headings, count(*) FILTER (o_orderkey % 2 = 0) >= 3 AS has_toc FROM orders GROUP BY o_custkey
""")
def headings_toc(spark, sf_dir):
    line = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "{\\b\\fs28 Order ").otherwise("{order "), F.col("o_orderkey").cast("string"), F.lit("}\\par "))
    docs = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(document(joined(line, F.col("o_orderkey"))).alias("rtf"))
    parsed = P.parse(docs, want=("nodes", "generated"))
    return parsed.select("doc_id", F.size(F.filter("nodes", lambda n: F.coalesce(n["is_heading"], F.lit(False)))).cast("long").alias("headings"), (F.size("generated") > 0).alias("has_toc"))


@query("""
SELECT o_custkey AS doc_id, CAST(0 AS BIGINT) AS ord, 'table_of_contents' AS what FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 2 = 0) >= 3
UNION ALL SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 + CASE WHEN count(*) FILTER (o_orderkey % 2 = 0) OVER (PARTITION BY o_custkey) >= 3 THEN 1 ELSE 0 END, o_orderpriority FROM orders
""")
def generated_blocks(spark, sf_dir):
    line = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "{\\b\\fs28 ").otherwise("{"), escaped("o_orderpriority"), F.lit("}\\par "))
    docs = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(document(joined(line, F.col("o_orderkey"))).alias("rtf"))
    parsed = P.parse(docs, want=("nodes", "generated"))
    blocks = P.table(parsed, "nodes").where("node_type = 'paragraph'").select("doc_id", F.get("path", F.lit(0)).alias("ord"), F.col("text").alias("what"))
    return A.with_generated(blocks, P.table(parsed, "generated")).withColumn("ord", F.col("ord").cast("long"))


# ---- warnings, sections, notes, images


def warned(spark, sf_dir):
    k = F.col("p_partkey")
    when = lambda m, text: F.when(k % m == 0, text).otherwise("")
    body = F.concat(when(2, "\\nosuchword1 "), when(3, "{\\*\\nosuchdest x}"), when(5, "{\\obj x}"), when(7, "\\cell "), when(11, "\\ls9 "), F.lit("text\\par "))
    return P.parse(read(spark, sf_dir, "part").select(k.alias("doc_id"), document(body).alias("rtf")))


@query("""
WITH w AS (SELECT 'unsupported_control_word' AS type, 'warning' AS severity FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'unknown_destination', 'info' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'dropped_content', 'warning' FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT 'dropped_content', 'warning' FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT unnest(['malformed_table_structure', 'dropped_content']), 'warning' FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT unnest(['unresolved_list_override', 'dropped_content']), 'warning' FROM part WHERE p_partkey % 11 = 0)
SELECT type, severity, count(*) AS n FROM w GROUP BY ALL
""")
def warnings_by_type(spark, sf_dir):
    return P.table(warned(spark, sf_dir), "warnings").groupBy("type", "severity").agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN 4 ELSE 0 END AS status FROM part
""")
def strict_status(spark, sf_dir):
    return P.status(warned(spark, sf_dir), strict=True)


def warned_events(spark, sf_dir, limits=None):
    said = F.when(F.col("event_id") % 11 == 0, "{\\obj x}").otherwise(F.concat(F.lit("\\odd"), F.col("event_type"), F.lit(" ")))
    docs = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(document(joined(said, F.col("event_id"))).alias("rtf"))
    w = P.table(P.parse(docs, limits, want=("warnings",)), "warnings")
    return w.select("doc_id", "seq", F.when(F.col("type") == "dropped_content", F.col("type")).otherwise(F.substr("word", F.lit(4))).alias("type"))


@query("""
WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM (SELECT user_id, event_id, CASE WHEN event_id % 11 = 0 THEN 'dropped_content' ELSE event_type END AS event_type FROM events)),
d AS (SELECT user_id, min(n) AS dn FROM e WHERE event_type = 'dropped_content' GROUP BY user_id)
SELECT user_id AS doc_id, CAST(n - 1 AS INTEGER) AS seq, event_type AS type FROM e LEFT JOIN d USING (user_id) WHERE CASE WHEN dn > 5 THEN n < 5 OR n = dn ELSE n <= 5 END
""")
def warning_cap(spark, sf_dir):
    return A.capped_warnings(warned_events(spark, sf_dir, Limits(max_warnings=2**31)), 5)


@query("""
WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM (SELECT user_id, event_id, CASE WHEN event_id % 11 = 0 THEN 'dropped_content' ELSE event_type END AS event_type FROM events)),
d AS (SELECT user_id, min(n) AS dn FROM e WHERE event_type = 'dropped_content' GROUP BY user_id)
SELECT user_id AS doc_id, CAST(least(n, 5) - 1 AS INTEGER) AS seq, event_type AS type FROM e LEFT JOIN d USING (user_id) WHERE CASE WHEN dn > 5 THEN n < 5 OR n = dn ELSE n <= 5 END
""")
def reader_warning_cap(spark, sf_dir):
    """The same by the reader, which stops taking warnings."""
    return warned_events(spark, sf_dir, Limits(max_warnings=5))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER w AS section, coalesce(last_value(CASE WHEN o_orderkey % 5 = 0 THEN 'roman_lower' WHEN o_orderkey % 7 = 0 THEN 'arabic' END IGNORE NULLS) OVER w, 'arabic') AS f
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))
SELECT f AS number_format, CAST(section AS BIGINT) AS section, count(*) AS n FROM s GROUP BY ALL
""")
def sections_numbering(spark, sf_dir):
    """Sections and formats in force at each word of text, from tokens."""
    k = F.col("o_orderkey")
    line = F.concat(F.when(F.col("o_orderstatus") == "F", "\\sect").otherwise(""), F.when(k % 5 == 0, "\\pgnlcrm").when(k % 7 == 0, "\\pgndec").otherwise(""), F.lit("{x}\\par "))
    docs = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(document(joined(line, k)).alias("rtf"))
    formats = F.when(F.col("word") == "pgnlcrm", "roman_lower").when(F.col("word") == "pgnucrm", "roman_upper").when(F.col("word") == "pgndec", "arabic")
    tokens = T.groups(docs).select("doc_id", "pos", "kind", F.col("word").eqNullSafe("sect").alias("is_break"), formats.alias("format")).where("is_break OR format IS NOT NULL OR kind = 'text'")
    return A.sections(tokens).where("kind = 'text'").groupBy("number_format", "section").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderstatus AS note, count(*) AS n, CAST(sum(k) AS BIGINT) AS id_sum FROM (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) GROUP BY o_orderstatus
""")
def notes_join(spark, sf_dir):
    line = F.concat(F.lit("order{\\footnote "), escaped("o_orderstatus"), F.lit("}\\par "))
    docs = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(document(joined(line, F.col("o_orderkey"))).alias("rtf"))
    parsed = P.parse(docs)
    refs = P.table(parsed, "inlines").where("inline_type = 'note_ref'").select("doc_id", F.concat(F.lit("note:"), F.col("note_id").cast("string")).alias("channel"), "note_id")
    bodies = P.table(parsed, "nodes").where("channel LIKE 'note:%' AND node_type = 'paragraph'").select("doc_id", "channel", F.col("text").alias("note"))
    return refs.join(bodies, ["doc_id", "channel"]).groupBy("note").agg(F.count("*").alias("n"), F.sum("note_id").alias("id_sum"))


@query("""
WITH t AS (SELECT p_brand, row_number() OVER w - 1 AS pos, sum(p_size * 10) OVER w AS total FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))
SELECT p_brand AS doc_id, CAST(max(total) AS BIGINT) AS total, CAST(min(pos) FILTER (total > 5000) AS BIGINT) AS failed_at FROM t GROUP BY p_brand
""")
def image_budget(spark, sf_dir):
    """A brand's pictures stand in documents of PART keys each, as all of them are more than a document may have bytes; the budget runs through a brand's documents."""
    picture = F.concat(F.lit("{\\pict\\pngblip "), F.expr("repeat('0a', p_size * 10)"), F.lit("}"))
    part = F.struct(F.col("p_brand").alias("doc_id"), F.floor(F.col("p_partkey") / PART).alias("part")).alias("doc_id")
    docs = read(spark, sf_dir, "part").groupBy(part).agg(document(joined(picture, F.col("p_partkey"))).alias("rtf"))
    images = F.filter("nodes", lambda x: x["node_type"] == "image")
    parts = P.parse(docs, want=("nodes.node_type", "nodes.image_bytes")).select("doc_id.*", F.transform(images, lambda x: x["image_bytes"].cast("long")).alias("sizes"))
    return A.within_budget_of_parts(parts, 5000)


@query("""
SELECT p_partkey AS doc_id, CAST(CASE WHEN p_size % 4 = 3 THEN NULL ELSE p_size END AS INTEGER) AS n_bytes, CAST(p_size * 20 * 50 // 100 AS INTEGER) AS width_twips FROM part WHERE p_size % 4 <> 3
""")
def image_sizes(spark, sf_dir):
    """Pictures of p_size bytes; those with an odd digit are dropped."""
    odd = F.when(F.col("p_size") % 4 == 3, "f").otherwise("")
    body = F.concat(F.lit("{\\pict\\pngblip\\picscalex50\\picwgoal"), (F.col("p_size") * 20).cast("string"), F.lit(" "), F.expr("repeat('0a', p_size)"), odd, F.lit("}"))
    docs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), document(body).alias("rtf"))
    return P.table(P.parse(docs, want=("nodes",)), "nodes").where("node_type = 'image'").select("doc_id", F.col("image_bytes").alias("n_bytes"), "width_twips")


# ---- writers


@query(r"""
SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS html,
  md5(replace(replace(replace(replace(replace(html, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')) AS typst_string,
  md5(replace(replace(replace(replace(replace(html, '\', '\\'), '"', '\"'), '''', '\'''), chr(10), '\A '), chr(13), '\D ')) AS css, md5(regexp_replace(html, '([\[\]*_@#\\$~])', '\\\1', 'g')) AS typst FROM pages
""")
def escapes(spark, sf_dir):
    digest = lambda c: F.md5(c.cast("binary"))
    return read(spark, sf_dir, "pages").select("page_id", digest(C.escape_html("html")).alias("html"), digest(C.escape_typst_string("html")).alias("typst_string"), digest(C.escape_css_string("html")).alias("css"), digest(C.escape_typst("html")).alias("typst"))


@query("""
SELECT doc_id, md5(coalesce(string_agg('<p class="rtf-p">' || replace(replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || '</p>', '' ORDER BY i) FILTER (p <> ''), '')) AS digest
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) GROUP BY doc_id
""")
def html_render(spark, sf_dir):
    return convert_to_html(encoded_documents(spark, sf_dir), wrapper=False).select("doc_id", F.md5(F.col("html").cast("binary")).alias("digest"))


@query("SELECT l_orderkey AS doc_id, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey")
def html_table_rows(spark, sf_dir):
    docs = encode_rows(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_partkey", "l_shipdate"])
    out = convert_to_html(docs, profile=None)
    return out.select("doc_id", F.size(F.regexp_extract_all("html", F.lit("(<tr>)"), F.lit(1))).cast("long").alias("n_rows"))


@query("""
SELECT doc_id, count(p) FILTER (p <> '') AS n_blocks FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) GROUP BY doc_id
""")
def ir_json_blocks(spark, sf_dir):
    parsed = P.parse(encoded_documents(spark, sf_dir), want=("ir",))
    return parsed.select("doc_id", F.size(F.from_json("ir", "blocks array<struct<type string>>")["blocks"]).cast("long").alias("n_blocks"))


@query(r"""
SELECT doc_id, md5(coalesce(string_agg(regexp_replace(p, '([\[\]*_@#\\$~])', '\\\1', 'g'), chr(10) || chr(10) ORDER BY i) FILTER (p <> ''), '')) AS digest
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) GROUP BY doc_id
""")
def typst_render(spark, sf_dir):
    """The body's source, after the preamble."""
    out = convert_to_typst(encoded_documents(spark, sf_dir))
    return out.select("doc_id", F.md5(F.expr("substr(typst, instr(typst, '\\n\\n') + 2, length(typst) - instr(typst, '\\n\\n') - 2)").cast("binary")).alias("digest"))


@query(r"""
SELECT doc_id, md5(regexp_replace(replace(replace(text, chr(10), ''), ' ', ''), '[^\x00-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]', '?', 'g')) AS digest, true AS has_end FROM documents
""")
def pdf_render(spark, sf_dir):
    """The letters of all pages, in the order in which they are drawn; spaces are distances."""
    out = convert_to_pdf(encoded_documents(spark, sf_dir), numbering="never")
    pages = pdf_pages(out).groupBy("doc_id").agg(joined(F.array_join("pieces", ""), F.col("page")).alias("letters"))
    ends = out.select("doc_id", (F.substring("pdf", -6, 5) == F.lit(b"%%EOF")).alias("has_end"))
    return ends.join(pages, "doc_id").select("doc_id", F.md5(F.col("letters").cast("binary")).alias("digest"), "has_end")


@query("""
SELECT doc_id, count(p) FILTER (p <> '') AS n_paragraphs, md5(coalesce(string_agg(p, chr(10) ORDER BY i) FILTER (p <> ''), '')) AS digest
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) GROUP BY doc_id HAVING count(p) FILTER (p <> '') > 0
""")
def docx_render(spark, sf_dir):
    """The paragraphs of the package's document part, read back."""
    p = docx_paragraphs(convert_to_docx(encoded_documents(spark, sf_dir))).where("part = 'document'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    return p.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.md5(text.cast("binary")).alias("digest"))


def sized_tables(spark, sf_dir):
    """A table for every ten parts: a row for each, with a cell of two columns and one of its own, borders, heights and widths."""
    k, s = F.col("p_partkey"), F.col("p_size")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    row = said("\\trowd\\trqc\\trleft", s, "\\trgaph30\\trrh", F.when(k % 2 == 0, s * 10).otherwise(-s * 10), "\\trftswidth3\\trwwidth5000\\clmgf\\clbrdrt\\brdrdb\\brdrw", s, "\\clcbpat1\\cellx", s * 100, "\\clmrg\\cellx", s * 200, "\\clvertalb\\clpadl", s * 20, "\\clpadfl3\\cellx", s * 300, " \\pard\\intbl x\\cell\\cell y\\cell\\row ")
    return read(spark, sf_dir, "part").groupBy(F.floor(k / 10).alias("doc_id")).agg(document(joined(row, k), "{\\colortbl;\\red17\\green34\\blue51;}").alias("rtf"))


@query("""
SELECT p_partkey // 10 AS doc_id, count(*) AS n_rows, CAST(sum(p_size * 10) AS BIGINT) AS heights, count(*) FILTER (p_partkey % 2 = 1) AS exact, count(*) * 2 AS spans, CAST(sum(p_size * 4) AS BIGINT) AS borders, count(*) AS fills,
  CAST(sum(p_size * 20) AS BIGINT) AS padding, CAST(min_by(p_size, p_partkey) AS BIGINT) AS indent, CAST(5000 AS BIGINT) AS width, CAST(30 AS BIGINT) AS gap FROM part GROUP BY 1
""")
def docx_tables(spark, sf_dir):
    """Properties of tables, rows and cells as they stand in the package."""
    x = docx_elements(convert_to_docx(sized_tables(spark, sf_dir)), ["trHeight", "gridSpan", "top", "shd", "left", "tblInd", "tblW", "tblCellSpacing"]).where("part = 'document'")
    of = lambda name, key: F.when(F.col("element") == name, F.col("attributes")[key])
    total = lambda c: F.sum(c.cast("long"))
    return x.groupBy("doc_id").agg(
        F.count_if(F.col("element") == "trHeight").alias("n_rows"), total(of("trHeight", "val")).alias("heights"), F.count_if(of("trHeight", "hRule") == "exact").alias("exact"), total(of("gridSpan", "val")).alias("spans"), total(of("top", "sz")).alias("borders"),
        F.count_if(of("shd", "fill") == "112233").alias("fills"), total(of("left", "w")).alias("padding"), F.max(of("tblInd", "w")).cast("long").alias("indent"), F.max(of("tblW", "w")).cast("long").alias("width"), F.max(of("tblCellSpacing", "w")).cast("long").alias("gap"),
    )


@query("""
SELECT p_partkey // 10 AS doc_id, count(*) * 2 AS colspans, count(*) AS fills, count(*) FILTER (p_partkey % 2 = 1) AS exact, round(sum(p_size / 2.0), 1) AS borders, round(sum(p_size / 1.0), 1) AS padding FROM part GROUP BY 1
""")
def html_tables(spark, sf_dir):
    out = convert_to_html(sized_tables(spark, sf_dir), wrapper=False)
    every = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    total = lambda pattern: F.round(F.aggregate(every(pattern), F.lit(0.0), lambda a, x: a + x.cast("double")), 1)
    return out.select("doc_id", total('colspan="([0-9]+)"').cast("long").alias("colspans"), F.size(every("(background-color: #112233)")).cast("long").alias("fills"), F.size(every("(max-height)")).cast("long").alias("exact"), total("border-top: ([0-9.]+)pt double").alias("borders"), total("padding-left: ([0-9.]+)pt").alias("padding"))


@query("""
SELECT p_partkey // 10 AS doc_id, count(*) AS colspans, count(*) AS fills, count(*) AS strokes, 3 AS n_columns, CASE WHEN count(*) FILTER (p_partkey % 2 = 1) > 0 THEN 3 ELSE 2 END AS n_codes FROM part GROUP BY 1
""")
def typst_tables(spark, sf_dir):
    out = convert_to_typst(sized_tables(spark, sf_dir))
    many = lambda said: F.size(F.regexp_extract_all("typst", F.lit(f"({said})"), F.lit(1))).cast("long")
    return out.select("doc_id", many("colspan: 2").alias("colspans"), many(r"fill: rgb\(17, 34, 51\)").alias("fills"), many(r"table\.cell\([^\[]*stroke: \(top").alias("strokes"), F.size(F.split(F.regexp_extract("typst", r"columns: \(([^)]*)\)", 1), ", ")).alias("n_columns"), F.size(F.array_distinct("reasons")).alias("n_codes"))


# ---- the rest of the reader, one feature each


def spread(rows: DataFrame, each: int = 500) -> DataFrame:
    """Rows dealt out, about `each` to a task, where rows are short and the work on one is long: bytes of input, which splits go by, don't tell it."""
    return rows.repartition(max(1, -(-rows.count() // each)))


def of_parts(spark, sf_dir, body: F.Column, head: str = "", dealt: bool = False) -> DataFrame:
    """A document for each part; dealt: spread over tasks."""
    parts = read(spark, sf_dir, "part")
    return (spread(parts) if dealt else parts).select(F.col("p_partkey").alias("doc_id"), document(body, head).alias("rtf"))


def one_of(*forms: str) -> F.Column:
    """Of so many forms, the one that a part's key names."""
    return F.get(F.array(*map(F.lit, forms)), (F.col("p_partkey") % len(forms)).cast("int"))


@query("""
SELECT p_partkey AS doc_id, k AS ord, CASE WHEN k = 0 THEN ['left', 'center', 'right', 'justify'][p_partkey % 4 + 1] ELSE 'left' END AS alignment, k = 0 AS bold FROM part, (SELECT unnest([0, 1]) AS k)
""")
def alignments_and_resets(spark, sf_dir):
    """\\pard takes back the alignment, \\plain the weight."""
    docs = of_parts(spark, sf_dir, F.concat(one_of("\\ql", "\\qc", "\\qr", "\\qj"), F.lit("\\b a\\par\\pard\\plain b\\par ")))
    parsed = P.parse(docs, want=("nodes", "inlines"))
    lines = P.table(parsed, "nodes").select("doc_id", F.get("path", F.lit(0)).alias("ord"), "alignment")
    return lines.join(P.table(parsed, "inlines").select("doc_id", F.get("path", F.lit(0)).alias("ord"), "bold"), ["doc_id", "ord"])


@query(ORACLES["shading_nearest_pattern"].replace("SELECT p_partkey AS doc_id, CASE", "SELECT p_partkey AS doc_id, '#112233' AS fill, CASE"))
def paragraph_shading(spark, sf_dir):
    percent = (F.col("p_partkey") * 37 % 11000 - 400).cast("string")
    docs = of_parts(spark, sf_dir, F.concat(F.lit("\\cbpat1\\shading"), percent, F.lit(" x\\par ")), "{\\colortbl;\\red17\\green34\\blue51;}")
    return P.table(P.parse(docs, want=("nodes",)), "nodes").select("doc_id", "fill", "pattern")


@query("""
SELECT italic, underline, strikethrough, small_caps, all_caps, size, count(*) AS n FROM (SELECT p_partkey % 2 = 1 AS italic, p_partkey % 3 = 1 AS underline, p_partkey % 5 = 1 AS strikethrough, p_partkey % 7 = 1 AS small_caps, p_partkey % 11 = 1 AS all_caps, (p_size + 1) / 2.0 AS size FROM part) GROUP BY ALL
""")
def run_flags(spark, sf_dir):
    on = lambda m, word: F.when(F.col("p_partkey") % m == 1, f"\\{word}").otherwise(f"\\{word}\\{word}0")
    body = F.concat(on(2, "i"), on(3, "ul"), on(5, "strike"), on(7, "scaps"), on(11, "caps"), F.lit("\\fs"), (F.col("p_size") + 1).cast("string"), F.lit(" x"))
    runs = P.table(P.parse(of_parts(spark, sf_dir, body), want=("inlines",)), "inlines")
    return runs.groupBy("italic", "underline", "strikethrough", "small_caps", "all_caps", F.col("font_size").cast("double").alias("size")).agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey AS doc_id, ['#010203', '#040506', NULL][p_partkey % 3 + 1] AS background, CASE WHEN p_partkey % 3 = 0 THEN '#040506' END AS color FROM part
""")
def run_colors(spark, sf_dir):
    """A highlight goes before a background."""
    body = F.concat(one_of("\\highlight1\\cb2\\cf2", "\\cb2", "\\highlight0\\cb9\\cf0"), F.lit(" x"))
    docs = of_parts(spark, sf_dir, body, "{\\colortbl;\\red1\\green2\\blue3;\\red4\\green5\\blue6;}")
    return P.table(P.parse(docs, want=("inlines",)), "inlines").select("doc_id", "background", "color")


@query("""
SELECT p_partkey AS doc_id, ['é?x', '\u00e9x', '€\u201cz', '\u00a0\u2011{}\\', 'a\u20acb', ''][p_partkey % 6 + 1] AS text FROM part WHERE p_partkey % 6 < 5
""")
def characters(spark, sf_dir):
    """Escapes and how many letters stand in for them, bytes of Windows-1252, symbols, negative numbers; a document without any."""
    forms = ("\\u233??x", "\\uc2\\u233 ??x", "\\'80\\'93z", "\\~\\_\\{\\}\\\\", "{\\uc0 a\\u8364}\\uc1 b", "")
    return P.table(P.parse(of_parts(spark, sf_dir, one_of(*forms)), want=("nodes",)), "nodes").select("doc_id", "text")


@query("""
SELECT p_partkey AS doc_id, channel, CASE channel WHEN 'body' THEN 'text' ELSE channel || p_size END AS text FROM part, (SELECT unnest(['body', 'header_default', 'header_first', 'header_even', 'footer_default', 'footer_first', 'footer_even']) AS channel)
""")
def running_channels(spark, sf_dir):
    words = {"headerr": "header_default", "headerf": "header_first", "headerl": "header_even", "footer": "footer_default", "footerf": "footer_first", "footerl": "footer_even"}
    body = F.concat(*(x for w, c in words.items() for x in (F.lit(f"{{\\{w} {c}"), F.col("p_size").cast("string"), F.lit("}"))), F.lit("text"))
    return P.table(P.parse(of_parts(spark, sf_dir, body), want=("nodes",)), "nodes").select("doc_id", "channel", "text")


@query("""
SELECT p_partkey AS doc_id, t AS tables, c AS cells, r AS rows, x AS warned FROM part JOIN (SELECT * FROM (VALUES (0, 2, 2, 2, 0), (1, 1, 2, 1, 0), (2, 1, 1, 1, 4), (3, 1, 2, 2, 4), (4, 0, 0, 0, 4)) v(k, t, c, r, x)) ON p_partkey % 5 = k
""")
def table_shapes(spark, sf_dir):
    """A table within a cell; two cells; a row and a cell that aren't ended, at the document's end and at the next row; words of a table outside of one."""
    row = "\\trowd\\cellx900 "
    forms = ("\\trowd\\cellx900\\cellx1800 \\intbl a\\cell\\itap2 b\\nestcell{\\*\\nesttableprops\\trowd\\cellx400\\nestrow}\\itap1\\cell\\row ", "\\trowd\\cellx900\\cellx1800 \\intbl a\\cell b\\cell\\row ", row + "\\intbl a", row + "\\intbl a" + row + "\\intbl b\\cell\\row ", "x\\cell y\\row ")
    nested = row + "\\intbl a\\itap2" + row + "b\\nestcell\\nestrow\\itap1 c\\cell\\row "
    parsed = P.parse(of_parts(spark, sf_dir, one_of(nested, *forms[1:])), want=("nodes", "warnings"))
    many = lambda kind: F.size(F.filter("nodes", lambda n: n["node_type"] == kind))
    return parsed.select("doc_id", many("table").alias("tables"), many("cell").alias("cells"), many("row").alias("rows"), F.size("warnings").alias("warned"))


@query("""
SELECT p_partkey AS doc_id, ['invalid_structure', 'invalid_structure', 'invalid_structure', 'invalid_structure', 'image_bytes_exceeded', 'input_too_large', NULL][p_partkey % 7 + 1] AS error_type FROM part WHERE p_partkey % 7 < 6
""")
def every_limit(spark, sf_dir):
    """Rows of a table, cells of a row, nested tables, columns of a merge, bytes of images and of the input; at last a document within all of them."""
    row = "\\trowd\\cellx900 \\intbl a\\cell\\row "
    nested = "\\trowd\\cellx900 \\intbl " + "".join(f"\\itap{n}\\trowd\\cellx900 x" for n in (2, 3, 4))
    forms = (row * 4, "\\trowd" + "".join(f"\\cellx{n}00" for n in range(1, 7)) + " " + "a\\cell " * 6 + "\\row ", nested, "\\trowd\\clmgf\\cellx100" + "".join(f"\\clmrg\\cellx{n}00" for n in range(2, 5)) + " " + "a\\cell " * 4 + "\\row ", "{\\pict\\pngblip " + "00" * 50 + "}", "x" * 500, row)
    limits = Limits(max_rows_per_table=3, max_cells_per_row=5, max_table_nesting_depth=2, max_merge_span=3, max_image_bytes_total=40, max_input_bytes=400)
    return P.failures(P.parse(of_parts(spark, sf_dir, one_of(*forms)), limits, want=("error",))).select("doc_id", "error_type")


@query("""
SELECT type, count(*) AS n FROM (SELECT unnest([['unsupported_list_control', 'dropped_content'], ['unsupported_nesting_level', 'unresolved_list_override', 'dropped_content'], ['section_numbering_fallback'], ['unresolved_cross_reference'], ['unsupported_field'], ['unsupported_toc_switch'],
  ['unsupported_table_control'], ['merge_conflict', 'dropped_content'], ['unknown_destination', 'dropped_content'], ['unsupported_control_word'], ['dropped_content'], ['malformed_table_structure']][p_partkey % 12 + 1]) AS type FROM part) GROUP BY type
""")
def warning_catalogue(spark, sf_dir):
    """A document for each kind of warning."""
    forms = (
        "\\pnlvl1 x", "\\ls9\\ilvl11 x\\par ", "\\sect\\pgnstarts0 x", "{\\field{\\*\\fldinst REF gone}{\\fldrslt x}}", "{\\field{\\*\\fldinst MERGEFIELD n}{\\fldrslt x}}", "{\\field{\\*\\fldinst TOC \\\\o \"1-2\" \\\\z}{\\fldrslt x}}",
        "\\trowd\\trftswidth9\\cellx900 \\intbl a\\cell\\row ", "\\trowd\\clmrg\\cellx900 \\intbl a\\cell\\row ", "{\\*\\nosuch x}y", "\\nosuch x", "{\\pict 00}x", "\\trowd\\cellx900\\cellx900 \\intbl a\\cell b\\cell\\row ",
    )
    return P.table(P.parse(of_parts(spark, sf_dir, one_of(*forms)), want=("warnings",)), "warnings").groupBy("type").agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey AS doc_id, ['auto', 'auto', 'percent', 'twips'][p_partkey % 4 + 1] AS kind, CAST([NULL, NULL, p_size * 50, p_size * 50][p_partkey % 4 + 1] AS BIGINT) AS value, CAST(p_size AS BIGINT) AS top, CAST(CASE WHEN p_partkey % 2 = 0 THEN 7 ELSE p_size END AS BIGINT) AS left_pad, CAST(60 AS BIGINT) AS gap, 'right' AS alignment, 'at_least' AS height_rule FROM part
""")
def table_properties(spark, sf_dir):
    """Widths, padding of a cell over that of its row, gap, place and height, from the model."""
    s = F.col("p_size").cast("string")
    own = F.when(F.col("p_partkey") % 2 == 0, "\\clpadl7\\clpadfl3").otherwise("")
    body = F.concat(F.lit("\\trowd\\trqr\\trgaph30\\trrh200\\trpaddt"), s, F.lit("\\trpaddl"), s, F.lit("\\clftswidth"), (F.col("p_partkey") % 4).cast("string"), F.lit("\\clwwidth"), (F.col("p_size") * 50).cast("string"), own, F.lit("\\cellx900 \\intbl a\\cell\\row "))
    cell = "preferred_width struct<type string, value bigint>, padding struct<top bigint, left bigint>"
    row = "alignment string, cell_gap_twips bigint, height_rule string"
    model = F.from_json("ir", f"blocks array<struct<rows array<struct<cells array<struct<{cell.replace(' struct', ': struct').replace('type string', 'type: string').replace('value bigint', 'value: bigint').replace('top bigint', 'top: bigint').replace('left bigint', 'left: bigint')}>>, row_props: struct<{row.replace('t s', 't: s').replace('s b', 's: b').replace('e s', 'e: s')}>>>>>")
    first = P.parse(of_parts(spark, sf_dir, body), want=("ir",)).select("doc_id", model["blocks"][0]["rows"][0].alias("r")).select("doc_id", F.col("r.cells")[0].alias("c"), "r.row_props")
    return first.select("doc_id", F.col("c.preferred_width.type").alias("kind"), F.col("c.preferred_width.value").alias("value"), F.col("c.padding.top").alias("top"), F.col("c.padding.left").alias("left_pad"), F.col("row_props.cell_gap_twips").alias("gap"), F.col("row_props.alignment").alias("alignment"), F.col("row_props.height_rule").alias("height_rule"))


@query("""
SELECT p_partkey AS doc_id, v AS v_align, v IS NOT NULL AS aligned FROM (SELECT p_partkey, ['top', 'center', 'bottom', NULL][p_partkey % 4 + 1] AS v FROM part)
""")
def cell_alignment(spark, sf_dir):
    body = F.concat(F.lit("\\trowd"), one_of("\\clvertalt", "\\clvertalc", "\\clvertalb", ""), F.lit("\\cellx900 \\intbl a\\cell\\row "))
    cells = P.table(P.parse(of_parts(spark, sf_dir, body), want=("nodes",)), "nodes").where("node_type = 'cell'")
    return cells.select("doc_id", "v_align", F.col("v_align").isNotNull().alias("aligned"))


@query("""
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 2 THEN 0 ELSE 1 END AS images, CASE WHEN p_partkey % 3 = 1 THEN 2 WHEN p_partkey % 3 = 0 THEN 1 ELSE 1 END AS warned, p_partkey % 3 < 2 AS has_format FROM part
""")
def picture_choices(spark, sf_dir):
    """The better picture of two, a broken one beside it, and one of no known kind."""
    forms = ("{{\\*\\shppict{\\pict\\pngblip 0a}}{\\nonshppict{\\pict\\jpegblip 0b}}}", "{\\pict\\jpegblip 0b}{\\pict\\pngblip 0}{\\pict\\pngblip 0g}", "{\\pict\\wmetafile8 0b}")
    parsed = P.parse(of_parts(spark, sf_dir, one_of(*forms)), want=("nodes", "warnings"))
    images = F.filter("nodes", lambda n: n["node_type"] == "image")
    drops = F.filter("warnings", lambda w: w["type"] == "dropped_content")
    return parsed.select("doc_id", F.size(images).alias("images"), F.size(drops).alias("warned"), F.exists(images, lambda n: n["image_format"].isNotNull()).alias("has_format"))


@query("""
SELECT p_partkey AS doc_id, 2 + p_size + 4 * (p_size % 3) + 3 * (p_size % 2) AS n_bytes_over, 1 AS n_runs FROM part
""")
def input_bytes(spark, sf_dir):
    """Bytes of the input beyond those of the frame, counted as UTF-8."""
    body = F.concat(F.lit("é"), F.expr("repeat('x', p_size)"), F.expr("repeat('💙', p_size % 3)"), F.expr("repeat('€', p_size % 2)"))
    parsed = P.parse(of_parts(spark, sf_dir, body), want=("bytes_processed", "run_count"))
    return parsed.select("doc_id", (F.col("bytes_processed") - len("{\\rtf1\\ansi }")).cast("int").alias("n_bytes_over"), F.col("run_count").cast("int").alias("n_runs"))


@query("""
SELECT p_partkey AS doc_id, k AS section, CASE WHEN k = 0 THEN 'arabic' ELSE ['roman_lower', 'roman_upper', 'arabic'][p_partkey % 3 + 1] END AS number_format, k = 1 AS restart, CASE WHEN k = 1 THEN p_size END AS start_page FROM part, (SELECT unnest([0, 1, 2]) AS k)
""")
def page_management(spark, sf_dir):
    """Sections inherit a format, but neither a restart nor a first page."""
    body = F.concat(F.lit("a\\sect"), one_of("\\pgnlcrm", "\\pgnucrm", "\\pgndec"), F.lit("\\pgnrestart\\pgnstarts"), F.col("p_size").cast("string"), F.lit(" b\\sect c"))
    s = P.table(P.parse(of_parts(spark, sf_dir, body), want=("sections",)), "sections")
    return s.select("doc_id", F.col("index").alias("section"), "number_format", "restart", "start_page")


@query("""
SELECT p_partkey AS doc_id, f AS kind, t AS target, x AS text FROM part JOIN (SELECT * FROM (VALUES (0, 'current_page', NULL, '1'), (1, 'total_pages', NULL, '1'), (2, 'page_ref', 'mark', '12'), (3, 'page_ref', 'mark', 'mark'), (4, 'ref', 'mark', 'seen'), (5, 'sequence', 'Figure', 'Figure'), (6, 'doc_property', 'Company', 'ACME'), (7, 'note_ref', 'mark', 'seen')) v(k, f, t, x)) ON p_partkey % 8 = k
""")
def field_texts(spark, sf_dir):
    """Targets of fields, and what is shown of them: their result, else what they name."""
    field = lambda said, result: "{\\field{\\*\\fldinst " + said + "}{\\fldrslt " + result + "}}"
    forms = (field("PAGE", "7"), field("NUMPAGES \\\\* ROMAN", "7"), field("PAGEREF mark \\\\h", "12"), field("PAGEREF mark", ""), field("REF mark \\\\h", "seen"), field("SEQ Figure \\\\* ARABIC", ""), field("DOCPROPERTY Company", "ACME"), field("NOTEREF mark", "seen"))
    body = F.concat(F.lit("{\\*\\bkmkstart mark}x{\\*\\bkmkend mark}"), one_of(*forms))
    return P.table(P.parse(of_parts(spark, sf_dir, body), want=("inlines",)), "inlines").where("kind IS NOT NULL").select("doc_id", "kind", "target", "text")


@query("""
SELECT p_partkey AS doc_id, p_partkey % 3 < 2 AS generated, p_partkey % 3 = 0 AS explicit, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS insertion_index FROM part
""")
def contents_places(spark, sf_dir):
    """A table of contents where a field asks for it, before everything where three headings do, or none."""
    heads = "{\\b\\fs28 1 A}\\par {\\b\\fs28 2 B}\\par {\\b\\fs28 3 C}\\par "
    forms = ("x\\par {\\field{\\*\\fldinst TOC \\\\o \"1-2\" \\\\h}{\\fldrslt }}\\par " + heads, heads, "{\\b\\fs28 1 A}\\par {\\b\\fs28 2 B}\\par x")
    parsed = P.parse(of_parts(spark, sf_dir, one_of(*forms)), want=("generated",))
    first = F.get("generated", F.lit(0))
    return parsed.select("doc_id", (F.size("generated") > 0).alias("generated"), F.coalesce(first["explicit"], F.lit(False)).alias("explicit"), first["insertion_index"].alias("insertion_index"))


@query("""
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'footnote' ELSE 'endnote' END AS kind, 'note' || p_size AS body, 1 AS n_sections, 1 AS n_refs FROM part
""")
def html_notes(spark, sf_dir):
    """A note's reference and body in the page."""
    body = F.concat(F.lit("a{"), one_of("\\footnote note", "\\endnote note"), F.col("p_size").cast("string"), F.lit("}"))
    out = convert_to_html(of_parts(spark, sf_dir, body), wrapper=False)
    found = lambda pattern: F.regexp_extract("html", pattern, 1)
    many = lambda said: F.size(F.regexp_extract_all("html", F.lit(f"({said})"), F.lit(1)))
    return out.select("doc_id", found('id="note-1" class="rtf-note rtf-(\\w+)"').alias("kind"), found('(?s)class="rtf-note .*?<p class="rtf-p">([^<]*)</p>').alias("body"), many('<section class="rtf-notes">').alias("n_sections"), many('<a href="#note-1"').alias("n_refs"))


@query("""
SELECT p_partkey AS doc_id, ['http', 'mailto', 'bookmark', 'none'][p_partkey % 4 + 1] AS kind, ['', 'rtf-align-center', 'rtf-align-right', 'rtf-align-justify'][p_partkey % 4 + 1] AS align FROM part
""")
def html_links(spark, sf_dir):
    """Links of known schemes and to bookmarks are links, others plain; paragraphs have a class for their alignment."""
    link = lambda said: "{\\field{\\*\\fldinst HYPERLINK " + said + "}{\\fldrslt x}}"
    forms = ("\\ql " + link('"http://a.b/c"'), "\\qc " + link('"mailto:a@b"'), "\\qr " + link("\\\\l mark"), "\\qj " + link('"ftp://a"'))
    out = convert_to_html(of_parts(spark, sf_dir, F.concat(one_of(*forms), F.lit("\\par "))), wrapper=False)
    href = F.regexp_extract("html", 'href="([^":]*)', 1)
    return out.select("doc_id", F.when(href == "", "none").when(F.startswith(href, F.lit("#")), "bookmark").otherwise(href).alias("kind"), F.regexp_extract("html", '<p class="rtf-p ?([^"]*)"', 1).alias("align"))


@query("""
SELECT p_partkey AS doc_id, 'data:image/png;base64,' || base64(unhex(repeat('0a', CAST(p_size AS INTEGER)))) AS source, CAST(p_size * 20 // 15 AS BIGINT) AS wide FROM part
""")
def html_images(spark, sf_dir):
    body = F.concat(F.lit("{\\pict\\pngblip\\picwgoal"), (F.col("p_size") * 20).cast("string"), F.lit(" "), F.expr("repeat('0a', p_size)"), F.lit("}"))
    out = convert_to_html(of_parts(spark, sf_dir, body), wrapper=False)
    return out.select("doc_id", F.regexp_extract("html", 'src="([^"]*)"', 1).alias("source"), F.regexp_extract("html", 'width="([0-9]+)"', 1).cast("long").alias("wide"))


@query("""
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 17 END AS r, regexp_replace(p_name, '[^a-zA-Z0-9_-]', '-', 'g') AS label, p_size / 20.0 AS points, p_size * 635 AS emu FROM part
""")
def scalar_columns(spark, sf_dir):
    """Colors from digits, labels, and twips in other units, on columns."""
    k = F.col("p_partkey")
    said = F.when(k % 4 == 0, "#112233").when(k % 4 == 2, "112233").when(k % 4 == 1, "#11223").otherwise("red")
    return read(spark, sf_dir, "part").select(k.alias("doc_id"), C.from_hex(said)["r"].alias("r"), C.typst_label("p_name").alias("label"), C.twips_to_points("p_size").cast("double").alias("points"), C.twips_to_emu("p_size").cast("long").alias("emu"))


@query("""
SELECT kind, code, count(*) AS n FROM (SELECT unnest([['partial_support_endnote_ref'], ['Dropped malformed JPEG image payload'], ['unresolved_page_reference_gone'], ['list_level_skip_0_to_2'], ['partial_support_header_first_even'], ['partial_support_mergefield']][p_partkey % 6 + 1]) AS code FROM part),
  (SELECT 1), LATERAL (SELECT CASE WHEN code LIKE 'Dropped%' THEN 'dropped_content' ELSE 'partial_support' END AS kind) GROUP BY ALL
""")
def writer_warnings(spark, sf_dir):
    """What a writer can't say as it is, by code."""
    head = "{\\*\\listtable{\\list{\\listlevel\\levelnfc0}{\\listlevel\\levelnfc0}{\\listlevel\\levelnfc0}\\listid7}}{\\*\\listoverridetable{\\listoverride\\listid7\\ls1}}"
    forms = ("a{\\endnote n}", "{\\pict\\jpegblip 00}", "{\\field{\\*\\fldinst PAGEREF gone}{\\fldrslt 7}}", "\\ls1 a\\par\\ls1\\ilvl2 b\\par ", "{\\headerf h}x", "{\\field{\\*\\fldinst MERGEFIELD n}{\\fldrslt 1}}")
    return mapping_warnings(convert_to_typst(of_parts(spark, sf_dir, one_of(*forms), head))).groupBy("kind", "code").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, seq, type FROM (SELECT p_partkey AS doc_id, 0 AS seq, 'unsupported_control_word' AS type FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, CAST(1 - p_partkey % 2 AS INTEGER), 'partial_support' FROM part)
""")
def report_with_writer_warnings(spark, sf_dir):
    """The writer's warnings stand after the reader's."""
    docs = of_parts(spark, sf_dir, F.concat(one_of("\\nosuch ", ""), F.lit("a{\\endnote n}")))
    parsed = P.parse(docs, want=("warnings",))
    return all_warnings(parsed, convert_to_pdf(docs)).select("doc_id", "seq", "type")


@query("""
SELECT p_partkey AS doc_id, part, text FROM part, (SELECT unnest(['document', 'footnotes', 'header_first', 'footer_default']) AS part), LATERAL (SELECT CASE part WHEN 'document' THEN 'body' WHEN 'footnotes' THEN 'note' || p_size ELSE part || p_size END AS text)
""")
def docx_parts(spark, sf_dir):
    """Running heads and notes have parts of their own in the package."""
    s = F.col("p_size").cast("string")
    body = F.concat(F.lit("{\\headerf header_first"), s, F.lit("}{\\footer footer_default"), s, F.lit("}body{\\footnote note"), s, F.lit("}"))
    return docx_paragraphs(convert_to_docx(of_parts(spark, sf_dir, body))).where("text <> ''").select("doc_id", "part", "text")


@query("""
SELECT p_partkey AS doc_id, page, CASE WHEN page = 0 THEN 'first' WHEN page % 2 = 1 THEN 'even' ELSE 'odd' END AS head, '3' AS total FROM part, (SELECT unnest([0, 1, 2]) AS page)
""")
def pdf_running_heads(spark, sf_dir):
    """Headers of first, even and other pages, and the number of pages, which is known at the end."""
    lines = "x\\par " * 60
    body = F.concat(F.lit("{\\headerf first}{\\headerl even}{\\headerr odd}{\\footer {\\field{\\*\\fldinst NUMPAGES}{\\fldrslt 1}}}" + lines), F.col("p_size").cast("string"))
    pages = pdf_pages(convert_to_pdf(of_parts(spark, sf_dir, body, dealt=True)))
    return pages.select("doc_id", "page", F.element_at("pieces", -2).alias("head"), F.element_at("pieces", -1).alias("total"))


from scrivel.plans import scalars, structure  # noqa: E402, F401  # they register their queries
