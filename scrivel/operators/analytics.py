"""Operators over tables of tokens, nodes and properties: joins, windows and aggregates that Catalyst sees.

Every operator takes DataFrames with the named columns, and partitions by document: by row_key where all of its tables have one, so
that rows that repeat an id, or have none, are documents of their own; else by doc_id. Results keep both.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivel.functions import columns as C
from scrivel.operators.keys import by

# ---- text

SPACE = r"(?U)\s+"
ODD = re.compile("[\x1c-\x1f]")
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def text_stats(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lines, words, chars, bytes, unique_words and most_common_word (of equals, the first in order) of each row's text, counted where it stands: no shuffle. A null text is empty."""
    kind = texts.schema[id_col].dataType.simpleString()
    rows = texts.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    breaks = F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit("")))
    lines = F.when(F.col("t") == "", 0).otherwise(breaks + F.when(F.endswith("t", F.lit("\n")), 0).otherwise(1))
    sized = rows.select("doc_id", lines.cast("long").alias("lines"), F.length("t").cast("long").alias("chars"), F.octet_length("t").cast("long").alias("bytes"), F.lower("t").alias("t"))

    def each(batches):
        for batch in batches:
            counts = [Counter(split_words(t)) for t in batch.column("t").to_pylist()]
            words = pa.array([sum(c.values()) for c in counts], pa.int64())
            unique = pa.array(map(len, counts), pa.int64())
            most = [min(w for w, n in c.items() if n == top) if c and (top := max(c.values())) else None for c in counts]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "lines")), words, *(batch.column(c) for c in ("chars", "bytes")), unique, pa.array(most, pa.string())], ["doc_id", "lines", "words", "chars", "bytes", "unique_words", "most_common_word"])

    return sized.mapInArrow(each, f"doc_id {kind}, lines long, words long, chars long, bytes long, unique_words long, most_common_word string")


def split_words(text: str) -> list[str]:
    """As SPACE splits; Python's own split takes four control characters for white space, too."""
    return text.split() if not ODD.search(text) else [w for w in WHITE.split(text) if w]


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    words = texts.select(F.explode(F.filter(F.split(F.lower(text_col), SPACE), lambda w: w != "")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


# ---- fonts, colors, lists: lookups as joins


def resolve_fonts(uses: DataFrame, fonts: DataFrame, defaults: DataFrame) -> DataFrame:
    """uses (doc_id, font_idx, ...) with family: of the font itself, else of the document's default font. fonts: (doc_id, font_idx, pos, family), the last definition wins."""
    doc = by(uses, fonts, defaults)
    last = fonts.groupBy(*doc, "font_idx").agg(F.max_by("family", "pos").alias("family"))
    own = uses.join(last, [*doc, "font_idx"], "left")
    fallback = defaults.select(*doc, "font_idx").join(last, [*doc, "font_idx"]).select(*doc, F.col("family").alias("default_family"))
    return own.join(fallback, doc, "left").withColumn("family", F.coalesce("family", "default_family")).drop("default_family")


def color_table(parts: DataFrame) -> DataFrame:
    """(doc_id, color_idx, r, g, b) of a color table's tokens (doc_id, pos, word, param, semicolon): each semicolon ends an entry; an entry's components are those since the one before. Entry 0 and entries without components are automatic."""
    before = Window.partitionBy(*by(parts)).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    numbered = parts.withColumn("color_idx", F.coalesce(F.sum(F.col("semicolon").cast("int")).over(before), F.lit(0)))
    one = lambda w: F.max_by(F.when(F.col("word") == w, F.least(F.greatest(F.col("param"), F.lit(0)), F.lit(255))), F.when(F.col("word") == w, F.col("pos")))
    doc = list(dict.fromkeys(["doc_id", *by(parts)]))
    entries = numbered.groupBy(*doc, "color_idx").agg(one("red").alias("r"), one("green").alias("g"), one("blue").alias("b"), F.bool_or("semicolon").alias("whole"))
    return entries.where(F.col("whole") & (F.col("color_idx") > 0) & F.coalesce("r", "g", "b").isNotNull()).select(*doc, "color_idx", *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"))


def resolve_lists(paragraphs: DataFrame, overrides: DataFrame, lists: DataFrame) -> DataFrame:
    """paragraphs (doc_id, ord, ls, level) with list_id and kind; unresolved where the override is missing. A level that the list doesn't define is a bullet."""
    doc = by(paragraphs, overrides, lists)
    held = paragraphs.join(overrides.select(*doc, "ls", "list_id"), [*doc, "ls"], "left")
    kinds = held.join(lists.select(*doc, "list_id", "level", "kind"), [*doc, "list_id", "level"], "left")
    return kinds.withColumn("unresolved", F.col("ls").isNotNull() & F.col("list_id").isNull()).withColumn("kind", F.when(F.col("list_id").isNotNull(), F.coalesce("kind", F.lit("bullet"))))


def islands(rows: DataFrame, by: list[str], order: str, same: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a row begins a new one unless `same` holds. Gaps and islands by a running sum."""
    w = Window.partitionBy(*by).orderBy(order)
    begins = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("__begins", begins).withColumn(name, F.sum("__begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__begins")


def list_blocks(items: DataFrame) -> DataFrame:
    """items (doc_id, ord, list_id, kind; both null for a plain paragraph): neighbours of one id and kind share a block."""
    w = Window.partitionBy(*by(items)).orderBy("ord")
    return islands(items, by(items), "ord", (F.col("list_id") == F.lag("list_id").over(w)) & (F.col("kind") == F.lag("kind").over(w)), "block")


def clamped_levels(items: DataFrame) -> DataFrame:
    """Levels that rise by more than one are cut to one more than the level before, as it was cut itself. The level at a row is the smallest of level[j] + (i - j) over earlier rows j, and a level below all of that stands for itself."""
    w = Window.partitionBy(*by(items), "block").orderBy("ord")
    i = F.row_number().over(w)
    reach = F.min(F.col("level") - F.col("i")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("i")
    return items.withColumn("i", i).withColumn("shown", reach).drop("i")


# ---- tables


def cell_widths(boundaries: DataFrame) -> DataFrame:
    """boundaries (doc_id, row, col, right): width is the distance to the boundary before; null where that isn't positive."""
    w = Window.partitionBy(*by(boundaries), "row").orderBy("col")
    width = F.col("right") - F.lag("right", 1, 0).over(w)
    return boundaries.withColumn("width", F.when(width > 0, width))


def horizontal_spans(cells: DataFrame) -> DataFrame:
    """cells (doc_id, row, col, merge: start, continue or null) with span: the length of the chain for a start with continuations, and orphan: a continuation without a start."""
    doc = by(cells)
    w = Window.partitionBy(*doc, "row").orderBy("col")
    chained = (F.col("merge") == "continue") & F.lag("merge").over(w).isNotNull()
    runs = islands(cells, [*doc, "row"], "col", chained, "chain")
    chain = Window.partitionBy(*doc, "row", "chain")
    led = F.first("merge").over(chain.orderBy("col"))
    size = F.count("*").over(chain)
    return runs.withColumn("led", led).withColumn("size", size).select(*cells.columns, F.when((F.col("merge") == "start") & (F.col("size") > 1), F.col("size")).alias("span"), ((F.col("merge") == "continue") & (F.col("led") == "continue")).alias("orphan"))


def vertical_spans(cells: DataFrame) -> DataFrame:
    """cells (doc_id, row, col, merge: vstart, vcontinue or null) with rowspan: rows of the chain for a start, null for others. Cells of one column follow one another only if their rows do."""
    doc = by(cells)
    w = Window.partitionBy(*doc, "col").orderBy("row")
    chained = (F.col("merge") == "vcontinue") & (F.lag("row").over(w) == F.col("row") - 1)
    runs = islands(cells, [*doc, "col"], "row", chained, "chain")
    chain = Window.partitionBy(*doc, "col", "chain")
    return runs.withColumn("size", F.count("*").over(chain)).select(*cells.columns, F.when(F.col("merge") == "vstart", F.col("size")).alias("rowspan"))


def effective_borders(cells: DataFrame) -> DataFrame:
    """cells (doc_id, row, col, top, left, bottom, right: the cell's own borders; row_top, row_left, row_bottom, row_right, row_h, row_v: its row's), each a width or null, with the widths that the cell draws.

    An edge between two cells is drawn once: own borders come before the row's inner ones, and of two the upper or left cell's.
    """
    doc = by(cells)
    across, down = Window.partitionBy(*doc, "row").orderBy("col"), Window.partitionBy(*doc, "col").orderBy("row")
    out = cells
    for side, other, w, move, inner in (("top", "bottom", down, F.lag, "row_h"), ("left", "right", across, F.lag, "row_v"), ("bottom", "top", down, F.lead, "row_h"), ("right", "left", across, F.lead, "row_v")):
        order, first = ("row" if w is down else "col"), move is F.lead
        there = move(order).over(w).eqNullSafe(F.col(order) + (1 if first else -1))
        mine, theirs = F.col(side), move(other).over(w)
        row_mine, row_theirs = F.col(inner), move(inner).over(w)
        own_edge = mine if first else F.when(theirs.isNull(), mine)
        row_edge = row_mine if first else F.when(row_theirs.isNull(), row_mine)
        edge = F.when(mine.isNotNull() | theirs.isNotNull(), own_edge).otherwise(row_edge)
        out = out.withColumn(f"draw_{side}", F.when(there, edge).otherwise(F.coalesce(mine, F.col(f"row_{side}"))))
    return out


def count_mismatches(cells: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(doc_id, row, n_cells, n_boundaries) of rows whose cells aren't as many as their boundaries; a row without boundaries is no mismatch."""
    doc = by(cells, boundaries)
    a = cells.groupBy(*doc, "row").agg(F.count("*").alias("n_cells"))
    b = boundaries.groupBy(*dict.fromkeys(["doc_id", *doc]), "row").agg(F.count("*").alias("n_boundaries"))
    return b.join(a, [*doc, "row"], "left").na.fill(0, ["n_cells"]).where("n_cells <> n_boundaries")


def shading(cells: DataFrame) -> DataFrame:
    """cells (cell_fill, row_fill, table_fill, percent, ...) with fill: the nearest that is set, and its pattern."""
    return cells.withColumn("fill", F.coalesce("cell_fill", "row_fill", "table_fill")).withColumn("pattern", C.nearest_pattern("percent"))


# ---- references, sections, notes, warnings


def unresolved(references: DataFrame, anchors: DataFrame) -> DataFrame:
    """References (doc_id, target, ...) to names that no anchor (doc_id, name) of the document has; each target once."""
    doc = by(references, anchors)
    return references.join(anchors.select(*doc, F.col("name").alias("target")), [*doc, "target"], "left_anti").dropDuplicates([*doc, "target"])


def resolved(references: DataFrame, anchors: DataFrame) -> DataFrame:
    doc = by(references, anchors)
    return references.join(anchors.select(*doc, F.col("name").alias("target")), [*doc, "target"], "left_semi")


def sections(breaks: DataFrame) -> DataFrame:
    """breaks (doc_id, pos, is_break, format) with section (from 0) and number_format, which sections inherit."""
    w = Window.partitionBy(*by(breaks)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return breaks.withColumn("section", F.sum(F.col("is_break").cast("int")).over(w)).withColumn("number_format", F.coalesce(F.last("format", ignorenulls=True).over(w), F.lit("arabic")))


def note_numbers(notes: DataFrame) -> DataFrame:
    return notes.withColumn("note_id", F.row_number().over(Window.partitionBy(*by(notes)).orderBy("pos")))


def capped_warnings(warnings: DataFrame, most: int) -> DataFrame:
    """The first `most` warnings (doc_id, seq, type, ...); if no dropped_content is among them, the first later one takes the place of the last."""
    w = Window.partitionBy(*by(warnings)).orderBy("seq")
    numbered = warnings.withColumn("n", F.row_number().over(w)).withColumn("drop_n", F.min(F.when(F.col("type") == "dropped_content", F.col("n"))).over(Window.partitionBy(*by(warnings))))
    late = (F.col("drop_n") > most) & (F.col("n") == F.col("drop_n"))
    kept = (F.col("n") < most) | ((F.col("n") == most) & ~F.coalesce(F.col("drop_n") > most, F.lit(False)))
    return numbered.where(kept | late).drop("n", "drop_n")


def strict_failures(warnings: DataFrame) -> DataFrame:
    return warnings.where("type = 'dropped_content'").select(*dict.fromkeys(["doc_id", *by(warnings)])).distinct()


def within_budget(images: DataFrame, limit: int) -> DataFrame:
    """(doc_id, total, failed_at) of each document with images (doc_id, pos, size): their bytes, and the position of the image that takes them beyond the limit, null within it."""
    w = Window.partitionBy(*by(images)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = images.withColumn("total", F.sum("size").over(w))
    return running.groupBy(*dict.fromkeys(["doc_id", *by(images)])).agg(F.max("total").alias("total"), F.min(F.when(F.col("total") > limit, F.col("pos"))).alias("failed_at"))


def within_budget_of_parts(parts: DataFrame, limit: int) -> DataFrame:
    """The same of documents that stand in parts (doc_id, part, sizes): the bytes of each part's images, in order. Positions are counted through the parts of a document; only sums of parts are run through, images are counted where their part stands."""
    w = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0).cast("long"))
    own = parts.where(F.size("sizes") > 0).withColumn("own", F.aggregate("sizes", F.lit(0).cast("long"), lambda total, x: total + x))
    placed = own.withColumns({"before": so_far(F.col("own")), "first": so_far(F.size("sizes").cast("long"))})
    # sizes aren't negative, so those within the limit come first
    start = F.struct(F.col("before").alias("total"), F.lit(0).cast("long").alias("n"))
    add = lambda held, x: F.struct((held["total"] + x).alias("total"), (held["n"] + F.when(held["total"] + x <= limit, 1).otherwise(0)).cast("long").alias("n"))
    total = F.col("before") + F.col("own")
    return placed.groupBy("doc_id").agg(F.max(total).alias("total"), F.min(F.when(total > limit, F.col("first") + F.aggregate("sizes", start, add)["n"])).alias("failed_at"))


def fail_closed(table: DataFrame, failures: DataFrame) -> DataFrame:
    """A table without the rows of documents that failed."""
    doc = by(table, failures)
    return table.join(failures.select(*doc), doc, "left_anti")


def with_generated(blocks: DataFrame, generated: DataFrame) -> DataFrame:
    """(doc_id, ord, what): generated blocks stand before the block at their index; an index may be one beyond the last block."""
    doc = by(blocks, generated)
    names = list(dict.fromkeys(["doc_id", *doc]))
    a = blocks.select(*names, F.col("ord").alias("at"), F.lit(1).alias("after"), F.col("what"))
    b = generated.select(*names, F.col("insertion_index").alias("at"), F.lit(0).alias("after"), F.col("kind").alias("what"))
    w = Window.partitionBy(*doc).orderBy("at", "after")
    return a.unionByName(b).withColumn("ord", F.row_number().over(w) - 1).select(*names, "ord", "what")


def numbering_ids(lists: DataFrame) -> DataFrame:
    """lists (doc_id, pos, list_id, kind, level): per list, its numbering (from 2, in the order of appearance) and its definition, which lists of one kind and one set of levels share."""
    doc = by(lists)
    names = list(dict.fromkeys(["doc_id", *doc]))
    per = lists.groupBy(*names, "list_id").agg(F.min("pos").alias("pos"), F.min_by("kind", "pos").alias("kind"), F.array_sort(F.collect_set("level")).alias("levels"))
    first = Window.partitionBy(*doc, "kind", "levels")
    order = Window.partitionBy(*doc).orderBy("pos")
    defined = per.withColumn("def_pos", F.min("pos").over(first))
    return defined.select(*names, "list_id", "kind", "levels", (F.row_number().over(order) + 1).alias("num_id"), F.dense_rank().over(Window.partitionBy(*doc).orderBy("def_pos")).alias("abstract_id"))
