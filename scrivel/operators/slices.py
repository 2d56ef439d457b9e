"""Groups and checks of documents cut into slices, so that one huge document is spread over tasks.

A slice ends before a brace or a backslash that begins a token, so it is read for itself. Of each slice a summary is kept: how its depth
ends and how low and high it gets, its tokens and bytes, its first two solid tokens, whether anything in it is no token, and the groups it
leaves open. Summaries combine associatively, so running sums over a document's slices (one short row for each) tell the state at which
each slice begins, and the groups that are open there are the latest ones that earlier slices left open at each depth. Then the
slices are read a second time, each from its own beginning.

Defined cases: rows that repeat an id are documents of their own; a null or empty text is a document without tokens, and so
"empty_input"; a text without braces and backslashes is one slice; a null id stays null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scrivel.limits import Limits
from scrivel.operators.keys import KEY, Keys, given
from scrivel.operators.tokens import ROWS
from scrivel.parser import shown
from scrivel.parser.lexer import BLANK, TOKEN

#: Characters of a slice, until the next place where it may end.
SIZE = 1 << 16
SUMMARY = "net long, least long, most long, opens long, tokens long, bytes long, stray boolean, solid array<string>, left array<struct<depth:bigint,pos:bigint,hidden:boolean>>"


def sliced(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, row_key, slice, rtf) of (doc_id, rtf): pieces of about `size` characters, each a row, dealt out evenly."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches):
        keys = Keys()
        for batch in batches:
            own = map(keys, batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.record_batch([*batch.columns[:2], pa.array(own, pa.binary())], ["doc_id", "rtf", KEY])

    keyed = docs.select("doc_id", "rtf", given(docs)).mapInArrow(each, f"doc_id {kind}, rtf string, {KEY} binary")
    # never after an opening, a star or a control character: the first words of a group stay with it
    pattern = rf"(?s)(.{{{size}}}.*?[^\\{{*\x00-\x1f\x7f-\x9f](?=[{{}}\\])|.+)"
    cut = keyed.select("doc_id", KEY, F.posexplode_outer(F.regexp_extract_all(F.coalesce("rtf", F.lit("")), F.lit(pattern), F.lit(1))).alias("slice", "rtf"))
    return cut.select("doc_id", KEY, F.coalesce("slice", F.lit(0)).cast("long").alias("slice"), F.coalesce("rtf", F.lit("")).alias("rtf")).repartition(F.xxhash64(KEY, "slice"))


def summary(text: str) -> tuple:
    found = TOKEN.findall(text)
    sign = np.fromiter(((t == "{") - (t == "}") for t in found), np.int64, len(found))
    depth = np.cumsum(sign)
    left: list[tuple] = []
    for pos in np.flatnonzero(sign).tolist():
        if sign[pos] > 0:
            left.append((int(depth[pos]), pos, shown.hides(found, pos)))
        elif left:
            left.pop()
    solid = [t for t in found[:64] if t[0] in "\\{}" or t.strip()][:2]
    if len(solid) < 2:
        solid = [t for t in found if t[0] in "\\{}" or t.strip()][:2]
    stray = sum(map(len, found)) != len(text) and bool(TOKEN.sub("", text).strip(BLANK))
    return int(depth[-1]) if found else 0, int(depth.min(initial=0)), int(depth.max(initial=0)), int((sign > 0).sum()), len(found), len(text.encode()), stray, solid, [{"depth": d, "pos": p, "hidden": h} for d, p, h in left]


def summaries(slices: DataFrame) -> DataFrame:
    """(doc_id, row_key, slice, ...) with the summary of each slice and, for the state at its beginning, the depth and the number of tokens before it."""
    kind = slices.schema["doc_id"].dataType.simpleString()
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    arrow = [pa.int64()] * 6 + [pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("depth", pa.int64()), ("pos", pa.int64()), ("hidden", pa.bool_())]))]

    def each(batches):
        for batch in batches:
            rows = list(zip(*map(summary, batch.column("rtf").to_pylist()), strict=True)) or [()] * len(names)
            yield pa.record_batch([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(rows, arrow, strict=True))], ["doc_id", KEY, "slice", *names])

    found = slices.select("doc_id", KEY, "slice", "rtf").mapInArrow(each, f"doc_id {kind}, {KEY} binary, slice long, {SUMMARY}")
    before = Window.partitionBy(KEY).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in (("depth_before", "net"), ("tokens_before", "tokens"))})


def group_stats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, row_key, n_tokens, n_groups, max_depth) of each document."""
    found = summaries(sliced(docs, size))
    return found.groupBy(KEY).agg(F.first("doc_id").alias("doc_id"), F.sum("tokens").alias("n_tokens"), F.sum("opens").alias("n_groups"), F.max(F.col("depth_before") + F.col("most")).alias("max_depth")).select("doc_id", KEY, "n_tokens", "n_groups", "max_depth")


def errors(docs: DataFrame, limits: Limits | None = None, size: int = SIZE) -> DataFrame:
    """(doc_id, row_key, error_type): the first check that a document fails, in the order of a reader's checks; the same as of whole documents."""
    limits = limits or Limits()
    found = summaries(sliced(docs, size))
    solid = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("solid") > 0, F.struct("slice", "solid")))), lambda x: x["solid"]))  # two short words of each slice
    facts = found.groupBy(KEY).agg(
        F.first("doc_id").alias("doc_id"), F.sum("bytes").alias("bytes"), F.bool_or("stray").alias("stray"), F.sum("tokens").alias("tokens"), F.sum("net").alias("net"),
        F.min(F.col("depth_before") + F.col("least")).alias("least"), F.max(F.col("depth_before") + F.col("most")).alias("most"), solid.alias("solid"),
    )
    headed = (F.size("solid") > 1) & (F.get("solid", F.lit(0)) == "{") & F.get("solid", F.lit(1)).rlike(r"^\\rtf(-?[0-9]+)? ?$")
    checks = (("input_too_large", F.col("bytes") > limits.max_input_bytes), ("tokenization", F.col("stray")), ("empty_input", F.col("tokens") == 0), ("unmatched_group_end", F.col("least") < 0), ("unbalanced_groups", F.col("net") != 0), ("missing_rtf_header", ~headed), ("group_depth_exceeded", F.col("most") > limits.max_group_depth))
    kind = F.coalesce(*(F.when(c, n) for n, c in checks))
    return facts.select("doc_id", KEY, kind.alias("error_type")).where("error_type IS NOT NULL")


def stacks(found: DataFrame) -> DataFrame:
    """(row_key, slice, stack): the groups open where each slice begins, outermost first, as (depth, pos, hidden); slices that begin outside of all have no row.

    At each depth it is the latest group that an earlier slice left open there: as-of, by a window over one depth of a document.
    """
    left = found.select(KEY, "slice", F.col("depth_before"), F.col("tokens_before"), F.explode("left").alias("g"))
    left = left.select(KEY, "slice", (F.col("depth_before") + F.col("g.depth")).alias("depth"), F.struct((F.col("tokens_before") + F.col("g.pos")).alias("pos"), F.col("g.hidden").alias("hidden")).alias("held"), F.lit(False).alias("asks"))
    asks = found.where("depth_before > 0").select(KEY, "slice", F.explode(F.sequence(F.lit(1).cast("long"), F.col("depth_before"))).alias("depth"), F.lit(None).cast("struct<pos:bigint,hidden:boolean>").alias("held"), F.lit(True).alias("asks"))
    latest = Window.partitionBy(KEY, "depth").orderBy("slice", F.desc("asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # what a slice leaves open counts from the next one on
    known = left.unionByName(asks).withColumn("held", F.last("held", ignorenulls=True).over(latest)).where("asks AND held IS NOT NULL")
    return known.groupBy(KEY, "slice").agg(F.array_sort(F.collect_list(F.struct("depth", "held.pos", "held.hidden"))).alias("stack"))


def groups(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of tokens.groups() with row_key, from slices: depth, level, group and hidden of each token as if the document were read in one piece. Unmatched ends have no group."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    slices = sliced(docs, size)
    found = summaries(slices)
    state = found.select(KEY, "slice", "tokens_before", "depth_before").join(stacks(found), [KEY, "slice"], "left")
    schema = StructType.fromDDL(f"doc_id {kind}, {KEY} binary, pos long, kind string, word string, param int, text string, depth long, level long, group long, hidden boolean")

    def each(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows = shown.grouped(row["rtf"], [(g["pos"], g["hidden"]) for g in row["stack"] or ()], row["tokens_before"])
                for at in range(0, len(rows), ROWS):
                    part = rows[at : at + ROWS]
                    yield pa.record_batch([pa.array([row["doc_id"]] * len(part), batch.schema.field("doc_id").type), pa.array([row[KEY]] * len(part), pa.binary()), *map(pa.array, zip(*part, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], schema.names)

    return slices.join(state, [KEY, "slice"]).select("doc_id", KEY, "rtf", "tokens_before", "stack").mapInArrow(each, schema)
