"""The reader as a DataFrame operator: one pass over documents, then tables of what was read.

parse() gives one row for each document, with arrays of nodes, inlines and warnings. The tables are explodes of those arrays; a
document that fails has an error and empty arrays, so it has no rows in any other table.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from scrivel.limits import Limits
from scrivel.operators.keys import KEY, Keys, given
from scrivel.parser.lexer import InvalidDocument
from scrivel.parser.reader import FLAGS, Reader, heading, shown
from scrivel.render.grid import hex_color, rowspans

#: Text of documents whose results a task holds at once, in bytes, and rows at most.
BYTES, ROWS = 4 << 20, 64
NODE = "channel string, path array<int>, node_type string, alignment string, fill string, pattern string, list_id bigint, list_kind string, level int, table string, row int, col int, width_twips int, merge string, span int, rowspan int, v_align string, image_format string, image_bytes int, is_heading boolean, text string"
INLINE = f"channel string, path array<int>, ord int, part int, inline_type string, text string, {', '.join(f'{f} boolean' for f in FLAGS)}, font_family string, font_size float, color string, background string, target_type string, target string, kind string, resolved boolean, note_id bigint"
WARNING = "seq int, type string, severity string, reason string, word string, target string"
SECTION = "index int, restart boolean, start_page int, number_format string"
GENERATED = "insertion_index int, kind string, explicit boolean"
#: What the words say before it is resolved; only if it is asked for.
RAW = {
    "cells": "table int, row int, col int, right int, n_right int, merge string, cell_fill int, row_fill int, table_fill int, percent int, top int, left int, bottom int, right_border int, row_top int, row_left int, row_bottom int, row_right int, row_h int, row_v int, text string",
    "marks": "ord int, ls bigint, level int, text string",
    "uses": "paragraph int, font_idx bigint, color_idx bigint, length int",
    "fonts": "font_idx bigint, pos int, family string",
    "default_font": "font_idx bigint",
    "overrides": "ls bigint, list_id bigint",
    "list_levels": "list_id bigint, level int, kind string",
}
PARSED = f"ir string, nodes array<struct<{NODE}>>, inlines array<struct<{INLINE}>>, warnings array<struct<{WARNING}>>, sections array<struct<{SECTION}>>, generated array<struct<{GENERATED}>>, paragraph_count bigint, run_count bigint, bytes_processed bigint, duration_ms bigint, error_type string, error string"


def fields(schema: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(now.strip().split()[0])
            now = ""
        else:
            now += ch
    return out


def flat_run(r: dict) -> dict:
    return {"text": r["text"], **{f: r[f] for f in FLAGS}, "font_family": r.get("font_family"), "font_size": r.get("font_size"), "color": hex_color(r["color"]) if "color" in r else None, "background": hex_color(r["background_color"]) if "background_color" in r else None}


def flat_inline(x: dict) -> list[dict]:
    kind = x["type"]
    if kind == "run":
        return [flat_run(x)]
    if kind == "hyperlink":
        return [{**flat_run(r), "target_type": x["target"]["type"], "target": x["target"]["value"]} for r in x["runs"]]
    if kind == "semantic_field":
        r = x["reference"]
        return [{"text": shown(x), "kind": r["kind"], "target": r.get("target") or r.get("identifier") or r.get("name"), "resolved": x.get("resolved", True)}]
    if kind == "page_field":
        return [{"text": shown(x), "kind": x["kind"], "target": x.get("target")}]
    if kind == "note_ref":
        return [{"text": str(x["id"]), "kind": x["kind"], "note_id": x["id"]}]
    return [{"target": x["name"]}] if kind == "bookmark_anchor" else [{"kind": x["kind"]["type"]}]


def flatten(document: dict, with_inlines: bool = True, with_headings: bool = True) -> tuple[list[dict], list[dict]]:
    nodes, inlines = [], []

    def shading(b):
        s = b.get("shading")
        return {"fill": hex_color(s["fill_color"]), "pattern": s.get("pattern")} if s else {}

    def walk(blocks, channel, path):
        for i, b in enumerate(blocks):
            here = {"channel": channel, "path": [*path, i]}
            if b["type"] == "paragraph":
                nodes.append({**here, "node_type": "paragraph", "alignment": b["alignment"], "text": "".join(map(shown, b["inlines"])), "is_heading": heading(b) if with_headings else None, **shading(b)})
                for k, x in enumerate(b["inlines"] if with_inlines else ()):
                    for part, y in enumerate(flat_inline(x)):
                        inlines.append({**here, "ord": k, "part": part, "inline_type": x["type"], **y})
            elif b["type"] == "imageblock":
                nodes.append({**here, "node_type": "image", "image_format": b["format"], "image_bytes": len(b["data"]), "width_twips": b.get("width_twips")})
            elif b["type"] == "listblock":
                nodes.append({**here, "node_type": "list", "list_id": b["list_id"], "list_kind": b["kind"]})
                for k, item in enumerate(b["items"]):
                    nodes.append({"channel": channel, "path": [*path, i, k], "node_type": "list_item", "list_id": b["list_id"], "list_kind": b["kind"], "level": item["level"]})
                    walk(item["blocks"], channel, [*path, i, k])
            else:
                name = ".".join(map(str, [channel, *path, i]))
                nodes.append({**here, "node_type": "table", "table": name, **shading(b.get("table_props", {}))})
                spans = rowspans(b)
                for r, row in enumerate(b["rows"]):
                    nodes.append({"channel": channel, "path": [*path, i, r], "node_type": "row", "table": name, "row": r, "alignment": row.get("row_props", {}).get("alignment")})
                    for c, cell in enumerate(row["cells"]):
                        merge = cell.get("merge")
                        start = merge["horizontal_start"]["span"] if isinstance(merge, dict) else None
                        text = "\n".join("".join(map(shown, p["inlines"])) for p in cell.get("blocks", []) if p["type"] == "paragraph")
                        nodes.append({"channel": channel, "path": [*path, i, r, c], "node_type": "cell", "table": name, "row": r, "col": c, "width_twips": cell.get("width_twips"), "merge": "horizontal_start" if start else merge, "span": start, "rowspan": spans[r][c], "v_align": cell.get("v_align"), "text": text, **shading(cell)})
                        walk(cell.get("blocks", []), channel, [*path, i, r, c])

    walk(document["blocks"], "body", [])
    structure = document.get("structure", {})
    for part in ("header", "footer"):
        for kind, blocks in structure.get(part + "s", {}).items():
            walk(blocks, f"{part}_{kind}", [])
    for n in structure.get("notes", []):
        walk(n["blocks"], f"note:{n['id']}", [])
    return nodes, inlines


EMPTY = {"nodes": [], "inlines": [], "warnings": [], "sections": [], "generated": [], **{name: [] for name in RAW}}


def failed(kind: str, message: str) -> dict:
    return {**EMPTY, "error_type": kind, "error": message}


def read_one(rtf: str | None, limits: Limits, want: frozenset | None = None, fields: tuple[str, ...] | None = None) -> dict:
    """A row of parse(), with the columns in `want` (all of them if None); fields: the same with the fields of their elements. A null text is empty input."""
    try:
        reader = Reader(limits, want is not None and not want.isdisjoint(RAW))
        found = reader.read(rtf or "")
    except InvalidDocument as e:
        return failed(e.kind, str(e))
    except RecursionError:
        return failed("group_depth_exceeded", "too deep")
    document = found["document"]
    managed = document.get("page_management", {})
    row = {**EMPTY, **found["stats"]}
    if reader.raw is not None:
        row |= reader.raw
        row["default_font"] = [] if reader.default_font is None else [{"font_idx": reader.default_font}]
        row["overrides"] = [{"ls": ls, "list_id": i} for ls, i in reader.overrides.items()]
        row["list_levels"] = [{"list_id": i, "level": n, "kind": k} for i, levels in reader.lists.items() for n, k in enumerate(levels)]
    wanted = lambda *names: want is None or not want.isdisjoint(names)
    if wanted("ir"):
        row["ir"] = json.dumps(document, ensure_ascii=False)
    if wanted("nodes", "inlines"):
        row["nodes"], row["inlines"] = flatten(document, wanted("inlines"), wanted("is_heading", "nodes") if fields is None else "nodes.is_heading" in fields or "nodes" in fields)
    if wanted("warnings"):
        row["warnings"] = [{"seq": i, "type": w["type"], "severity": w["severity"], "reason": w.get("reason"), "word": w.get("word") or w.get("control_word") or w.get("destination"), "target": w.get("target") or (str(w["ls_id"]) if "ls_id" in w else None)} for i, w in enumerate(found["warnings"])]
    row["sections"] = [{"index": s["index"], "restart": s["restart_page_numbering"], "start_page": s.get("start_page"), "number_format": s["number_format"]} for s in managed.get("sections", [])]
    row["generated"] = [{"insertion_index": g["insertion_index"], "kind": g["kind"]["type"], "explicit": g["explicit"]} for g in managed.get("generated_blocks", [])]
    return row


def asked(field: StructField, want: tuple[str, ...]) -> StructField:
    """A column, or of an array of structs the fields that are asked for."""
    some = [w.split(".")[1] for w in want if w.startswith(field.name + ".")]
    if not some or field.name in want:
        return field
    element = StructType([f for f in field.dataType.elementType.fields if f.name in some])
    return StructField(field.name, ArrayType(element), field.nullable)


def column(rows: list[dict], field: pa.Field) -> pa.Array:
    """A column of rows; an array of structs field by field."""
    if not (pa.types.is_list(field.type) and pa.types.is_struct(field.type.value_type)):
        return pa.array([r.get(field.name) for r in rows], field.type)
    lists = [r.get(field.name) or [] for r in rows]
    flat = [x for one in lists for x in one]
    struct = field.type.value_type
    parts = [pa.array([x.get(struct[i].name) for x in flat], struct[i].type) for i in range(struct.num_fields)]
    offsets = np.concatenate(([0], np.cumsum([len(one) for one in lists]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, fields=list(struct)), type=field.type)


def portions(batch: pa.RecordBatch, limit: int):
    """A batch of documents (its second column holds their texts) in slices of about `limit` bytes of text and ROWS rows at most, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and (total + n > limit or i - begin >= ROWS):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


def parse(docs: DataFrame, limits: Limits | None = None, want: tuple[str, ...] | None = None, bytes_at_once: int = BYTES) -> DataFrame:
    """(doc_id, row_key, ...) of (doc_id, rtf): all columns, or those in `want` and error_type; a name like nodes.text asks for a field of an array's elements. No shuffle; a task holds the results of about `bytes_at_once` of text at a time, or of one document. row_key tells rows apart that repeat an id or have none.

    A row whose read_error, if there is such a column, isn't null fails with that error.
    """
    limits = limits or Limits()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"doc_id {kind}, {KEY} binary, {PARSED}" + "".join(f", {name} array<struct<{fields}>>" for name, fields in RAW.items() if want and name in want))
    if want is not None:
        schema = StructType([asked(f, want) for f in schema.fields if f.name in ("doc_id", KEY, "error_type", *(w.split(".")[0] for w in want))])
    arrow = to_arrow_schema(schema)
    chosen = None if want is None else frozenset(w.split(".")[0] for w in want)

    def each(batches):
        keys = Keys()
        for batch in batches:
            for part in portions(batch, bytes_at_once):
                ids, texts, unread, has = (c.to_pylist() for c in part.columns)
                rows = [{"doc_id": i, KEY: keys(h, i, t), **(failed(e, "the file could not be read") if e else read_one(t, limits, chosen, want))} for i, t, e, h in zip(ids, texts, unread, has, strict=True)]
                yield pa.record_batch([column(rows, f) for f in arrow], schema=arrow)

    unread = F.col("read_error") if "read_error" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", "rtf", unread.alias("read_error"), given(docs)).mapInArrow(each, schema)


def table(parsed: DataFrame, name: str) -> DataFrame:
    """One of nodes, inlines, warnings, sections, generated and the names in RAW, a row for each element."""
    return parsed.select("doc_id", KEY, F.explode(name).alias("x")).select("doc_id", KEY, "x.*")


def stats(parsed: DataFrame) -> DataFrame:
    return parsed.where("error_type IS NULL").select("doc_id", "paragraph_count", "run_count", "bytes_processed", "duration_ms")


def failures(parsed: DataFrame) -> DataFrame:
    return parsed.where("error_type IS NOT NULL").select("doc_id", "error_type", "error")


def status(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, status): 0, 2 for a document that can't be read, 3 for a file that isn't text, 4 in strict mode if content was dropped."""
    dropped = F.exists("warnings", lambda w: w["type"] == "dropped_content")
    return parsed.select("doc_id", F.when(F.col("error_type") == "invalid_utf8", 3).when(F.col("error_type").isNotNull(), 2).when(F.lit(strict) & dropped, 4).otherwise(0).alias("status"))


