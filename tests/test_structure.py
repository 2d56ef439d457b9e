"""Slices, trees, channels, fields, properties and runs as tables, against folds over whole documents."""

import random

import pytest
from pyspark.sql import functions as F

from scrivel.limits import Limits
from scrivel.operators import analytics as A
from scrivel.operators import parse as P
from scrivel.operators import slices as S
from scrivel.operators import structure as X
from scrivel.operators import tokens as T
from scrivel.operators.keys import KEY, numbered
from scrivel.plans.queries import QUERIES


def random_document(r: random.Random, sound: bool = True) -> str:
    parts, depth = ["{\\rtf1 "], 1
    for _ in range(r.randint(0, 60)):
        what = r.random()
        if what < 0.2:
            parts.append(r.choice(["{", "{\\b ", "{\\*\\odd ", "{\\info ", "{\n\\header ", "{\\*\n\\nonesuch x", "{ \\footnote "]))
            depth += 1
        elif what < 0.4 and (depth > 1 or not sound):
            parts.append("}")
            depth -= 1
        else:
            parts.append(r.choice(["text ", "\\\\", "\\{", "\\}", "\\'e9", "\\u233 ?", "\\par ", "\n", "é", "\\~", "\\b0 ", "x*", "a\\*b"]))
    return "".join(parts) + "}" * (depth if sound else r.choice([depth, depth, 1, 0]))


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(11)
    rows = [(i % 40, random_document(r, i % 3 > 0)) for i in range(120)]
    rows += [(1, "{\\rtf1 a}"), (1, "{\\rtf1 a}"), (None, "{\\rtf1 {b}}"), (2, ""), (3, None), (4, "no group"), (5, "{\\rtf1 a\x01b{c}}"), (6, " \n{ \\rtf1 x}"), (7, "{\\rtf1" + "{" * 30 + "}" * 30 + "}"), (8, "{\\rtf1 " + "long text " * 50 + "}")]
    return numbered(spark.createDataFrame(rows, "doc_id long, rtf string").repartition(3))


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_slices_are_the_document(odd, size):
    whole = {tuple(x) for x in odd.select("doc_id", F.coalesce("rtf", F.lit(""))).collect()}
    parts = S.sliced(odd, size).groupBy(KEY, "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice", "rtf"))), lambda x: x["rtf"]), "").alias("rtf"))
    assert {(r.doc_id, r.rtf) for r in parts.collect()} == whole and parts.count() == odd.count()


@pytest.mark.parametrize("size", [1, 7])
def test_groups_of_slices(odd, size):
    columns = ["doc_id", "pos", "kind", "word", "param", "text", "depth", "level", "group", "hidden"]
    broken = T.errors(odd).where("error_type IN ('unmatched_group_end', 'unbalanced_groups')").select("doc_id").distinct()
    sound = odd.where("rtf IS NOT NULL").join(broken, "doc_id", "left_anti")
    want = sorted(map(repr, T.groups(sound).select(columns).collect()))
    assert want == sorted(map(repr, S.groups(sound, size).select(columns).collect())) and len(want) > 1000


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_checks_of_slices(odd, size):
    limits = Limits(max_group_depth=20, max_input_bytes=490)
    want = sorted((repr(r.doc_id), r.error_type) for r in T.errors(odd, limits).collect())
    assert want == sorted((repr(r.doc_id), r.error_type) for r in S.errors(odd, limits, size).collect())
    assert {e for _, e in want} == {"input_too_large", "tokenization", "empty_input", "unmatched_group_end", "unbalanced_groups", "missing_rtf_header", "group_depth_exceeded"}


def test_counts_of_slices(odd):
    g = T.groups(odd.where("rtf IS NOT NULL")).groupBy(KEY).agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n_tokens"), F.count_if(F.col("kind") == "open").alias("n_groups"))
    got = S.group_stats(odd, 5).where("n_tokens > 0")
    assert sorted(map(repr, g.select("doc_id", "n_tokens", "n_groups").collect())) == sorted(map(repr, got.select("doc_id", "n_tokens", "n_groups").collect()))


# ---- trees and intervals


def test_group_tree(spark, odd):
    tokens = T.groups(odd.where("rtf IS NOT NULL")).where("doc_id IS NULL OR doc_id > 1")
    tree = X.with_paths(X.with_parents(X.group_table(tokens)), "group", "parent", F.col("ordinal"))
    want = {}
    for r in sorted(tokens.collect(), key=lambda r: (r[KEY], r.pos)):
        stack, kids, out = want.setdefault(r[KEY], ([], {}, {}))
        if r.kind == "open":
            parent = stack[-1] if stack else None
            n = kids[parent] = kids.get(parent, -1) + 1
            path = [*(out[parent][1] if stack else []), n]
            stack.append(r.pos)
            out[r.pos] = [parent, path, X.END]
        elif r.kind == "close" and stack:
            out[stack.pop()][2] = r.pos
    want = {(k, g, *map(repr, v)) for k, (_, _, out) in want.items() for g, v in out.items()}
    assert {(bytes(r[KEY]), r.group, repr(r.parent), repr(r.path), repr(r.end)) for r in tree.collect()} == {(bytes(k), *rest) for k, *rest in want} and len(want) > 300


def test_innermost_intervals(spark):
    r = random.Random(3)
    intervals, points = [], []
    for doc in (b"a", b"b"):
        def nest(low, high, depth=0):
            at = low
            while at + 2 < high and depth < 6:
                begin = r.randint(at, min(high, at + 12))
                end = r.randint(begin, min(high, begin + 40))
                if begin > at:
                    intervals.append((doc, begin, end, len(intervals)))  # noqa: B023
                    nest(begin, end, depth + 1)
                at = end + 1
        nest(0, 300)
        points += [(doc, p) for p in range(0, 310, 3)]
    got = X.innermost(spark.createDataFrame(points, f"{KEY} binary, pos long"), spark.createDataFrame(intervals, f"{KEY} binary, begin long, end long, value long"), "within").collect()
    for g in got:
        around = [(e - b, -v, v) for k, b, e, v in intervals if k == bytes(g[KEY]) and b <= g.pos <= e]
        assert g.within == (min(around)[2] if around else None)
    assert len(got) == len(points) and len(intervals) > 30


def test_channels(spark):
    docs = spark.createDataFrame([
        (1, r"{\rtf1 a{\header top {\i x}{\*\odd gone{\footnote never}}}b\par{\footnote one{\*\odd hidden}{\info h} more}c{\endnote two\par three}{\pict 00ff}d}"),
        (1, r"{\rtf1 a{\header top {\i x}{\*\odd gone{\footnote never}}}b\par{\footnote one{\*\odd hidden}{\info h} more}c{\endnote two\par three}{\pict 00ff}d}"),
        (None, r"{\rtf1 {\fonttbl{\f0 F;}}{\footerl f{\footnote in footer}}{\field{\*\fldinst PAGE}{\fldrslt 7}}\u-10179?\u-9063?x}"), (3, None)], "doc_id long, rtf string")
    got = sorted((repr(r.doc_id), r.channel, repr(r.number), r.text) for r in X.channel_texts(T.groups(numbered(docs), pieces=True)).collect())
    one = [("1", "body", "None", "ab\ncd"), ("1", "header_default", "None", "top x"), ("1", "note", "1", "one more"), ("1", "note", "2", "two\nthree")]
    assert got == sorted([*one, *one, ("None", "body", "None", "7💙x"), ("None", "footer_even", "None", "f"), ("None", "note", "1", "in footer")])


def test_channels_agree_with_the_reader(spark, odd):
    sound = odd.join(P.failures(P.parse(odd)).select("doc_id").distinct(), "doc_id", "left_anti").where("doc_id > 1")
    nodes = P.table(P.parse(sound), "nodes").where("node_type = 'paragraph'")
    want = sorted((r.doc_id, "note" if r.channel.startswith("note") else r.channel, r.text.strip()) for r in nodes.groupBy("doc_id", "channel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "").alias("text")).collect() if r.text.strip())
    texts = [(r.doc_id, r.channel, r.text.replace("\n", "").strip()) for r in X.channel_texts(T.groups(sound, pieces=True)).collect()]
    joined = {}
    for d, c, t in texts:
        joined.setdefault((d, c), []).append(t)
    assert {(d, c) for d, c, _ in want} <= set(joined) and len(want) > 10
    single = {k for k, v in joined.items() if len(v) == 1 and k[1] != "note"}
    assert all(joined[d, c] == [t] for d, c, t in want if (d, c) in single and (d, c) not in {(a, b) for a, b, _ in want if sum(x[:2] == (a, b) for x in want) > 1})


def test_fields(spark):
    docs = spark.createDataFrame([
        (1, r'{\rtf1 a{\field{\*\fldinst HYPERLINK \\l "x"}{\fldrslt see {\b this}}}b}'),
        (2, r"{\rtf1 {\field{\*\fldinst REF one\b0 {\field{\*\fldinst SEQ two}{\fldrslt in}} end}{\fldrslt x{\field{\*\fldinst PAGE}{\fldrslt y{\field{\*\fldinst DEEP}{\fldrslt !}}}no}z{\*\odd gone}}}{\*\odd{\field{\*\fldinst GONE}{\fldrslt gone}}}}"),
        (2, r"{\rtf1 {\field nothing}}"), (None, r"{\rtf1 {\footnote {\field{\*\fldinst A}{\fldrslt note\par two}}}{\fldrslt stray}}"), (4, r"{\rtf1 none}")], "doc_id long, rtf string")
    docs = numbered(docs.union(docs.where("doc_id = 1")))  # equal rows, too, keep their own
    got = sorted((repr(r.doc_id), r.depth, r.instruction, r.result, r.outer is None) for r in X.fields(T.groups(docs, pieces=True)).collect())
    assert got == sorted([("1", 1, 'HYPERLINK \\l "x"', "see this", True),
        ("1", 1, 'HYPERLINK \\l "x"', "see this", True), ("2", 1, "REF one \\b0  end", "inxy!z", True), ("2", 2, "SEQ two", "in", False), ("2", 2, "PAGE", "y!", False), ("2", 3, "DEEP", "!", False),
        ("2", 1, "", "", True), ("None", 1, "A", "note\ntwo", True)])


# ---- cells and runs


def test_definitions_agree_with_the_reader(spark):
    r = random.Random(4)
    docs = []
    for i in range(60):
        rows = []
        for _ in range(r.randint(1, 4)):
            words, n = ["\\trowd", r.choice(["", "\\trcbpat3"])], r.randint(1, 4)
            words += [r.choice(["", "\\trbrdrt\\brdrs\\brdrw7", "\\trbrdrh\\brdrdb"])]
            for c in range(n):
                words += [r.choice(["", "\\clmgf", "\\clmrg", "\\clvmgf", "\\clvmrg", "\\clmgf\\clvmrg"]), r.choice(["", "\\clcbpat2", "\\clcbpat1\\clcbpat4"]), r.choice(["", "\\clshdng500"])]
                words += r.sample(["\\clbrdrt\\brdrs\\brdrw10", "\\clbrdrl\\brdrw5\\brdrdb", "\\clbrdrb\\brdrs", "\\brdrw9", "\\clbrdrr\\brdrnone\\brdrw-3", "\\clbrdrt\\brdrw2"], r.randint(0, 4))
                words.append(f"\\cellx{(c + 1) * 500}")
            rows.append("".join(words) + " " + "".join(f"\\pard\\intbl c{c}\\cell " for c in range(n)) + "\\row ")
        docs.append((i % 50, "{\\rtf1 " + "".join(rows) + "}"))
    df = spark.createDataFrame(docs, "doc_id long, rtf string").repartition(3)
    cells = P.table(P.parse(df, want=("cells",)), "cells").select("doc_id", "row", "col", "right", "merge", F.col("cell_fill").alias("fill"), "percent", "row_fill", "top", "left", "bottom", "right_border")
    got = X.cell_definitions(T.groups(df)).drop(KEY)
    assert sorted(map(repr, got.select(cells.columns).withColumn("col", F.col("col").cast("int")).collect())) == sorted(map(repr, cells.collect())) and cells.count() > 200


def test_runs_agree_with_the_reader(spark):
    r = random.Random(6)
    words = ["\\b ", "\\b0 ", "\\i ", "\\ul ", "\\ulnone ", "\\strike ", "\\scaps ", "\\caps ", "\\fs28 ", "\\fs20 ", "\\plain ", "{\\info h}", "\\cf1 ", "\\highlight2 ", "\\highlight0 ", "\\f1 ", "{\\*\\odd x}"]
    docs = []
    for i in range(80):
        parts, depth = ["{\\rtf1{\\fonttbl{\\f1 One;}}{\\colortbl;\\red1;\\red2;}"], 1
        for _ in range(r.randint(1, 40)):
            what = r.random()
            if what < 0.15:
                parts.append("{")
                depth += 1
            elif what < 0.3 and depth > 1:
                parts.append("}")
                depth -= 1
            else:
                parts.append(r.choice(words) if what < 0.65 else r.choice(["text ", "more ", "é", "\\u233 ?", "\\par "]))
        docs.append((i % 60, "".join(parts) + "}" * depth))
    df = spark.createDataFrame(docs, "doc_id long, rtf string").repartition(3)
    inlines = P.table(P.parse(df, want=("inlines",)), "inlines").where("inline_type = 'run' AND channel = 'body'")
    flags = [*dict.fromkeys(X.TOGGLES.values())]
    want = sorted(repr((x.doc_id, x.text, tuple(x[f] for f in flags), x.font_size or 0, x.font_family, x.color and x.color[:3], x.background and x.background[:3])) for x in inlines.collect())
    colors = {None: None, 1: "#01", 2: "#02"}
    found = X.runs(T.groups(df, pieces=True)).where("channel = 'body'").collect()
    got = sorted(repr((x.doc_id, x.text, tuple(bool(x[f]) for f in flags), (x["size"] or 0) / 2 or 0, {1: "One"}.get(x.font), colors[x.color], colors[x.highlight])) for x in found)
    assert got == want and len(want) > 200
    keys = {}
    for x in found:
        assert keys.setdefault(tuple(x[p] for p in X.PROPERTIES), x.style_key) == x.style_key
    assert len(set(keys.values())) == len(keys) > 20


def test_cells_agree_with_the_reader(spark):
    r = random.Random(12)
    docs = []
    for i in range(50):
        row = lambda n: "\\trowd" + "".join(f"\\cellx{(c + 1) * 500}" for c in range(n)) + " " + "".join("\\pard\\intbl " + r.choice(["x", "{\\b y}", "", "a\\par b", "\\u233 ?", "{\\*\\odd z}w"]) + "\\cell " for _ in range(n)) + "\\row "
        docs.append((i, "{\\rtf1 " + "".join(row(r.randint(1, 4)) for _ in range(r.randint(1, 4))) + r.choice(["", "\\pard after\\par ", "\\trowd\\cellx9 "]) + "}"))
    df = spark.createDataFrame(docs, "doc_id long, rtf string")
    got = sorted((x.doc_id, x.row, list(x.cells)) for x in T.cells(df).collect())
    nodes = P.table(P.parse(df), "nodes").where("node_type = 'cell'").groupBy("doc_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]).alias("cells"))
    assert got == sorted((x.doc_id, x.row, list(x.cells)) for x in nodes.collect())


def test_word_counts(spark, odd):
    texts = T.plain_text(odd)
    assert sorted(map(tuple, T.word_counts(odd).collect())) == sorted(map(tuple, A.word_counts(texts).collect()))


def test_grid(spark):
    r = random.Random(8)
    cells, want = [], {}
    for doc in (b"a", b"b"):
        for table in range(20):
            rows = [[(r.choice([None, None, "horizontal_start", "horizontal_continue", "vertical_start", "vertical_continue"]), r.choice([None, 100 * r.randint(1, 9)])) for _ in range(r.randint(1, 5))] for _ in range(r.randint(1, 5))]
            held = {}
            for y, row in enumerate(rows):
                for x, (m, w) in enumerate(row):
                    cells.append((doc, table, y, x, m, w))
            merge = lambda y, x: rows[y][x][0] if y < len(rows) and x < len(rows[y]) else None  # noqa: B023, E731
            covered = set()
            for y, row in enumerate(rows):
                for x, (m, _) in enumerate(row):
                    wide = high = 1
                    while m == "horizontal_start" and merge(y, x + wide) == "horizontal_continue":
                        covered.add((y, x + wide))
                        wide += 1
                    while m == "vertical_start" and merge(y + high, x) == "vertical_continue":
                        covered.add((y + high, x))
                        high += 1
                    held[y, x] = (x, wide, y, high)
            for k, v in held.items():
                want[doc, table, *k] = (None,) * 4 if k in covered else v
    df = spark.createDataFrame(cells, f"{KEY} binary, table long, row long, col long, merge string, width long").repartition(3)
    got = {(bytes(g[KEY]), g.table, g.row, g.col): (g.x, g.wide, g.y, g.high) for g in X.grid(df).collect()}
    assert got == want
    widths = {(bytes(g[KEY]), g.table, g.x): g.width for g in X.columns(df).collect()}
    for k in {(d, t) for d, t, *_ in cells}:
        own = sorted((y, x, w) for d, t, y, x, m, w in cells if (d, t) == k and want[d, t, y, x][1] == 1 and w is not None)
        count = max(v[0] + v[1] for c, v in want.items() if c[:2] == k and v[0] is not None)
        assert {x: w for (d, t, x), w in widths.items() if (d, t) == k} == {x: next((w for _, z, w in own if z == x), None) for x in range(count)}


def test_contents(spark):
    r = random.Random(2)
    docs = []
    for i in range(12):
        body = "".join(f"{{\\b\\fs{r.choice([28, 32, 40, 60])} Part {k}}}\\par " if r.random() < 0.5 else f"{{\\b\\fs20 Small {k}}}\\par plain\\par " for k in range(20))
        docs.append((i % 10, "{\\rtf1 " + body + "}"))
    df = spark.createDataFrame(docs, "doc_id long, rtf string")
    found = X.headings(X.runs(T.groups(df, pieces=True)))
    nodes = P.table(P.parse(df, want=("nodes",)), "nodes").where("is_heading")
    assert sorted((x.doc_id, x.text) for x in found.collect()) == sorted((x.doc_id, x.text) for x in nodes.collect())
    per = {}
    for x in X.contents(found).collect():
        per.setdefault(bytes(x[KEY]), []).append((x.paragraph, x["size"], x.number))
    sizes = {}
    for x in found.collect():
        sizes.setdefault(bytes(x[KEY]), set()).add(x["size"])
    for k, rows in per.items():
        ranks, now = {s: n for n, s in enumerate(sorted(sizes[k], reverse=True)[:3])}, [0, 0, 0]
        for _, size, number in sorted(rows):
            level = ranks[size]
            now = [*now[:level], now[level] + 1, *[0] * (2 - level)]
            assert number == ".".join(map(str, now[: level + 1]))


def test_tables_of_repeated_and_missing_ids(spark):
    """Fonts, widths and references of documents that share an id stay apart."""
    one = lambda font, *right: f"{{\\rtf1{{\\fonttbl{{\\f1 {font};}}}}\\deff1\\trowd{''.join(f'\\cellx{x}' for x in right)} " + "{\\f1 x}\\cell " * len(right) + "\\row }"
    docs = spark.createDataFrame([(1, one("A", 100, 300)), (1, one("B", 150, 500)), (None, one("C", 70, 90))], "doc_id long, rtf string").repartition(3)
    parsed = P.parse(docs, want=("cells", "uses", "fonts", "default_font"))
    assert sorted(r.width for r in A.cell_widths(P.table(parsed, "cells")).collect()) == [20, 70, 100, 150, 200, 350]
    fonts = A.resolve_fonts(*(P.table(parsed, name) for name in ("uses", "fonts", "default_font")))
    assert sorted((repr(r.doc_id), r.family) for r in fonts.select("doc_id", "family").distinct().collect()) == [("1", "A"), ("1", "B"), ("None", "C")]


def test_fields_fold_a_document_once(spark):
    docs = spark.createDataFrame([(1, "{\\rtf1 {\\field{\\*\\fldinst REF a}{\\fldrslt b}}}")], "doc_id long, rtf string")
    found = X.fields(T.groups(docs, pieces=True))
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.instruction, r.result) for r in found.collect()] == [("REF a", "b")]


def test_fields_of_a_fold_are_those_of_tokens(spark):
    r = random.Random(23)
    opens = ["{", "{\\field", "{\\field ", "{\\*\\fldinst ", "{\\fldinst REF ", "{\\fldrslt ", "{\\*\\fldrslt ", "{\\*\\field ", "{\\*\\odd ", "{\\info ", "{\\*\\footnote ", "{\\header ", "{ \\field", "{\\*"]
    says = ["text ", " ", "x", "\\b0 ", "\\b", "\\u233 ?", "\\u-10179 ?\\u-9072 ?", "\\u-10179 ", "\\u-9072 ", "\\u99999999999 ", "\\'e9", "\\{", "\\~", "\\*", "\\par ", "\\field ", "\\fldinst", "\n", "é"]
    rows = []
    for i in range(400):
        parts, depth = ["{\\rtf1 "], 1
        for _ in range(r.randint(0, 70)):
            what = r.random()
            if what < 0.35:
                parts.append(r.choice(opens[:7] if what < 0.28 else opens))
                depth += 1
            elif what < 0.55 and (depth > 1 or i % 4 == 0):
                parts.append("}")
                depth -= 1
            else:
                parts.append(r.choice(says))
        rows.append((i % 150 or None, "".join(parts) + "}" * r.choice([depth, depth, depth, max(depth, 0) // 2])))
    docs = numbered(spark.createDataFrame([*rows, rows[5], (1, None), (1, "")], "doc_id long, rtf string").repartition(3))
    want, got = X.fields(T.groups(docs, pieces=True)), T.fields(docs)
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    want = sorted(map(repr, want.collect()))
    assert sorted(map(repr, got.collect())) == want and len(want) > 500
    assert any("outer=None" not in x for x in want) and any("depth=3" in x for x in want)


def test_a_query_on_fields_shuffles_no_tokens(spark, sf_dir):
    # the orders of a customer are brought together, that's all; tables that are written on the way would be scanned as well
    plan = QUERIES["nested_fields"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == plan.count("Aggregate") == plan.count("Relation") == 1 and "Join" not in plan and "Window" not in plan
    # and what is shuffled is values, not text made of them
    assert "fldrslt" not in plan[plan.index("Aggregate") :].split("\n", 1)[1]
