"""Operators on pages and embeddings: brute force, round trips, and the cases that their docstrings define."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrivel.llm import ann, url_filter, warc

CLASH = "digest payload first size header rule decided host path n v codes".split()


@pytest.fixture(scope="module")
def pages(spark):
    long, same = "<title>red car</title>" + "x" * 200, "<title>blue sky</title>" + "é" * 90
    rows = [(5, "https://a.org/x", long), (3, "http://a.org", long), (3, "http://a.org", long), (None, "x://b.org/", long), (7, "no scheme", "short"), (8, "://EXAMPLE.org/es/1?q#f", "short"), (9, None, None), (10, "s://redcar.com/fr/1", same),
            (11, "s://bluesky.com/de/\r\n2", same), (12, "s://u.example.org/en/1", ""), (13, "s://carsky.net/de/9", "z" * 100_000), (14, "s://x.org:80/y", None), (15, "s://com/de/", "a"), (16, "s://notcom/de/?", "a"), (17, "s://A.b://c.org/", "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASH})


def test_archive(spark, pages, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages, path)
    back = warc.read_archive(spark, path)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, p in rows:
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    want = []
    for i, p in rows:
        again = p in first and (i is None or i > first[p])
        want.append((i, p, hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    got = [(r.page_id, bytes(r.payload), r.digest, r.record_type, r.refers_to) for r in back.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert spark.read.parquet(f"{path}/payloads").count() == len({p for _, p in rows})
    raw = back.where("page_id = 10").select(warc.record_bytes(back).alias("b")).first().b
    assert bytes(raw).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and bytes(raw).endswith(("é" * 90).encode() + b"\r\n\r\n")
    assert back.where("page_id = 11").first().url == "s://bluesky.com/de/%0D%0A2"
    heads = [bytes(r.header).decode() for r in back.collect()]
    assert len({re.search("WARC-Record-ID: (.*)", h)[1] for h in heads}) == len(rows) and all(re.search(r"\r\nWARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", h) for h in heads)


def test_archive_of_any_ids(spark, tmp_path):
    """Ids that hold the signs of a header, empty and missing urls, and addresses that imitate header lines."""
    rows = [("a>b", "", "x" * 100), ("\r\nWARC-Type: revisit\r\n", None, "x" * 100), ("", "\r\nScrivel-Page-ID: z\r\n", "y"), (None, "é ü", None), ("100% +", "u", "z")]
    warc.write_archive(spark.createDataFrame(rows, "page_id string, url string, html string"), f"file://{tmp_path}/ids")
    back = {(r.page_id, r.url, bytes(r.payload).decode(), r.record_type, r.refers_to) for r in warc.read_archive(spark, f"file://{tmp_path}/ids").collect()}
    first = min(i for i, _, p in rows if p == "x" * 100)
    want = {(i, u and u.replace("\r", "%0D").replace("\n", "%0A"), p or "", "revisit" if p == "x" * 100 and i != first else "response", first if p == "x" * 100 and i != first else None) for i, u, p in rows}
    assert back == want


def test_an_archive_grows(spark, pages, tmp_path):
    """Two calls, as brute force: payloads are stored once, new records revisit the response that stands, and every revisit names a record."""
    path = f"file://{tmp_path}/grown"
    warc.write_archive(pages, path)
    before = {bytes(r.header) for r in spark.read.parquet(f"{path}/records").collect()}
    more = [(1, "u", "<title>red car</title>" + "x" * 200), (20, "u", "new" * 50), (19, "u", "new" * 50), (None, "u", "new" * 50), (21, "u", "short"), (2, "u", None)]
    warc.write_archive(spark.createDataFrame(more, "page_id long, url string, html string"), path)
    back = warc.read_archive(spark, path).collect()
    assert before < {bytes(r.header) for r in back} and len(back) == len(before) + len(more)
    texts = {(r.html or "").encode() for r in pages.collect()} | {(h or "").encode() for _, _, h in more}
    assert spark.read.parquet(f"{path}/payloads").count() == len(texts) and {bytes(r.payload) for r in back} == texts
    got = {(r.page_id, r.record_type, r.refers_to) for r in back if r.url == "u"}
    assert got == {(1, "revisit", 3), (20, "revisit", 19), (19, "response", None), (None, "revisit", 19), (21, "response", None), (2, "response", None)}
    head = lambda r, name: (re.search(rf"\r\n{name}: ([^\r]*)\r\n", bytes(r.header).decode()) or [None, None])[1]
    records = {head(r, "WARC-Record-ID"): r for r in back}
    assert len(records) == len(back) and all(re.fullmatch("<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}>", i) for i in records)
    for r in back:
        to = head(r, "WARC-Refers-To")
        assert (to is not None) == (r.record_type == "revisit")
        if to:
            assert (records[to].page_id, records[to].digest, records[to].record_type) == (r.refers_to, r.digest, "response")
    with pytest.raises(ValueError, match="ids of type bigint"):
        warc.write_archive(spark.createDataFrame([("a", "u", "x")], "page_id string, url string, html string"), path)


def test_archive_of_nothing(spark, pages, tmp_path):
    warc.write_archive(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archive(spark, f"file://{tmp_path}/none").count() == 0


def test_a_changed_payload_is_an_error(spark, pages, tmp_path):
    path = f"file://{tmp_path}/broken"
    warc.write_archive(pages, path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")).write.parquet(f"{path}/p2")
    import shutil

    shutil.rmtree(f"{tmp_path}/broken/payloads")
    shutil.move(f"{tmp_path}/broken/p2", f"{tmp_path}/broken/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, path).collect()


def judged(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_urls(pages):
    for r in url_filter.judge(pages).join(pages.select(F.col("page_id").alias("i"), "url"), F.col("page_id").eqNullSafe(F.col("i"))).collect():
        host, path, rule, verdict = judged(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages.where("page_id = 13")).collect()} == {"allow"}


def test_segmentation(spark):
    counts = {"red": 50, "car": 40, "redc": 1, "sky": 9, "blue": 9, "c" * 30: 2, "c" * 60: 1}
    names = ["redcar", "blueskyx", "", "red-car9sky", "c" * 59, "c" * 61, "x" * 3000 + "red", "é", "RED"]
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.name: r.words for r in url_filter.segmented(spark.createDataFrame([(n,) for n in names * 2], "name string"), words).collect()}
    assert got == {n: likeliest(n, counts) for n in names}
    assert got["redcar"] == ["red", "car"] and got["blueskyx"] == ["blue", "sky", "x"] and got[""] == []
    assert url_filter.segmented(spark.createDataFrame([("ab",)], "name string"), words.limit(0)).first().words == ["a", "b"]


def likeliest(name, counts):
    """The split by brute force over all words at each place."""
    total = sum(counts.values()) + 1
    best = [(0.0, [])]
    for end in range(1, len(name) + 1):
        cost, words = best[-1]
        options = [(cost + math.log(total) + 10, words, name[end - 1])]
        options += [(best[end - len(w)][0] + math.log(total / n), best[end - len(w)][1], w) for w, n in counts.items() if name[:end].endswith(w)]
        cost, words, last = min(options, key=lambda x: x[0])
        best.append((cost, [*words, last]))
    return best[-1][1]


def test_verdicts_against_brute_force(spark):
    """Counts, smoothing and sums of naive Bayes, all over again."""
    r = random.Random(3)
    words = "spam loot calm tree red blue".split()
    rows = [(i, f"https://{''.join(r.choice(words) for _ in range(2))}.{r.choice(['com', 'net', 'org'])}/{r.choice(['de', 'fr', 'xx'])}/{r.choice(words)}{r.randrange(50)}", f"<title>{r.choice(words)} {r.choice(words)} rare{'x' * r.randrange(40)}</title>") for i in range(300)]
    got = {x.page_id: x for x in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    counts, seen, urls, found = {}, np.zeros((2, url_filter.BUCKETS)), [0, 0], {}
    for _, _, html in rows:
        for w in re.findall("[a-z]+", html[7:-8]):
            counts[w] = counts.get(w, 0) + 1
    for i, url, _ in rows:
        host, path, _, verdict = judged(url)
        names = ["h " + w for label in host.split(".") for w in likeliest(label, counts)]
        names += ["p " + ("#" * len(t) if t.isdigit() else t) for t in re.findall("[a-z]+|[0-9]+", path)]
        found[i] = [zlib.crc32(t.encode()) % url_filter.BUCKETS for t in names]
        if verdict:
            label = int(verdict == "block")
            urls[label] += 1
            for place in found[i]:
                seen[label, place] += 1
    p = (seen + 1) / (seen + 1).sum(axis=1, keepdims=True)
    for i, url, _ in rows:
        odds = math.log((urls[1] + 0.5) / (urls[0] + 0.5)) + sum(math.log(p[1, x] / p[0, x]) for x in found[i])
        assert abs(got[i].log_odds - odds) < 1e-9 and got[i].verdict == (judged(url)[3] or ("block" if odds > 0 else "allow"))


def test_naive_bayes_learns_from_rules(spark):
    rows = []
    for i in range(400):
        r = random.Random(i)
        bad = i % 2
        name = "".join(r.choice(["spam", "loot"] if bad else ["calm", "tree"]) for _ in range(2))
        tld = "com" if i % 5 else "net"
        rows.append((i, f"https://{name}.{tld}/{'de' if bad else 'fr'}/{r.randrange(999)}", "<title>spam loot calm tree</title>"))
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).where("rule IS NULL").collect()
    assert out and all((r.verdict == "block") == bool(r.page_id % 2) for r in out)


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 18)) + 2 * r.normal(size=(6, 18))[r.integers(0, 6, 900)]
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[40][1]) for i in range(150)] + [(2000, rows[3][1]), (2000, rows[3][1])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 18), (3003, [float("nan")] + [1.0] * 17), (3004, [None] + [1.0] * 17), (3005, [float("inf")] * 18), (3006, [1.0] * 5), (None, [1.0] * 18), (3050, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in CLASH}).repartition(3)


def test_nearest(spark, vectors):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and len(v) == 18 and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(good))
    x = np.array([good[i] / np.sqrt((good[i] ** 2).sum()) for i in ids])
    got = {}
    for r in ann.search(vectors, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = total = 0
    for q in ids[ids % 10 == 0].tolist():
        s = (x * x[ids == q][0]).sum(axis=1)
        s[ids == q] = -9
        order = np.lexsort((ids, -np.round(s, 12)))[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        hit += len({v for v, _ in got[q].values()} & set(ids[order].tolist()))
        total += 5
        for v, score in got[q].values():
            assert abs(score - s[ids == v][0]) < 1e-12
    assert set(got) == set(ids[ids % 10 == 0].tolist()) and hit == total
    assert [got[1000 + 10 * k][1][0] for k in range(15)] == [40] * 15 and got[40][1][0] == 1000


def test_nearest_in_blocks_and_of_few(vectors):
    one = {tuple(r) for r in ann.search(vectors, F.col("vec_id") % 50 == 0).collect()}
    assert one == {tuple(r) for r in ann.search(vectors, F.col("vec_id") % 50 == 0, block_bytes=7 * 8 * 18).collect()}
    few = ann.search(vectors.where("vec_id IN (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.search(vectors.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(vectors.where("vec_id = 5"), F.col("vec_id") == 5).count() == 0


def test_different_vectors_of_the_same_cosine(spark):
    """All beside the query are as near as one another: of what is reranked the smallest ids are found, in every block."""
    rows = [(0, [1.0, 0.0, 0.0])] + [(10_000 - i, [0.6, 0.8 * float(np.cos(a)), 0.8 * float(np.sin(a))]) for i, a in enumerate(np.linspace(0, 6, 5000))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    x = ann.unit(np.array([v for _, v in rows[1:]]))
    score = (x * np.array([1.0, 0.0, 0.0])).sum(axis=1)
    order = np.lexsort(([i for i, _ in rows[1:]], -score))[:5]
    want = [rows[1 + k][0] for k in order]
    assert [r.vec_id for r in ann.search(vectors, F.col("vec_id") == 0, rerank=6000).orderBy("rank").collect()] == want


def test_lengths_and_repeated_ids_of_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(-5, [1.0, 0.0])] + [(i, [float(c) for c in r.normal(size=8)]) for i in range(199)]
    rows += [(500, [float(c) for c in np.array(rows[1 + 50][1]) * (1 + k / 1e4)]) for k in range(40)]  # one id, many vectors beside that of id 50
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    vectors = vectors.union(spark.createDataFrame([(1000 + i, [float(c) for c in r.normal(size=3)]) for i in range(0, 60, 10)], "vec_id long, embedding array<double>"))
    found = ann.search(vectors, F.col("vec_id") % 50 == 0, rerank=100).collect()
    assert {r.query_id for r in found} == {0, 50, 100, 150, 500, 1000, 1050} and len(found) == 35
    assert {r.vec_id for r in found if r.query_id in (1000, 1050)} == {1000, 1010, 1020, 1030, 1040, 1050}  # among vectors of their own length
    of = [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == 50]
    assert of[0] == 500 and len(set(of)) == 5 and -5 not in of


def test_the_codes_choose_what_is_reranked(spark, monkeypatch):
    """Few exact scores, and a recall of nine in ten or more."""
    r = np.random.default_rng(9)
    x = ann.unit(r.normal(size=(40, 32))[r.integers(0, 40, 6000)] + 0.7 * r.normal(size=(6000, 32)))
    quantiser = ann.Quantiser(x[:2000])
    batch = pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), pa.array([[i] for i in range(6000)], pa.list_(pa.int64())), pa.array([c.tobytes() for c in quantiser.packed(x)], pa.binary())], ["v", "ids", "codes"])
    asks, scored = np.arange(0, 6000, 50), []
    monkeypatch.setattr(ann.Block, "taken", lambda self, nearest, rows, score, at, real=ann.Block.taken: (scored.append(int((score > -np.inf).sum())), real(self, nearest, rows, score, at))[1])
    found, best = ann.Nearest(asks, 5), np.full((len(asks), 200), -np.inf, np.float32)
    for at in range(0, 6000, 1500):
        block = ann.Block(batch.slice(at, 1500))
        block.search(quantiser, x[asks], slice(0, 256), found, best)
    exact = x[asks] @ x.T
    exact[np.arange(len(asks)), asks] = -9
    want = np.argsort(-exact, axis=1)[:, :5]
    hit = sum(len(set(a) & set(b)) for a, b in zip(want.tolist(), found.id.tolist(), strict=True))
    assert hit >= 0.9 * want.size and sum(scored) < 600 * len(asks)


def test_parallel_residuals_cost_more():
    r = np.random.default_rng(0)
    x = ann.unit(r.normal(size=(3000, 16)))

    def parallel(threshold):
        q = ann.Quantiser(x, threshold)
        y = q.split(x)
        left = (y - q.decoded(q.codes(y))).reshape(len(x), -1)
        return ((left * x).sum(axis=1) ** 2).mean()

    assert parallel(0.6) < 0.5 * parallel(0.0)
