"""k-means, shards and hard negatives: brute force, and the cases that their docstrings define."""

import hashlib
import heapq
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivel.llm import clustering, hard_negatives, sharding

CLASH = "v key number part shard slot cluster distance rank label_ points ids size keep_0 asks".split()


def floored(v):
    return [int(np.floor(256 * float(x))) for x in v]


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(7, 6))
    x = np.float32(centres[r.integers(0, 7, 700)] + 0.3 * r.normal(size=(700, 6)))
    rows = [(i, [float(c) for c in v], int(i % 5)) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[3][1], 3) for i in range(350)]  # one vector, a third of all rows
    rows += [(50, rows[9][1], 0), (50, rows[9][1], 0), (None, rows[8][1], 1), (2000, None, 1), (2001, [], 1), (2002, [float("nan")] * 6, 1), (2003, [None] + [1.0] * 5, 1), (2004, [float("inf")] * 6, 1), (2050, [1.0] * 5, 1), (2051, [0.5] * 5, 1), (2052, [0.25] * 5, 2), (2100, [0.0] * 6, 1), (2101, [0.0] * 6, None), (2150, [-30000.0] * 6, 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in CLASH}).repartition(3)


def lloyd(rows, k, rounds):
    rows = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    x = [floored(v) for _, v in rows]
    centroids = [list(v) for v in x[:k]]
    away = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda: [min((away(v, c), j) for j, c in enumerate(centroids)) for v in x]
    for _ in range(rounds):
        of = [j for _, j in nearest()]
        for j in set(of):
            own = [v for v, i in zip(x, of, strict=True) if i == j]
            centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = nearest()
    inertia = [sum(d for d, i in found if i == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, inertia[j], sum(inertia), sha[j]) for (i, _), (d, j) in zip(rows, found, strict=True)]


@pytest.mark.parametrize("k", [1, 7, 40])
def test_clusters_are_those_of_a_full_comparison(vectors, k):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect() if r.embedding is not None and len(r.embedding) == 6 and None not in r.embedding and np.isfinite(r.embedding).all()]
    got = [tuple(r) for r in clustering.k_means(vectors, k, rounds=4, size=6).collect()]
    assert sorted(got, key=repr) == sorted(lloyd(rows, k, 4), key=repr)


def test_clusters_of_few_and_of_none(spark, vectors):
    few = vectors.where("vec_id IN (1, 2)")
    assert sorted(r.distance for r in clustering.k_means(few, 40, size=6).collect()) == [0, 0]
    assert clustering.k_means(vectors.limit(0), 40, size=6).count() == 0
    with pytest.raises(Exception, match="is beyond"):
        clustering.k_means(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), 1, size=1).collect()


def test_trees_prune():
    """On points in clusters most are assigned with whole nodes, and never otherwise than by a full comparison."""
    r = np.random.default_rng(1)
    centres = r.integers(-4000, 4000, (12, 4))
    points = centres[r.integers(0, 12, 4000)] + r.integers(-200, 200, (4000, 4))
    tree, order = clustering.Tree.build(points)
    assert (points[order] == tree.points).all() and (tree.sums[0] == points.sum(axis=0)).all()
    want = clustering.squared(tree.points, centres).argmin(axis=1)
    whole, got = 0, np.empty(4000, int)
    for begin, end, which, node in tree.assigned(centres):
        got[begin:end] = which
        whole += end - begin if node is not None else 0
    assert (got == want).all() and whole > 2000


def test_distances_beyond_exact_doubles():
    x = np.array([[1 << 25, -(1 << 25), 3], [0, 1, 2]])
    assert clustering.squared(x, x[:1]).tolist() == [[0], [(1 << 50) + ((1 << 25) + 1) ** 2 + 1]]


def by_hand(sizes, shards):
    """Karmarkar-Karp with sets of items."""
    heap = [(-s, i, [(s, (i,)), *[(0, ())] * (shards - 1)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = sorted(((s + t, u + v) for (s, u), (t, v) in zip(a, reversed(b), strict=True)), key=lambda x: -x[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], number, both))
        number += 1
    return heap[0][2]


def test_differencing():
    r = np.random.default_rng(0)
    for n, shards in ((1, 4), (2, 2), (9, 3), (300, 16), (5, 16)):
        sizes = (r.pareto(1.2, n) * 100).astype(np.int64) + 1
        sums = np.zeros((n, shards), np.int64)
        sums[:, 0] = sizes
        whole, went = sharding.differenced(sums)
        want = by_hand(sizes.tolist(), shards)
        assert whole.tolist() == [s for s, _ in want]
        assert [sizes[went[:, 0] == k].sum() for k in range(shards)] == whole.tolist()
        assert all(sorted(row) == list(range(shards)) for row in went.tolist())
    assert [s for s, _ in by_hand([8, 7, 6, 5, 4], 2)] == [16, 14]  # the known example: a difference of two


@pytest.mark.parametrize(("fan", "top"), [(5, 7), (40, 3), (2000, 500)])
def test_shards(spark, fan, top, monkeypatch):
    monkeypatch.setattr(sharding.balanced, "__defaults__", (fan, top))
    r = np.random.default_rng(fan)
    rows = [(i, "wörd " * int(n)) for i, n in enumerate((r.pareto(1.1, 300) * 20).astype(int))]
    rows += [(1000 + i, "the same text again") for i in range(150)] + [(7, None), (7, ""), (None, "x"), (None, None), (2000, "long " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH}).repartition(5)
    got = sharding.shard(docs, 8, keep=("text", "v")).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r.doc_id, r.text, r.size, r.text_crc32) for r in got), key=repr) == sorted(((i, t, size(t), zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    places, of, total = {}, {}, [0] * 8
    for x in got:
        places.setdefault(x.shard, []).append(x.slot)
        of.setdefault(x.text or "", set()).add(x.shard)
        total[x.shard] += x.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and all(len(s) == 1 for s in of.values())
    groups = {}
    for _, t in rows:
        groups[t or ""] = groups.get(t or "", 0) + size(t)
    largest = max(groups.values())
    rest = sorted(total)[:-1] if largest > sum(total) / 8 else total
    off = 0.005 if top == 500 else 0.02  # few tuples leave less to choose
    assert max(total) <= max(largest, (1 / 8 + off) * sum(total)) and max(rest) - min(rest) <= off * sum(total)
    again = sharding.shard(docs, 8).collect()
    assert sorted(total) == sorted(sum(x.size for x in again if x.shard == k) for k in range(8))


def test_shards_of_nothing(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def mined(rows):
    rows = [(i, floored(v), lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for k, (i, v, lab) in enumerate(rows):
        if i % 50:
            continue
        score = lambda x: sum(a * b for a, b in zip(v, x, strict=True))  # noqa: B023, E731
        others = [(-score(x), j, m) for n, (j, x, m) in enumerate(rows) if n != k and len(x) == len(v)]
        for p, j, _ in sorted(o for o in others if o[2] == lab)[:5]:
            hard = sorted(o for o in others if o[2] != lab and 50 * -p <= 100 * -o[0] <= 95 * -p)[:3]
            out += [(i, j, n + 1, o[1], -p, -o[0]) for n, o in enumerate(hard)]
    return out


@pytest.mark.parametrize("block_bytes", [200, 32 << 20])
def test_hard_negatives(vectors, block_bytes):
    want = mined([(r.vec_id, r.embedding, r.label) for r in vectors.collect()])
    got = [tuple(r) for r in hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, block_bytes=block_bytes).collect()]
    assert len(want) > 100 and sorted(got) == sorted(want)
    assert {r[0] for r in want} >= {50, 1050, 2050}


def test_hard_negatives_of_nothing_and_of_large_numbers(spark, vectors):
    asks = F.col("vec_id") % 50 == 0
    assert hard_negatives.hard_negatives(vectors.limit(0), asks).count() == 0
    assert hard_negatives.hard_negatives(vectors.where("vec_id = 50"), asks).count() == 0
    rows = [(0, [1e6, 3.0], 1), (1, [1e6, 2.0], 1), (2, [6e5, 1.0], 2), (3, [6e5, 1.0], 2), (4, [9.6e5, 1.0], 3)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), asks).collect()
    assert sorted(map(tuple, got)) == sorted(mined(rows)) and got
