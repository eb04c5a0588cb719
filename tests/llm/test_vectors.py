import math
import random

import numpy as np
import pytest

from relengine.llm.embeddings import near_duplicates
from relengine.llm.topk import top_k

NAN, INF = float("nan"), float("inf")


def sound(e):
    return e is not None and all(x is not None and math.isfinite(x) for x in e)


def slow_links(rows, least=0.98):
    ok = [(i, v, e, n) for n, (i, e, v) in enumerate(rows) if i is not None and v is not None and sound(e) and any(e)]
    unit = {n: np.array(e, np.float64) / np.linalg.norm(np.array(e, np.float64)) for _, _, e, n in ok}
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for x in range(len(ok)):
        for y in range(x):
            a, b = ok[x], ok[y]
            if a[1] == b[1] and len(a[2]) == len(b[2]) and unit[a[3]] @ unit[b[3]] >= least:
                links[a[3]] += 1
                links[b[3]] += 1
                up[root(a[3])] = root(b[3])
    low = {}
    for n, (i, _, _) in enumerate(rows):
        if i is not None:
            low[root(n)] = min(low.get(root(n), i), i)
    return sorted([(i, links[n], low.get(root(n)), None if i is None else i == low[root(n)]) for n, (i, _, _) in enumerate(rows)], key=str)


def clustered(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    bases = rng.normal(size=(max(2, n // 12), dim))
    return [(int(i), (bases[rng.integers(len(bases))] + spread * rng.normal(size=dim)).astype(np.float32).tolist(), int(rng.integers(3))) for i in rng.permutation(n)]


ODD = [(None, [1.0, 2.0], 1), (5000, None, 1), (5001, [0.0, 0.0], 1), (5002, [NAN, 1.0], 1), (5003, [INF, 1.0], 1), (5004, [None, 1.0], 1), (5005, [1.0, 2.0], None), (5006, [1.0, 2.0], 1), (5006, [1.0, 2.0], 1), (5007, [], 1), (5008, [1e30, 2e30], 1), (5050, [1.0, 2.0, 3.0], 1)]


@pytest.mark.parametrize("cell_rows", [2000, 60])
def test_links_equal_brute_force(spark, cell_rows):
    rows = clustered(1, 700, 12, 0.12) + ODD
    df = spark.createDataFrame([(i, e, v, 1, 2) for i, e, v in rows], "vec_id long, embedding array<float>, label int, row int, component int")
    got = near_duplicates(spark, df, cell_rows=cell_rows, sample=400)
    rows = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], v) for i, e, v in rows]
    assert sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()], key=str) == slow_links(rows)
    assert near_duplicates(spark, df.limit(0)).count() == 0


def test_copies_are_dealt_once_and_tasks_are_bounded(spark, monkeypatch):
    from relengine.llm import embeddings

    tables = {}

    class Recorded(embeddings.Scratch):
        def table(self, df, name):
            tables[name] = super().table(df, name)
            return tables[name]

    monkeypatch.setattr(embeddings, "Scratch", Recorded)
    near = np.float64(np.float32(1 + 1e-3 * np.random.default_rng(8).normal(size=(300, 6))))
    near = np.concatenate([near, near + 1e-6, near - 1e-6, near * (1 + 1e-6)])[:1000]
    rows = [(i, [1.0, 2.0, -0.0 if i % 2 else 0.0], 1) for i in range(50_000)] + [(100_000 + i, e, 2) for i, e in enumerate(near.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark, df, cell_rows=50, sample=400, most_cells=1).collect()}
    assert got == {i: (49_999, 0) for i in range(50_000)} | {100_000 + i: (999, 100_000) for i in range(1000)}
    assert tables["dealt"].where("label = '3:1'").count() == 1
    pairs = embeddings.paired_blocks(tables["dealt"], tables["blocks"]).groupBy("label", "cell", "one", "other").count()
    sizes = [r["count"] for r in pairs.collect()]
    assert len(sizes) == 20 * 21 // 2 + 1 and max(sizes) < 200  # twenty blocks of about 50 rows, two in a task


def slow_top(rows, k, every, scale=256):
    good = [(i, [math.floor(float(x) * scale) for x in e]) for i, e, _ in rows if i is not None and sound(e) and e]
    out = []
    for i, q in {(i, tuple(e)) for i, e in good if i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(q, e)), j) for j, e in good if j != i and len(e) == len(q))[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("bucket_rows", [16_384, 40])
def test_top_k_equals_brute_force(spark, bucket_rows):
    rng = random.Random(3)
    rows = clustered(2, 400, 10, 0.3) + [(1000 + i, [float(rng.randrange(3)) for _ in range(10)], 0) for i in range(200)] + [x for x in ODD if x[0] != 5008]
    df = spark.createDataFrame([(i, e, "r") for i, e, _ in rows], "vec_id long, embedding array<float>, rank string")
    got = top_k(spark, df, k=5, every=25, bucket_rows=bucket_rows, query_rows=7)
    rows = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], v) for i, e, v in rows]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == slow_top(rows, 5, 25)
    assert top_k(spark, df.limit(0)).count() == 0


def test_top_k_of_many_widths_and_of_long_vectors(spark):
    rng = random.Random(6)
    big = [(i, [float(rng.randrange(-(2**22), 2**22)) for _ in range(3)], 0) for i in range(40)]
    big += [(50, [2.0**23, 1.0, 1.0], 0), (51, [2.0**23, 1.0, 2.0], 0), (52, [1.0, 2.0, 3.0], 0), (54, [0.5, 0.25, 3.0], 0)]
    df = spark.createDataFrame([(i, e) for i, e, _ in big], "vec_id long, embedding array<double>")
    got = top_k(spark, df, k=5, every=4, bucket_rows=9, query_rows=4)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == slow_top(big, 5, 4)
    wide = [(10 * w + j, [float(rng.randrange(3)) for _ in range(w)], 0) for w in range(1, 1041) for j in (0, 5)]
    df = spark.createDataFrame([(i, e) for i, e, _ in wide[-200:] + wide[:1900]], "vec_id long, embedding array<double>")
    got = top_k(spark, df.distinct(), k=1, every=10)
    scores = {i: sum(int(a * 256) * int(b * 256) for a, b in zip(e, wide[n + 1][1])) for n, (i, e, _) in enumerate(wide) if i % 10 == 0}
    assert {r.query_id: (r.vec_id, r.score) for r in got.collect()} == {i: (i + 5, s) for i, s in scores.items()}
