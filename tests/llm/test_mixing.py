import random

from relengine.llm.mixing import mix, mixed_documents


def slow_targets(sizes, weights=(1, 2, 3), repeats=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > repeats * sizes[s]}
        if not full:
            return target | {s: w[s] * level for s in open_}
        for s in full:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def test_targets_and_cuts(spark):
    rng = random.Random(6)
    for shape in ([50, 3, 200, 1, 0, 90], [5], [1, 1000], [0, 0]):
        rows, n = [], 0
        for s, docs in zip([None, "b", "a", "é", "z", "Z"], shape):
            for _ in range(docs):
                rows.append((n, s, " ".join(["w"] * rng.randrange(20))))
                n += 1
        rows += [(n, "b", None), (n + 1, "b", ""), (n + 2, "b", " \t"), (None, "a", "x y"), (0, "a", "x y"), (0, "a", "x y")]
        docs = spark.createDataFrame([(*r, 3, "q") for r in rows], "doc_id long, source string, text string, size int, key string")
        got = mix(spark, docs).collect()
        again = mix(spark, docs.repartition(3)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and len(got) == len(rows)
        sizes = {}
        for _, s, t in rows:
            sizes[s] = sizes.get(s, 0) + len((t or "").split())
        want = slow_targets(sizes)
        taken = {}
        for r in got:
            assert 0 <= r.taken <= 3 * r.size
            assert any(abs(r.target - want[s]) < 1e-6 * (1 + want[s]) and r.source_size == sizes[s] for s in sizes)
            taken[(r.source_size, r.target)] = taken.get((r.source_size, r.target), 0) + r.taken
        assert abs(sum(taken.values()) - sum(want.values())) <= len(want)


def test_empty_and_documents(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "one two  three\nfour " * (1 + i % 5), 7) for i in range(80)], "doc_id long, source string, text string, n_chars long")
    assert mix(spark, docs.limit(0)).count() == 0 and mixed_documents(spark, docs.limit(0)).count() == 0
    shares = {r.doc_id: r for r in mix(spark, docs).collect()}
    words, out = {}, mixed_documents(spark, docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: r.taken for i, r in shares.items() if r.taken}
