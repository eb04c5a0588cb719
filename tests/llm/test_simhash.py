import random

import pytest

import numpy as np
from xxhash import xxh64_intdigest

from relengine.llm.simhash import Forest, fingerprint, near_duplicates, trie_links


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(values, budget=4):
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_fingerprint_equals_the_plain_one():
    texts = [None, "", " \n", "one", "Two Words", "a b c", "a b c d", "A\tb\x0bc  d e f É", "x y z w " * 50, " ".join(map(str, range(70_000)))]
    for t in texts[:-1]:
        assert fingerprint(t) == slow_fingerprint(t)
    assert fingerprint(texts[-1]) == slow_fingerprint(texts[-1])


def test_trie_equals_all_pairs():
    rng = random.Random(3)
    for n in (2, 3, 40, 400):
        base = [rng.getrandbits(64) for _ in range(max(1, n // 8))]
        values = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for b in base for _ in range(8)} | {0, (1 << 64) - 1}
        values = sorted(values)
        f = Forest(len(values))
        trie_links(np.array(values, np.uint64), 4, f, most=64)
        assert f.roots().tolist() == slow_components(values)


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(60)]
    rows = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.randrange(30, 300))]
        rows.append(" ".join(t))
        for _ in range(rng.randrange(3)):
            u = list(t)
            u[rng.randrange(len(u))] = rng.choice(words)
            rows.append(" ".join(u))
    rows += [None, "", "  ", rows[0], rows[0]]
    data = [(1000 - i, t, "x", i) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string, component_id string, fp long")  # clashing names
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in near_duplicates(spark, docs).collect()}
    ids, fps = [d[0] for d in data], [slow_fingerprint(d[1]) for d in data]
    group = slow_components(fps)
    least = {}
    for i, g in zip(ids, group):
        least[g] = min(least.get(g, i), i)
    assert got == {i: (f, least[g]) for i, f, g in zip(ids, fps, group)}


def test_hot_group_is_cut_into_blocks(spark, monkeypatch):
    from relengine.llm import simhash
    from relengine.llm.common import Scratch, components

    rng = random.Random(1)
    base = rng.getrandbits(62)
    values = sorted({base ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for _ in range(300)})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    s = Scratch(spark, "t")
    links = simhash.hamming_links(fps, s, 4, block=40)
    cc = {r.node: r.component for r in components(links, s).collect()}
    want = slow_components(values)
    assert cc == {v: values[w] for v, w in zip(values, want) if want.count(w) > 1}


def test_spans_grow_with_the_table(spark):
    from relengine.llm import simhash

    for n, choices, bits in ((10, 5, 12), (10**7, 5, 12), (10**10, 15, 21), (10**13, 70, 32)):
        masks = [m & (1 << 64) - 1 for m in simhash.span_masks(n, 4, 4096)]
        assert len(masks) == choices and all(bits - 2 <= m.bit_count() <= bits + 2 for m in masks)
        rng = random.Random(n)
        for _ in range(200):
            differ = sum({1 << rng.randrange(64) for _ in range(4)})
            assert any(m & differ == 0 for m in masks)


@pytest.mark.parametrize("spans", [6, 8])
def test_more_spans_find_the_same(spark, monkeypatch, spans):
    from relengine.llm import simhash
    from relengine.llm.common import Scratch, components

    monkeypatch.setattr(simhash, "span_masks", lambda n, budget, block, real=simhash.span_masks: real({6: 10**10, 8: 10**13}[spans], budget, 4096))
    rng = random.Random(spans)
    values = []
    for _ in range(40):
        v = rng.getrandbits(64)
        values += [v, v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)), v ^ sum(1 << b for b in rng.sample(range(64), 5))]
    values = sorted(set(values))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    s = Scratch(spark, "t")
    cc = {r.node & (1 << 64) - 1: r.component for r in components(simhash.hamming_links(spark.createDataFrame(signed, "fp long"), s, 4), s).collect()}
    want = slow_components(values)
    groups = {}
    for v, c in cc.items():
        groups.setdefault(c, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(v for v, w in zip(values, want) if w == g) for g in set(want) if want.count(g) > 1)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(spark, empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "q r s t u v"), (4, "a b c d e")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in near_duplicates(spark, docs).collect()), key=str) == [(4, 4), (None, 4), (None, None)]
