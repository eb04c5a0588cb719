import hashlib
import random

import pytest

from relengine.llm.substring import remove_repeats


def slow(rows, window):
    """(doc_id, n_words, n_removed, kept) by the definition."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    low = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                low[key] = min(low.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and low[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, window):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    shared = [[rng.choice(vocabulary) for _ in range(window + rng.randrange(30))] for _ in range(4)]
    rows = []
    for d in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(3 * window))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = rng.choice(shared)
        rows.append((rng.randrange(50), " \n".join(text)))
    periodic = "a b c " * 200
    return [*rows, rows[3], (7, None), (8, ""), (9, " \t "), (None, rows[0][1]), (60, periodic), (61, "x " + periodic), (62, "z " * 300), (63, "z " * 80), (1, "é\xa0x y " * 40), (2, "é\xa0x y " * 40)]


@pytest.mark.parametrize("window,most", [(50, 500), (5, 500), (12, 3)])
def test_equals_brute_force(spark, window, most):
    rows = corpus(window, window)
    docs = spark.createDataFrame([(d, t, "s", d) for d, t in rows], "doc_id long, text string, kept string, row long").repartition(3)
    got = remove_repeats(spark, docs, window=window, most=most, carry=("kept", "row"))
    found = got.collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found], key=str) == slow(rows, window)
    assert all(r.c_kept == "s" and r.c_row == r.doc_id for r in found)
    texts = {t for _, t in rows}
    assert all(r.kept in texts if r.n_removed == 0 else hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found)


def test_a_bucket_of_many_strings(spark):
    """A passage of 12 words in 5,000 documents whose other words all differ: with windows of 10, one bucket has 5,000 strings."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(12)]
    rows = [(d, " ".join([f"a{rng.randrange(10**9)}", f"b{d}", *passage, f"c{d}", f"d{rng.randrange(10**9)}"])) for d in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(spark, docs, window=10).collect()), key=str)
    assert got == slow(rows, 10) and sum(r[2] for r in got) == 4999 * 12


def test_file_limits_of_the_session_do_not_matter(spark):
    rows = corpus(3, 5)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = remove_repeats(spark, docs, window=5).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == slow(rows, 5)


def test_empty(spark):
    assert remove_repeats(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
