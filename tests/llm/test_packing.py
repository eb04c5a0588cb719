import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from relengine.llm.common import Scratch
from relengine.llm.packing import matched, pack, ranges, sweep, tokenizer_path

TEXTS = [
    None, "", " \t\n", "a", "Hello, World's <|endoftext|> x", "naïve café ΑΣ ß İ 한국어   x\x1cy \x85 ́a", "word " * 9000, "x" * 30_000,
    "tab\tand\x0bvertical\x0cform\rreturn", "don't we'll THEY'RE 123 4,5 $$$ ###",
]


def test_ids_places_and_offsets(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate([*TEXTS, *TEXTS])] + [(None, "b", 1), (3, "a", 1)], "doc_id long, text string, length int")
    rows = [r.asDict() for r in pack(spark, docs, tokenizer=tokenizer_path(), capacity=512, keep_ids=True).collect()]
    tok, want = Tokenizer.from_file(tokenizer_path()), defaultdict(list)
    for i, t in [*enumerate([*TEXTS, *TEXTS]), (None, "b"), (3, "a")]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 512):
            raw = np.array(ids[k : k + 512], "<u4").tobytes()
            want[i].append((k // 512, k, len(raw) // 4, zlib.crc32(raw), raw))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    check_sequences(rows, 512)


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def row_by_row(counts, capacity):
    """How many sequences best fit opens, one document at a time, longest first."""
    gaps: list[int] = []
    for length in sorted((x for x, c in counts.items() for _ in range(c)), reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            gaps.append(capacity - length)
        else:
            gaps[gaps.index(fit)] -= length
    return len(gaps)


def placed(counts, runs, capacity):
    """The number of sequences of runs (length, rank, how many, each, sequence, offset), each document in one place."""
    rows = []
    for length, first, n, each, sequence, offset in runs:
        rows += [(length, first + r, sequence + r // each, offset + r % each * length) for r in range(n)]
    assert sorted(r[:2] for r in rows) == sorted((x, i) for x, c in counts.items() for i in range(c))
    return check_sequences([{"length": r[0], "sequence_id": r[2], "offset": r[3]} for r in rows], capacity)


def random_counts(rng, capacity):
    return {rng.randrange(1, capacity + 1): rng.randrange(1, 60) for _ in range(rng.randrange(1, 20))}


def test_rounds_are_as_tight_as_row_by_row():
    """The rounds without Spark: ranges swept apart, then what they carried on."""
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([1, 7, 40, 100])
        counts = random_counts(rng, capacity)
        docs, gaps, found, opened = [(x, 0, n) for x, n in counts.items()], [], [], 0
        for low, high in ranges(capacity):
            parts = rng.randrange(1, 9)
            here = lambda r: low < r[0] <= high  # noqa: B023, E731
            left_docs, left_gaps = [], []
            for i in range(parts):
                mine = lambda r: here(r) and (r[0] - low - 1) * parts // (high - low) == i  # noqa: B023, E731
                f, d, g, _ = sweep(list(filter(mine, docs)), list(filter(mine, gaps)), capacity)
                found, left_docs, left_gaps = found + f, left_docs + d, left_gaps + g
            f, d, g, opened = sweep(left_docs, left_gaps + [x for x in gaps if x[0] > high], capacity, opened)
            assert not d
            found, gaps, docs = found + f, g + [x for x in gaps if x[0] <= low], [x for x in docs if x[0] <= low]
        assert placed(counts, found, capacity) == opened == row_by_row(counts, capacity)


def test_rounds_in_spark(spark):
    rng = random.Random(3)
    for capacity in (100, 37):
        counts = random_counts(rng, capacity) | {capacity: 70, 1: 90}
        lengths = spark.createDataFrame(list(counts.items()), "length long, n long")
        rows = matched(lengths, Scratch(spark, "t"), capacity).collect()
        runs = [(r["size"], r["first"], r["n"], r["each"], r["sequence"], r["offset"]) for r in rows]
        assert placed(counts, runs, capacity) == row_by_row(counts, capacity)


def test_empty(spark):
    assert pack(spark, spark.createDataFrame([], "doc_id long, text string"), tokenizer=tokenizer_path()).count() == 0
