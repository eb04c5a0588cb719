"""Substring dedup: windows of words found again, by super-k-mers dealt to their minimiser's bucket."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Scratch, lean
from .warc import open_fs

MINIMISER = 8  # words of a minimiser
LEVELS = 5  # of splitting a large bucket: by minimisers of 16, 24, 32 and 40 words, then window by window
CHUNK = 2 << 20  # bytes of text that are cut into windows at a time
MEMO = 150_000  # words whose hashes a worker keeps


class WordHashes(dict):
    """Hash of a word, remembered; forgets all when full, which changes nothing but speed."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= MEMO:
            self.clear()
        h = xxh3_64_intdigest(word, 7)
        if len(word) <= 256:
            self[word] = h
        return h


def minimisers(h: np.ndarray, window: int, size: int = MINIMISER) -> np.ndarray:
    """For each window of ``window`` word hashes, the least hash of the groups of ``size`` words in it (of all its words, if it has fewer)."""
    m = min(size, window)
    g = np.zeros(len(h) - m + 1, np.uint64)
    for j in range(m):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(g)]
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(32)
    w, span = window - m + 1, 1
    while 2 * span <= w:  # least of 1, 2, 4 ... neighbours
        g = np.minimum(g[:-span], g[span:])
        span *= 2
    rest = w - span
    return np.minimum(g[: len(g) - rest], g[rest:]) if rest else g


def super_kmers(rows: list[tuple[int, int, bytes]], window: int, hashes: WordHashes, longest: int = 128) -> Iterator[tuple]:
    """(row, doc_id, start, n windows, minimiser, digest of the words' packed string) of each run of windows with one minimiser.

    ``rows``: (row, doc_id, text).  A run is cut after ``longest`` windows, so that a packed string stays short.
    """
    from xxhash import xxh3_128_digest

    for row, doc, text in rows:
        words = text.split()
        n = len(words) - window + 1
        if n < 1:
            continue
        low = minimisers(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), window)
        at = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1, [n])).tolist()
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        packed = b" ".join(words)
        for a, b in zip(at, at[1:]):
            for s in range(a, b, longest):
                e = min(b, s + longest)
                string = packed[(ends[s - 1] + 1 if s else 0) : ends[e + window - 2]]
                yield row, doc, s, e - s, int(low[a]), xxh3_128_digest(string)


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        cols = ([], [], [], [], [], [])
        rows = ((r.as_py(), d.as_py(), t.as_py().encode("utf-8", "surrogatepass")) for r, d, t in zip(b.column("row"), b.column("doc_id"), b.column("text")))
        for x in super_kmers(rows, window, hashes):
            for c, v in zip(cols, x):
                c.append(v)
            if len(cols[0]) >= 50_000:
                yield _slim(cols)
                cols = ([], [], [], [], [], [])
        if cols[0]:
            yield _slim(cols)


def _slim(cols) -> pa.RecordBatch:
    row, doc, start, n, low, digest = cols
    s = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
    arrays = [pa.array(row, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(np.array(low, np.uint64).view(np.int64)), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy())]
    return pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "start", "n", "low", "s1", "s2"])


def _texts(path: str, more: tuple[str, ...] = ()) -> Iterator[tuple]:
    """(row, doc_id, text, *more) of a staged file, in order of row."""
    fs, name = open_fs(path)
    with fs.open_input_file(name) as f:
        for b in pq.ParquetFile(f).iter_batches(batch_size=64, columns=(names := ["row", "doc_id", "text", *more])):
            yield from zip(*(b.column(n).to_pylist() for n in names))


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple]:
    """Rows as tuples, grouped by a sorted column: (value, iterator of rows)."""
    from itertools import groupby
    from operator import itemgetter

    head = next(batches, None)
    if head is None:
        return
    at = head.schema.names.index(key)

    def all_rows():
        yield from zip(*(c.to_pylist() for c in head.columns))
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    yield from groupby(all_rows(), itemgetter(at))


def _fetch(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Packed strings of super-k-mers: rows (path, row, start, n, low, s1, s2, doc_min) sorted by path and row."""
    out, held = [], 0
    for path, group in _runs(batches, "path"):
        texts, words, current = _texts(path), [], None
        for _, row, start, n, low, s1, s2, least in group:
            if row != current:
                text = next((t for r, _, t in texts if r == row), None)
                if text is None:
                    raise ValueError(f"{path}: no row {row}")
                current, words = row, text.encode("utf-8", "surrogatepass").split()
            string = b" ".join(words[start : start + n + window - 1])
            out.append((low, s1, s2, least, string))
            held += len(string)
            if held > 4 << 20:
                yield _packed(out)
                out, held = [], 0
    if out:
        yield _packed(out)


def _packed(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["low", "s1", "s2", "least", "string"])


def least_by_window(strings: list[bytes], least: list[int], window: int) -> list[list[int]]:
    """For each packed string and window in it, the least of ``least`` over all strings that hold that window.

    Windows are sorted by their words; equal neighbours are one window.  Words become numbers of the bucket first.
    """
    ids: dict[bytes, int] = {}
    coded = [np.fromiter((ids.setdefault(w, len(ids)) for w in s.split()), np.int32) for s in strings]
    views = [np.lib.stride_tricks.sliding_window_view(c, window) for c in coded]
    sizes = [len(v) for v in views]
    every = np.ascontiguousarray(np.concatenate(views))
    keys = every.view(np.dtype((np.void, every.dtype.itemsize * window))).ravel()
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    docs = np.repeat(np.array(least, np.int64), sizes)[order]
    low = np.minimum.reduceat(docs, np.flatnonzero(new))[np.cumsum(new) - 1]
    back = np.empty_like(low)
    back[order] = low
    return [x.tolist() for x in np.split(back, np.cumsum(sizes)[:-1])]


def _buckets(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    out = []
    for _, group in _runs(batches, "low"):
        rows = list(group)  # a bucket's packed strings, of which there are at most ``most``
        found = least_by_window([r[4] for r in rows], [r[3] for r in rows], window)
        out += [(r[1], r[2], lows) for r, lows in zip(rows, found) if any(x != r[3] for x in lows)]
        if len(out) >= 2000:
            yield _lows(out)
            out = []
    if out:
        yield _lows(out)


def _lows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["s1", "s2", "lows"])


def _split(batches: Iterator[pa.RecordBatch], window: int, level: int) -> Iterator[pa.RecordBatch]:
    """Packed strings of large buckets cut again: rows (p1, p2, at, n, low, s1, s2, least, string), by the string they were in.

    Windows of one bucket that have the same minimiser of more words than before stay together as one string of a smaller
    bucket; at the last level, each window is a string and a bucket of its own.
    """
    from xxhash import xxh3_128_digest

    hashes, size = WordHashes(), MINIMISER * (level + 1)
    names, types = ["p1", "p2", "at", "n", "low", "s1", "s2", "least", "string"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for b in batches:
        out = []
        for low, p1, p2, least, string in zip(*(c.to_pylist() for c in b.columns)):
            words = string.split()
            n = len(words) - window + 1
            second = minimisers(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), window, size)
            cuts = range(1, n) if level == LEVELS else (np.flatnonzero(second[1:] != second[:-1]) + 1).tolist()
            for x, y in zip([0, *cuts], [*cuts, n]):
                part = b" ".join(words[x : y + window - 1])
                s1, s2 = np.frombuffer(xxh3_128_digest(part), np.int64).tolist()
                bucket = s1 if level == LEVELS else np.frombuffer(xxh3_128_digest(low.to_bytes(8, "little", signed=True) + second[x].tobytes()), np.int64)[0].item()
                out.append((p1, p2, x, y - x, bucket, s1, s2, least, part))
        for i in range(0, len(out), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 5000]), types)], names)


def lows_of_strings(strings: DataFrame, scratch: Scratch, window: int, most: int, level: int = 1) -> DataFrame:
    """(s1, s2, lows) of packed ``strings`` (low, s1, s2, least, string): for each window, the least doc_id of all strings that hold it.

    Strings whose windows all have the string's own ``least`` may be left out.  Buckets are sorted whole; one of over ``most``
    strings is split by longer and longer minimisers before, which leaves equal windows in one bucket, and equal strings are one again.
    """
    large = scratch.table(strings.groupBy("low").agg(F.count("*").alias("n")).where(F.col("n") > most).select("low"), f"large_{level}")
    plain = strings.join(large, "low", "left_anti").repartition("low").sortWithinPartitions("low")
    found = plain.mapInArrow(lean(lambda b: _buckets(b, window)), "s1 long, s2 long, lows array<long>")
    if large.isEmpty():
        return found
    found = scratch.table(found, f"found_{level}")
    cut = strings.join(large, "low", "left_semi").mapInArrow(lean(lambda b: _split(b, window, level)), "p1 long, p2 long, at int, n int, low long, s1 long, s2 long, least long, string binary")
    cut = scratch.table(cut, f"cut_{level}")
    parts = cut.groupBy("s1", "s2").agg(F.min("least").alias("least"), F.min("low").alias("low"), F.min("string").alias("string"))
    parts = scratch.table(parts.select("low", "s1", "s2", "least", "string"), f"strings_{level}")
    own = parts.select("s1", "s2", "least").join(lows_of_strings(parts, scratch, window, most, level + 1), ["s1", "s2"], "left")
    own = scratch.table(own, f"solved_{level}")
    back = cut.select("p1", "p2", "at", "n", "s1", "s2").join(own, ["s1", "s2"])
    back = back.select("p1", "p2", F.struct("at", F.coalesce("lows", F.array_repeat("least", F.col("n"))).alias("lows")).alias("x"))
    back = back.groupBy(F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["lows"])).alias("lows"))
    back = scratch.table(found.union(back), f"lows_{level}")
    scratch.drop(f"large_{level}", f"found_{level}", f"cut_{level}", f"strings_{level}", f"solved_{level}")
    return back


def kept_words(words: list[bytes], starts: list[int], window: int) -> tuple[list[bytes], int]:
    """Words outside the windows that begin at ``starts``, and how many were inside."""
    if not starts:
        return words, 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.array(starts) + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return [w for w, c in zip(words, covered.tolist()) if not c], int(covered.sum())


def _remove(batches: Iterator[pa.RecordBatch], window: int, more: tuple[str, ...], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """All rows of each staged file, as ``schema``.  Input rows (path, row, start, at) are sorted by path and row; row null: the file itself."""
    out, held = [], 0
    for path, group in _runs(batches, "path"):
        group = iter(group)
        nxt = next(group, None)
        while nxt is not None and nxt[1] is None:
            nxt = next(group, None)
        for row, doc, text, *carried in _texts(path, more):
            starts: list[int] = []
            while nxt is not None and nxt[1] == row:
                starts += [nxt[2] + i for i in nxt[3]]
                nxt = next(group, None)
            words = (text or "").encode("utf-8", "surrogatepass").split()
            kept, gone = kept_words(words, starts, window)
            string = b" ".join(kept)
            out.append((doc, len(words), gone, hashlib.sha256(string).hexdigest(), text if not gone else string.decode("utf-8", "surrogatepass"), *carried))
            held += len(text or "")
            if held > 4 << 20 or len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def remove_repeats(spark: SparkSession, docs: DataFrame, *, window: int = 50, most: int = 200, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove words covered by a window of ``window`` words that also starts in a document of smaller doc_id.

    1. Texts are cut into super-k-mers: runs of windows whose least group of MINIMISER words is the same.  Only their
       place, minimiser and a 128-bit digest are written at first.
    2. Minimisers seen in one document alone can't share a window, and drop out.  Of super-k-mers with equal words
       one stands for all, with the least doc_id.
    3. Where a minimiser has several of these, each travels to its bucket as one packed string; there, windows are
       sorted and equal ones get their least doc_id.  A bucket of over ``most`` strings is split by longer minimisers
       before (:func:`lows_of_strings`).
    4. Places are joined to what was found (adaptive execution may split hot ones), and each file of texts is read
       once more with its places; texts themselves are never shuffled.

    Returns a row per input row: doc_id, n_words, n_removed, kept_sha256, kept (the text; unchanged where nothing was
    removed, else its kept words joined by one space), and columns named in ``carry``, of plain types, as ``c_`` + name.  Null texts have no words and a null
    ``kept``; rows of null doc_id neither lose words nor make others lose them; rows of equal doc_id don't affect each
    other; an empty table gives no rows; further columns are ignored.  A staged text that isn't found again raises an error.
    """
    scratch = Scratch(spark, "substring")
    staged = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(c).alias(f"c_{c}") for c in carry])
    staged = scratch.table(staged, "docs")
    files = scratch.table(staged.select(F.shiftright("row", 33).alias("file"), F.col("_metadata.file_path").alias("path")).distinct(), "files")
    texts = staged.where("doc_id is not null and text is not null").select("row", "doc_id", "text")
    t = scratch.table(texts.mapInArrow(lean(lambda b: _cut(b, window)), "row long, doc_id long, start int, n int, low long, s1 long, s2 long"), "kmers")
    seen = t.groupBy("low").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("low")
    t = scratch.table(t.join(seen, "low", "left_semi"), "shared")
    scratch.drop("kmers")
    reps = t.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "row", "start", "n", "low")).alias("r"))
    reps = scratch.table(reps.select("s1", "s2", F.col("r.doc_id").alias("least"), "r.row", "r.start", "r.n", "r.low"), "reps")
    several = scratch.table(reps.groupBy("low").agg(F.count("*").alias("strings"), F.min("least").alias("a"), F.max("least").alias("z")).where("strings > 1 and a < z").select("low"), "several")
    asked = reps.join(several, "low").withColumn("file", F.shiftright("row", 33)).join(files, "file")
    asked = asked.select("path", "row", "start", "n", "low", "s1", "s2", "least").repartition("path").sortWithinPartitions("path", "row")
    strings = scratch.table(asked.mapInArrow(lean(lambda b: _fetch(b, window)), "low long, s1 long, s2 long, least long, string binary"), "strings")
    found = scratch.table(lows_of_strings(strings, scratch, window, most), "found")
    reps = scratch.table(reps.select("s1", "s2", "least").join(found, ["s1", "s2"], "left"), "result")
    scratch.drop("several", "strings", "found", "lows_1", "large_1", "reps")
    every = F.sequence(F.lit(0), F.col("n") - 1)
    at = F.when(F.col("lows").isNull(), every).otherwise(F.filter(every, lambda i: F.get("lows", i) < F.col("doc_id")))
    hits = t.join(reps, ["s1", "s2"]).where(F.col("lows").isNotNull() | (F.col("least") < F.col("doc_id")))
    hits = hits.select(F.shiftright("row", 33).alias("file"), "row", "start", at.alias("at")).where(F.size("at") > 0)
    hits = hits.join(files, "file").select("path", "row", "start", "at")
    hits = hits.union(files.select("path", F.lit(None).cast("long"), F.lit(0), F.array().cast("array<int>")))
    hits = hits.repartition("path").sortWithinPartitions("path", "row", "start")
    more = tuple(f"c_{c}" for c in carry)
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    schema = StructType([*schema.fields, *staged.select(*more).schema.fields])
    arrow = to_arrow_schema(schema)
    return hits.mapInArrow(lean(lambda b: _remove(b, window, more, arrow)), schema)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
low AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN low USING (h) WHERE doc_id > least),
gone AS (SELECT doc_id, list(j) AS js FROM hit GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d WHERE doc_id IN (SELECT doc_id FROM gone)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN js IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept.text, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, without words covered by 50-word windows that a document of smaller doc_id has."""
    found = remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
