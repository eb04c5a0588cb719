"""Bulk-synchronous best-fit packing of tokenized documents into sequences.

Documents and gaps are tables of runs: so many of one size, by rank.  A round takes the documents of the next smaller sizes, sweeps
ranges of them and of the gaps apart, carries what is left to larger gaps and new sequences, and writes the gaps anew.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, prefix_before

MEMO = 300_000  # words whose ids a worker keeps
LONG = 256  # longer ones aren't kept


PLAIN = re.compile("[!-~\u00c0-\u024f]+")  # characters whose classes and lower case don't differ among libraries
END = b"\xff"  # marks a word's end; no UTF-8 text has this byte


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in kept)}


class PlainWords:
    """Ids of plain words by the merges of a lower-casing byte-level BPE file with word ends, without the library's cost per call.

    Ids of such files are in order of their merges, so the merge of least rank gives the least id; where a file is
    made otherwise, :meth:`of_file` gives None and the library does all.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.core = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.parts = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}  # of parts, which repeat oftener than words with signs at their ends

    @classmethod
    def of_file(cls, path: str) -> PlainWords | None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or not suffix or steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or cuts[1]["add_prefix_space"]:
            return None
        letters, special = byte_letters(), {t["content"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merges]
        if ids != sorted(set(ids)) or len(model["vocab"].keys() - special) != 512 + len(ids):
            return None
        coded = {(bytes(letters[c] for c in t.removesuffix(suffix)) + END * t.endswith(suffix)): i for t, i in model["vocab"].items() if t not in special}
        return cls(coded, cuts[0]["pattern"]["Regex"])

    def ids(self, word: str) -> bytes:
        word = word.lower() if word.isascii() else "".join(map(str.lower, word))
        return b"".join([self.known.get(p) or self.learn(p) for p in ([word] if word.isascii() and word.isalpha() else self.parts(word))])

    def learn(self, part: str) -> bytes:
        if len(self.known) >= MEMO:
            self.known.clear()
        ids = array("I", self.core.encode_single_piece(part.encode() + END)).tobytes()
        if len(part) <= LONG:
            self.known[part] = ids
        return ids


class WordIds(dict):
    """Ids of a word as little-endian unsigned 32-bit bytes, remembered; forgets all when full.

    The tokenizers that may be used drop white space and never join what it parts, so a text's ids are its words' ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.plain = Tokenizer.from_file(path), PlainWords.of_file(path)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        text = word.decode("utf-8", "surrogatepass")
        if self.plain is not None and PLAIN.fullmatch(text) and "<|" not in text:
            found = self.plain.ids(text)
        else:
            found = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONG:
            self[word] = found
        return found

    def forget(self) -> None:
        self.clear()
        if self.plain is not None:
            self.plain.known.clear()

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """A worker's tokenizer, which its next tasks use, too: reading its file takes as long as thousands of texts."""
    return WordIds(path)


def tokenized(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, key[, ids]) of at most ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):  # texts one at a time, as a batch may hold many bytes
                ids = words.of(text.as_py() or "") + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            arrays = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(arrays, names)
        words.forget()

    types, names = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if keep_ids else out.drop("ids")


Match = tuple[int, int, int, int, int, int]  # length, first rank, how many, pieces a sequence, first sequence, offset


def sweep(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int, opened: int | None = None) -> tuple[list[Match], list, list, int | None]:
    """Best fit of runs of documents (length, first rank, how many), longest first, into runs of gaps (size, first sequence, how many).

    Each document goes to its successor, the smallest gap that holds it.  Of those that want one run of gaps, the one of
    lowest rank gets the first sequence, which takes as many more of that length as it holds, and so on.  Documents without a successor
    open sequences from ``opened`` on, or are left over if that is None.  Returns the matches, documents and gaps left over, and ``opened``.
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # the keys of runs, ascending
    found: list[Match] = []
    left: list[tuple[int, int, int]] = []

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                insort(sizes, gap)
            runs[gap].append((first, n))

    for gap, first, n in sorted(gaps):
        put(gap, first, n)
    for length, rank, count in sorted(docs, key=lambda d: (-d[0], d[1])):
        while count:
            i = bisect_left(sizes, length)
            if i == len(sizes):
                if opened is None:
                    left.append((length, rank, count))
                    break
                gap, first, n = capacity, opened, -(-count // (capacity // length))
                opened += n
            else:
                gap = sizes[i]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], sizes[i]
            each = gap // length
            full = min(n, count // each)
            if full:
                found.append((length, rank, full * each, each, first, capacity - gap))
                put(gap - each * length, first, full)
                rank, count = rank + full * each, count - full * each
            if full < n and count:
                found.append((length, rank, count, count, first + full, capacity - gap))
                put(gap - count * length, first + full, 1)
                rank, count, full = rank + count, 0, full + 1
            put(gap, first + full, n - full)
    return found, left, [(g, f, n) for g, held in runs.items() for f, n in held], opened


DOC, GAP, NEXT, MATCH = range(4)
COLUMNS = ["kind", "size", "first", "n", "each", "sequence", "offset"]  # first: of a document its rank, of a gap its sequence
RUNS = ", ".join(f"{c} long" for c in COLUMNS)


def swept(g: pa.Table, capacity: int) -> pa.Table:
    """One range's runs, or all that ranges carried on; only the latter have a row NEXT, the number of sequences there are."""
    rows = list(zip(*(g.column(c).to_pylist() for c in COLUMNS)))
    of = lambda kind: [r[1:4] for r in rows if r[0] == kind]
    opened = next((r[2] for r in rows if r[0] == NEXT), None)
    found, docs, gaps, opened = sweep(of(DOC), of(GAP), capacity, opened)
    out = [r for r in rows if r[0] == MATCH]
    out += [(MATCH, length, rank, n, each, sequence, offset) for length, rank, n, each, sequence, offset in found]
    out += [(DOC, *d, 0, 0, 0) for d in docs] + [(GAP, *x, 0, 0, 0) for x in gaps]
    if opened is not None:
        out.append((NEXT, 0, opened, 0, 0, 0, 0))
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * len(COLUMNS), COLUMNS)


def ranges(capacity: int) -> list[tuple[int, int]]:
    """Sizes (over, up to) of each round, from the largest: a gap that takes a document of its range has a remainder below the range."""
    out, high = [], capacity
    while high:
        out.append((high // 2, high))
        high //= 2
    return out


def matched(lengths: DataFrame, scratch: Scratch, capacity: int, parts: int = 8) -> DataFrame:
    """MATCH runs that give each document of ``lengths`` (length, n) a place, by rounds; as many sequences as best fit row by row opens.

    A round takes the documents of one of :func:`ranges`, when all larger ones have places.
    1. Documents and gaps of the round's sizes are dealt to ``parts`` ranges of sizes, each swept by a task of its own.  That is exact: a
       document's successor is in its own range while that has a gap of its size or more, and remainders fall below the round's sizes.
    2. Documents that are left over meet the gaps left over in higher ranges, larger gaps, and new sequences.
    3. Matches and the gaps as they are now are written, and the next round begins.
    Tables of runs have a row for each length, and for each match, whose number grows with ``capacity`` and not with documents.
    """
    columns = lambda **kw: [kw.get(c, F.lit(0)).cast("long").alias(c) for c in COLUMNS]
    state = lengths.select(columns(kind=F.lit(DOC), size=F.col("length"), n=F.col("n")))
    state = state.union(lengths.sparkSession.range(1).select(columns(kind=F.lit(NEXT))))
    state = scratch.table(state, "round_0")
    there = {r["k"] for r in lengths.select(F.floor(F.log2(F.lit(capacity) / F.col("length"))).alias("k")).distinct().collect()}
    done = []
    for k, (low, high) in enumerate(ranges(capacity)):
        if not {k - 1, k, k + 1} & there:  # no document of these sizes, roundings included
            continue
        live = state.where(F.col("kind") != MATCH)
        here = (F.col("kind").isin(DOC, GAP)) & (F.col("size") > low) & (F.col("size") <= high)
        part = F.floor((F.col("size") - low - 1) * parts / (high - low)).cast("int")
        run = lambda g: swept(g, capacity)
        local = live.where(here).groupBy(part.alias("part")).applyInArrow(run, RUNS)
        above = live.where((F.col("kind") == NEXT) | (F.col("kind") == GAP) & (F.col("size") > high))
        carried = local.union(above).groupBy().applyInArrow(run, RUNS)
        below = live.where(F.col("kind").isin(DOC, GAP) & (F.col("size") <= low))
        state = scratch.table(carried.union(below), f"round_{k + 1}")
        done.append(state.where(F.col("kind") == MATCH))
    return reduce(DataFrame.union, done) if done else state.where(F.col("kind") == MATCH)


def pack(spark: SparkSession, docs: DataFrame, *, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False, bucket_rows: int = 100_000) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into as few sequences of at most ``capacity`` ids as best fit gives.

    A document is its ids by the tokenizer file, no special ones added, then ``end_id``; a longer one is cut into pieces of ``capacity``
    ids, the last may be shorter.  Pieces are counted by length, :func:`matched` gives runs of each length their places in
    bulk-synchronous rounds, and a piece takes the place of its rank among those of its length (a hash of its row orders
    them; ranks are prefix counts over ranges of the hash of about ``bucket_rows`` rows, so no length is in one task).

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (little-endian unsigned 32-bit, binary)
    if ``keep_ids``.  Null and empty texts are ``end_id`` alone; repeated rows are packed each; null doc_ids are kept;
    an empty table gives no rows; further columns are ignored.
    """
    scratch = Scratch(spark, "pack")
    pieces = tokenized(docs, tokenizer, capacity, end_id, keep_ids).withColumn("row", F.monotonically_increasing_id())
    pieces = scratch.table(pieces.withColumn("key", F.xxhash64("doc_id", "piece", "ids_crc32", "row")), "pieces")
    lengths = scratch.table(pieces.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    places = matched(lengths, scratch, capacity)
    # What is broadcast depends on the lengths, of which there are at most ``capacity``, and not on the rows.
    runs = places.groupBy(F.col("size").alias("length")).agg(F.array_sort(F.collect_list(F.struct("first", "each", "sequence", "offset"))).alias("runs"))
    buckets = max(64, math.ceil((lengths.agg(F.sum("n")).first()[0] or 0) / bucket_rows))
    pieces = pieces.select("*", F.pmod(F.shiftright("key", 20), F.lit(buckets)).cast("int").alias("bucket"), F.lit(1).cast("long").alias("one"))
    ranked = prefix_before(pieces, scratch, ["length"], "bucket", ["key", "row"], "one", "rank")
    placed = ranked.join(F.broadcast(runs), "length").withColumn("run", F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1))
    since = F.col("rank") - F.col("run.first")
    sequence = F.col("run.sequence") + F.floor(since / F.col("run.each"))
    offset = F.col("run.offset") + since % F.col("run.each") * F.col("length")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"), *(["ids"] if keep_ids else []))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 ids."""
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer=tokenizer_path())
