"""SimHash near-duplicates: fingerprints of word shingles, and a binary trie self-join on Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, by_place, components, lean

BITS = 64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text: a bit is 1 if it is set in over half the XXH64 hashes of the shingles, repeats included."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    take = max(1, n - shingle + 1)
    first, last = starts[:take].tolist(), (ends[min(shingle, n) - 1 :] - 1).tolist()
    counts = np.zeros(BITS, np.int64)
    for k in range(0, take, 65536):  # bounded memory for very long texts
        raw = b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(first[k : k + 65536], last[k : k + 65536])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > take).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long, tie long): a fingerprint per row; null and empty texts have 0.  ``tie`` is another hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64)), b.column("tie")], ["doc_id", "fp", "tie"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tie")).mapInArrow(lean(run), "doc_id long, fp long, tie long")


class Forest:
    """Union-find on positions 0..n-1; the root of a set is its least position."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if np.array_equal(nxt, self.up):
                return nxt
            self.up = nxt

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            r = self.roots()
            ra, rb = r[a], r[b]
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            keep = hi != lo
            a, b = a[keep], b[keep]
            np.minimum.at(self.up, hi[keep], lo[keep])


def trie_links(values: np.ndarray, budget: int, forest: Forest, most: int = 1 << 19, cross: np.ndarray | None = None) -> None:
    """Link in ``forest`` all positions of the sorted, distinct uint64 ``values`` at Hamming distance ``budget`` or less.

    A node of the binary trie is a range of ``values`` with a common prefix.  Pairs of nodes descend together,
    adding up the bits in which their prefixes differ; a pair over ``budget`` is dropped with all below it.  Pairs
    whose rest can't exceed the budget, and pairs of leaves, are links.  A pair of nodes that already lie in one
    component is dropped too: it can't change the outcome.  At most about ``most`` pairs are held at a time per level.
    """
    n = len(values)
    if n < 2:
        return
    ones = [np.concatenate(([0], np.cumsum((values >> np.uint64(BITS - 1 - d)) & np.uint64(1), dtype=np.int64))) for d in range(BITS)]
    one = np.zeros(1, np.int64)
    stack = [(0, one, one + n, one, one + n, one)]
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        if len(al) > most:
            h = len(al) // 2
            stack += [(d, *(x[:h] for x in (al, ah, bl, bh, err))), (d, *(x[h:] for x in (al, ah, bl, bh, err)))]
            continue
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            a, b = al[leaf], bl[leaf]
            near = (a != b) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
            forest.link(a[near], b[near])
            rest = ~leaf
            al, ah, bl, bh, err = al[rest], ah[rest], bl[rest], bh[rest], err[rest]
        if d == BITS or not len(al):
            continue
        if len(al) > 4096:  # a wide level: leave out pairs within one component
            r = forest.roots()
            change = np.concatenate(([0], np.cumsum(r[1:] != r[:-1])))
            same = (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl]) & (r[al] == r[bl])
            if same.any():
                rest = ~same
                al, ah, bl, bh, err = al[rest], ah[rest], bl[rest], bh[rest], err[rest]
        c = ones[d]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])  # where the ones of this bit begin
        equal = (al == bl) & (ah == bh)
        parts = []
        for x0, x1, y0, y1, more, ok in ((al, am, bl, bm, 0, None), (am, ah, bm, bh, 0, None), (al, am, bm, bh, 1, None), (am, ah, bl, bm, 1, ~equal)):
            keep = (x1 > x0) & (y1 > y0) & (err + more <= budget)
            keep &= ~((x1 - x0 == 1) & (x0 == y0) & (y1 == x1))
            if ok is not None:
                keep &= ok
            parts.append((x0[keep], x1[keep], y0[keep], y1[keep], err[keep] + more))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*parts))))


def span_masks(n: int, budget: int, block: int) -> list[int]:
    """Masks, as signed longs, of the choices of spans on which ``n`` fingerprints are grouped: those that deal a row to the fewest blocks."""

    def dealt(spans: int) -> int:
        return comb(spans, budget) * max(1, -(-(n >> (BITS * (spans - budget) // spans)) // block))

    spans = min(range(budget + 1, budget + 5), key=dealt)
    cuts = [round(i * BITS / spans) for i in range(spans + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(one, spans - budget))]


def hamming_links(fps: DataFrame, scratch: Scratch, budget: int = 4, block: int = 4096) -> DataFrame:
    """Links (src, dst) that connect just what pairs of distinct fingerprints at ``budget`` bits or fewer connect.

    Of any number of spans of bits, a pair within the budget agrees on all but ``budget`` at least, so the trie over all
    fingerprints falls into subtries, one for each choice of the other spans and their value, which are joined with themselves apart.
    The number of spans grows with the table, so that subtries stay small and rows aren't dealt to ever more blocks.  Exact copies were counted once before (``fps`` is distinct).
    A subtrie of over ``block`` fingerprints is cut into blocks and every two blocks are joined, so that no task holds more
    than two.  Each task returns a spanning forest of its links, not all pairs.
    """
    masks = span_masks(fps.count(), budget, block)
    spans = F.array(*[F.struct(F.lit(i).alias("span"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(spans).alias("s")).select("fp", "s.span", "s.value")
    sizes = rows.groupBy("span", "value").count()
    large = scratch.table(sizes.where(F.col("count") > block).select("span", "value", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large")
    rows = rows.join(large, ["span", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own)
    rows = rows.select("fp", "span", "value", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("fp", F.xxhash64("span", "value", F.least("own", "other"), F.greatest("own", "other")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; all rows of one key are joined at once."""

        def groups() -> Iterator[np.ndarray]:
            key, held = None, []
            for b in batches:
                k, v = b.column("key").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False)
                at = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
                for x, y in zip(at, at[1:]):
                    if x == y:
                        continue
                    if k[x] != key and held:
                        yield np.concatenate(held)
                        held = []
                    key = k[x]
                    held.append(v[x:y])
            if held:
                yield np.concatenate(held)

        src, dst, held = [], [], 0
        for g in groups():
            v = np.unique(g.view(np.uint64))
            if len(v) < 2:
                continue
            forest = Forest(len(v))
            if len(v) == 2:
                if int(v[0] ^ v[1]).bit_count() <= budget:
                    forest.up[1] = 0
            else:
                trie_links(v, budget, forest)
            r = forest.roots()
            linked = np.flatnonzero(r != np.arange(len(v)))
            if len(linked):
                src.append(v[linked].view(np.int64))
                dst.append(v[r[linked]].view(np.int64))
                held += len(linked)
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])
                src, dst, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lean(run), "src long, dst long")


def _groups(spark: SparkSession, docs: DataFrame, shingle: int, seed: int, budget: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, fp, tie), and (fp, least, component) with a row per distinct fingerprint; ``least`` is its least doc_id."""
    rows = scratch.table(fingerprints(docs, shingle, seed), "rows")
    fps = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    links = scratch.table(hamming_links(fps.select("fp"), scratch, budget), "links")
    cc = components(links, scratch)
    named = fps.join(cc, fps.fp == cc.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    return rows, scratch.table(named, "named")


def near_duplicates(spark: SparkSession, docs: DataFrame, *, shingle: int = 4, seed: int = 42, budget: int = 4) -> DataFrame:
    """Groups of documents linked by fingerprints that differ in ``budget`` bits or fewer.

    Returns a row per row of ``docs`` (doc_id, text): doc_id, fp, component_id (the smallest doc_id reachable by links,
    the row's own included).  Null, empty and blank texts have fingerprint 0 and are linked like any other; texts of
    fewer words than a shingle are one shingle; rows of null doc_id belong to a group but never name it (a group of
    such rows only has a null component_id); an empty table gives no rows; further columns are ignored.
    """
    scratch = Scratch(spark, "simhash")
    rows, named = _groups(spark, docs, shingle, seed, budget, scratch)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # (fp, component_id) has a row per distinct fingerprint; joined to all rows last.
    ids = scratch.table(named.join(least, "component").select(F.col("fp").alias("_fp"), "component_id"), "ids")
    return rows.join(ids, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, *, shingle: int = 4, seed: int = 42, budget: int = 4) -> DataFrame:
    """One row of ``docs`` for each group of :func:`near_duplicates`, with all columns.

    It is the row of least doc_id; null ids come last, so a group of such rows keeps one, too.  Of rows of that doc_id, the one of
    the least hash of its text stays, and of those, the least by all columns (nulls first), so reruns agree; a column of a type without
    order isn't looked at.  Columns may have any names.  An empty table gives no rows.
    """
    scratch = Scratch(spark, "simhash_one")
    plain, name = by_place(docs)
    doc_id, text = F.col(name["doc_id"]).cast("long"), F.col(name["text"]).cast("string")
    rows, named = _groups(spark, plain.select(doc_id.alias("doc_id"), text.alias("text")), shingle, seed, budget, scratch)
    of = named.select(F.col("fp").alias("_fp"), "component")
    first = rows.join(of, F.col("fp") == F.col("_fp")).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("w"))
    first = scratch.table(first.select(F.coalesce("w.doc_id", F.lit(0)).alias("w_id"), F.col("w.none").alias("w_none"), F.col("w.tie").alias("w_tie")), "first")
    keyed = plain.select("*", F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"), F.xxhash64(text).alias("tie"))
    kept = keyed.join(first, (F.col("id") == F.col("w_id")) & (F.col("none") == F.col("w_none")) & (F.col("tie") == F.col("w_tie")), "left_semi")
    ordered = [c for c, t in plain.dtypes if not t.startswith(("map", "variant")) and "map<" not in t]
    by = Window.partitionBy("id", "none", "tie").orderBy(*ordered)
    return kept.withColumn("nth", F.row_number().over(by)).where("nth = 1").select(*plain.columns).toDF(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by 4-word shingles, linked at 4 differing bits or fewer."""
    found = near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
