"""Embedding near-duplicates: spherical k-means cells, blocked cosines within cells, one representative per group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components


def unit_rows(vectors: pd.Series | list) -> tuple[np.ndarray, np.ndarray]:
    """The rows in double precision divided by their lengths, after an exact scaling that keeps squares in range."""
    x = np.array(list(vectors), np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.exp2(np.floor(np.log2(top)))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), x


def fit_cells(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means: ``k`` unit centres (fewer if rows coincide)."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), c)
    return np.unique(c, axis=0)


def link_blocks(ids: np.ndarray, x: np.ndarray, raw: np.ndarray, owner: np.ndarray, copies: np.ndarray, second: np.ndarray, least: float, block: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of a block's owners to the rows of the ``second`` block and the other way round, or to all if there is none.

    Returns (owner's row, links, each row counted with its copies) and a few edges (row, row) that connect the same.
    Cosines go piece by piece; those within 1e-9 of ``least`` are computed anew from the plain formula.
    """
    links, up = np.zeros(len(ids), np.int64), np.arange(len(ids))
    halves = [(owner & ~second, second), (owner & second, ~second)] if second.any() else [(owner, ~second)]
    for own, others in halves:
        own, others = np.flatnonzero(own), np.flatnonzero(others)
        for i in range(0, len(own), block):
            rows = own[i : i + block]
            for j in range(0, len(others), block):
                met = others[j : j + block]
                cos = x[rows] @ x[met].T
                a, b = np.nonzero(cos >= least - 1e-9)
                for e in np.flatnonzero(cos[a, b] < least + 1e-9):
                    u, v = raw[rows[a[e]]], raw[met[b[e]]]
                    cos[a[e], b[e]] = math.fsum(u * v) / math.sqrt(math.fsum(u * u)) / math.sqrt(math.fsum(v * v))
                p, q = rows[a], met[b]
                ok = (cos[a, b] >= least) & (p != q)
                p, q = p[ok], q[ok]
                np.add.at(links, p, copies[q])
                while len(p):  # a spanning forest is enough to tell components
                    while not np.array_equal(nxt := up[up], up):
                        up = nxt
                    rp, rq = up[p], up[q]
                    hi, lo = np.maximum(rp, rq), np.minimum(rp, rq)
                    new = hi != lo
                    p, q = p[new], q[new]
                    np.minimum.at(up, hi[new], lo[new])
    while not np.array_equal(nxt := up[up], up):
        up = nxt
    counted, linked = np.flatnonzero(links), np.flatnonzero(up != np.arange(len(ids)))
    return ids[counted], links[counted], ids[linked], ids[up[linked]]


def paired_blocks(dealt: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of cells dealt to pairs (one, other) of blocks; each two blocks of a cell, and each with itself, are a pair once.

    ``blocks`` has the number of blocks of the cells that have more than one.  ``second`` tells the rows of a pair's other block.
    """
    rows = dealt.join(blocks, ["label", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    second = (F.col("mine") > F.col("met")).alias("second")
    return rows.select("label", "cell", F.least("mine", "met").alias("one"), F.greatest("mine", "met").alias("other"), "row", "copies", "v", "owner", second)


def near_duplicates(spark: SparkSession, vectors: DataFrame, *, least: float = 0.98, cell_rows: int = 2000, sample: int = 20_000, most_cells: int = 256, most_centres: int = 8192) -> DataFrame:
    """Link rows of ``vectors`` (vec_id long, embedding, label) of equal label whose cosine is ``least`` or more.

    Each label's rows are dealt to spherical k-means cells, fitted on at most ``sample`` rows over all labels: about one
    per ``cell_rows`` rows, at most ``most_cells`` a label and ``most_centres`` in all (so what is broadcast has a
    bound; labels beyond it have one cell, which blocks split).  A row belongs to its nearest cell and visits each other
    one whose boundary is nearer than the greatest distance of two linked rows, so every row's own cell holds all
    rows that it may link with: no link is missed, and n_links is counted once.  Equal vectors of a label are one row with a
    number of copies throughout.  A cell of over ``cell_rows`` is cut into blocks of about that size, and a task compares
    two of them, so that none holds more.

    Returns a row per input row: vec_id, n_links, component_id, kept.  Vectors that are null, zero, or hold null or
    non-finite components, and rows of null label or null vec_id, link with nothing (component_id = vec_id).  Repeated rows count as
    rows of their own, of equal vec_id.  Vectors of different lengths link with nothing.  An empty table gives no rows;
    further columns are ignored.
    """
    scratch = Scratch(spark, "embeddings")
    v = vectors.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("label").cast("string").alias("label"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    v = v.withColumn("row", F.monotonically_increasing_id()).withColumn("label", F.when(F.coalesce(sound, F.lit(False)), F.concat_ws(":", F.size("v"), "label")))
    v = scratch.table(v, "rows")
    kinds = v.where("label is not null").groupBy("label", "v").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    kinds = scratch.table(kinds.select("row", "copies", "v", "label"), "kinds")
    counts = kinds.groupBy("label").count()
    large = counts.where(F.col("count") > cell_rows)  # smaller labels are one cell each
    largest = [(r["label"], min(most_cells, -(-r["count"] // cell_rows))) for r in large.orderBy(F.desc("count"), "label").limit(most_centres // 2).collect()]
    wanted, left = {}, most_centres
    for label, k in largest:
        if left >= k:
            wanted[label], left = k, left - k
    centres: dict[str, np.ndarray] = {}
    if wanted:
        share = max(1, sample // len(wanted))
        total = dict((r["label"], r["count"]) for r in large.where(F.col("label").isin(list(wanted))).collect())
        fraction = {k: min(1.0, share / n) for k, n in total.items()}
        drawn = kinds.where(F.col("label").isin(list(wanted)))
        rate = F.create_map(*[F.lit(x) for kv in fraction.items() for x in kv])[F.col("label")]
        drawn = drawn.where(F.pmod(F.xxhash64("row", F.lit(9)), F.lit(1 << 20)) < rate * (1 << 20)).select("label", "v").limit(2 * sample).toPandas()
        for label, g in drawn.groupby("label"):
            centres[label] = fit_cells(unit_rows(g["v"])[0], wanted[label])
    reach = math.sqrt(2 - 2 * least) + 1e-9
    shared = spark.sparkContext.broadcast({k: (c, np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))) for k, c in centres.items()})

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for label, g in f.groupby("label", sort=False):
                if label not in shared.value:
                    yield g.assign(cell=0, owner=True)
                    continue
                c, apart = shared.value[label]
                for k in range(0, len(g), 4096):
                    h = g.iloc[k : k + 4096]
                    cos = unit_rows(h["v"])[0] @ c.T
                    near = cos.argmax(axis=1)
                    visits = cos.max(axis=1)[:, None] - cos <= reach * apart[near] + 1e-12
                    visits[np.arange(len(h)), near] = True
                    a, b = np.nonzero(visits)
                    yield h.iloc[a].assign(cell=b, owner=near[a] == b)

    dealt = scratch.table(kinds.mapInPandas(deal, "row long, copies long, v array<double>, label string, cell int, owner boolean"), "dealt")
    blocks = dealt.groupBy("label", "cell").count().select("label", "cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("blocks"))
    blocks = scratch.table(blocks.where("blocks > 1"), "blocks")

    def link(g: pd.DataFrame) -> pd.DataFrame:
        x, raw = unit_rows(g["v"])
        ids, links, src, dst = link_blocks(g["row"].to_numpy(), x, raw, g["owner"].to_numpy(bool), g["copies"].to_numpy(), g["second"].to_numpy(bool), least)
        counted = pd.DataFrame({"row": ids, "other": -1, "n_links": links})
        return pd.concat([counted, pd.DataFrame({"row": src, "other": dst, "n_links": 0})], ignore_index=True)

    pairs = paired_blocks(dealt, blocks).groupBy("label", "cell", "one", "other")
    found = scratch.table(pairs.applyInPandas(link, "row long, other long, n_links long"), "found")
    cc = scratch.table(components(found.where("other >= 0").select(F.col("row").alias("src"), F.col("other").alias("dst")), scratch), "cc")
    own = found.where("other < 0").groupBy("row").agg(F.sum("n_links").alias("n_links"))
    per = kinds.select("row", "copies").join(own, "row", "left").join(cc, F.col("row") == F.col("node"), "left")
    per = per.select(F.col("row").alias("kind"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    several = kinds.where("copies > 1").select("label", "v", F.col("row").alias("kind"))
    placed = v.join(several, ["label", "v"], "left").select("vec_id", F.coalesce("kind", "row").alias("kind"))
    named = placed.join(scratch.table(per, "per"), "kind", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "kind").alias("component"))
    named = scratch.table(named, "named")
    first = scratch.table(named.groupBy("component").agg(F.min("vec_id").alias("component_id")), "first")
    return named.join(first, "component").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS s, b.vec_id AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(s, d) AS (SELECT s, d FROM l UNION SELECT r.s, l.d FROM r JOIN l ON r.d = l.s),
c AS (SELECT s, least(s, min(d)) AS component_id FROM r GROUP BY s),
n AS (SELECT s, count(*) AS n_links FROM l GROUP BY s)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.s = e.vec_id LEFT JOIN n ON n.s = e.vec_id
"""


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked within a label at cosine 0.98 or more."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
