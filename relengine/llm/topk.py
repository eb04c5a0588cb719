"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

LONG = (1 << 63) - 1
EXACT = float(1 << 52)  # inner products up to here are whole numbers in a double, whatever the order of summing


def rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors of the sample: its directions of greatest energy come first.  Any sample gives right results."""
    return np.linalg.svd(sample.T @ sample)[2].T


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def search_block(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, x: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int, head: int = 16, step: int = 1024) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The ``k`` best of rows ``x`` for each query, skipping what can't reach the query's ``floor``, as (query, ids, scores).

    Rows are taken by descending length.  A query stops at the first row whose length times its own is below its
    floor; before that, the inner product of the first ``head`` rotated components plus the product of the residual
    lengths bounds the score, and only rows whose bound reaches the floor are scored.  The floor is the k-th best so far;
    a row at the floor is kept, as its id may be smaller.
    """
    norms = np.sqrt((x * x).sum(axis=1))
    order = np.lexsort((ids, -norms))
    x, ids, norms = x[order], ids[order], norms[order]
    xr, qr = x @ turn, q @ turn
    x_head, q_head = xr[:, :head], qr[:, :head]
    x_rest, q_rest = (np.sqrt(np.maximum(0, (m[:, head:] ** 2).sum(axis=1))) for m in (xr, qr))
    q_norms = np.sqrt((q * q).sum(axis=1))
    top_ids, top_scores = [np.empty(0, np.int64)] * len(q), [np.empty(0)] * len(q)
    floor = floor.copy()
    alive = np.arange(len(q))
    for at in range(0, len(x), step):
        end = min(at + step, len(x))
        slack = 1e-9 * (1 + q_norms[alive] * norms[at])  # of rounding in the bounds; scores themselves are exact
        alive = alive[q_norms[alive] * norms[at] + slack >= floor[alive]]
        if not len(alive):
            break
        slack = 1e-9 * (1 + q_norms[alive] * norms[at])
        bound = q_head[alive] @ x_head[at:end].T + np.outer(q_rest[alive], x_rest[at:end])
        may = bound + slack[:, None] >= floor[alive][:, None]
        rows = np.flatnonzero(may.any(axis=0))
        if not len(rows):
            continue
        scores = q[alive] @ x[at + rows].T
        may = may[:, rows] & (scores >= floor[alive][:, None]) & (ids[at + rows][None, :] != q_ids[alive][:, None])
        for i in np.flatnonzero(may.any(axis=1)):
            j = alive[i]
            new = np.flatnonzero(may[i])
            all_ids, all_scores = np.concatenate((top_ids[j], ids[at + rows[new]])), np.concatenate((top_scores[j], scores[i, new]))
            keep = best(all_ids, all_scores, k)
            top_ids[j], top_scores[j] = all_ids[keep], all_scores[keep]
            if len(keep) == k:
                floor[j] = max(floor[j], top_scores[j][-1])
    return [(j, top_ids[j], top_scores[j]) for j in range(len(q)) if len(top_ids[j])]


def top_k(spark: SparkSession, vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, bucket_rows: int = 16_384, query_rows: int = 4096, sample: int = 10_000) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``, the ``k`` other rows of highest integer inner product.

    Components x become floor(``scale`` * x).  Rows stand in buckets of about ``bucket_rows`` by descending length (a bucket
    of many equal lengths is cut further), queries in blocks of ``query_rows``; the rotation is fitted on at most ``sample`` rows.
    The longest bucket is searched first; its k-th scores are floors for the others, which a block of queries enters
    only if its lengths may reach a floor.  Results are exact.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; fewer rows if there are fewer others.
    Vectors that are null, empty, or hold null or non-finite components, and rows of null vec_id, take no part; rows of another
    number of components than a query are no candidates of it.  A query's own row is that of its vec_id; repeated rows of
    another vec_id each count, and a repeated query is asked once for each distinct vector.  Rows whose squared length is
    2**52 or more are scored apart, in whole numbers; only a result that a long can't hold raises an error.  An empty table gives no rows; further columns are ignored.
    """
    scratch = Scratch(spark, "topk")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = vectors.where(sound).select(F.col("vec_id").cast("long"), whole.alias("v"))
    v = v.select("vec_id", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("n2"))
    v = scratch.table(v, "rows")
    any_long = v.where(~(F.col("n2") < EXACT)).limit(1).count() > 0
    short = v.where(F.col("n2") < EXACT) if any_long else v
    dims = short.groupBy("dim").agg(F.count("*").alias("n"))
    large = dims.where(F.col("n") > bucket_rows).orderBy("dim").collect()  # each has over bucket_rows rows, so these are few
    found = _top_k_of_small(short.join(dims.where(F.col("n") <= bucket_rows), "dim"), k, every)
    for r in large:  # rows of different numbers of components never meet; usually there is one
        found = found.union(_top_k_of(spark, short.where(F.col("dim") == r["dim"]), r["n"], scratch, f"d{r['dim']}", k, every, bucket_rows, query_rows, sample))
    if any_long:
        over = v.where(~(F.col("n2") < EXACT))
        found = found.union(_top_k_in_integers(over, v, scratch, "over_all", k, every, bucket_rows, query_rows))
        found = found.union(_top_k_in_integers(short, over, scratch, "short_over", k, every, bucket_rows, query_rows))
    by = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    if any_long:
        score = F.when(F.col("score").isin(-LONG - 1, LONG), F.raise_error(F.lit("an inner product exceeds a long"))).otherwise(F.col("score"))
        ranked = ranked.withColumn("score", score.cast("long"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _asked(v: DataFrame, every: int) -> DataFrame:
    """(dim, vec_id, v, copy) of the distinct queries among ``v``."""
    return v.where(F.col("vec_id") % every == 0).select("dim", "vec_id", "v").distinct().withColumn("copy", F.xxhash64("v"))


def _top_k_of_small(v: DataFrame, k: int, every: int) -> DataFrame:
    """(query_id, copy, vec_id, score) of numbers of components that few rows have, a group each, however many there are."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        is_query = g["copy"].notna()
        x, q = g[~is_query], g[is_query]
        out = []
        if len(q):
            xv, qv = np.array(list(x["v"]), np.float64), np.array(list(q["v"]), np.float64)
            q_ids, copies = q["vec_id"].to_numpy(np.int64), q["copy"].to_numpy()
            turn = rotation(xv[:10_000]) if len(xv) > xv.shape[1] else np.eye(xv.shape[1])
            for j, ids, scores in search_block(qv, q_ids, np.full(len(q), -EXACT), xv, x["vec_id"].to_numpy(np.int64), turn, k):
                out += [(q_ids[j], int(copies[j]), i, int(s)) for i, s in zip(ids.tolist(), scores)]
        return pd.DataFrame(out, columns=["query_id", "copy", "vec_id", "score"]).astype("int64")

    none = F.lit(None).cast("string").alias("copy")  # a string, as pandas makes longs with nulls inexact
    both = v.select("dim", "vec_id", "v", none).union(_asked(v, every).select("dim", "vec_id", "v", F.col("copy").cast("string")))
    return both.groupBy("dim").applyInPandas(run, "query_id long, copy long, vec_id long, score long")


def exact_best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(id, score) of the ``k`` rows of highest inner product with ``q`` in whole numbers; doubles only rule out rows that can't be among them."""
    with np.errstate(all="ignore"):
        near = x @ q
        slack = len(q) * 2.0**-50 * np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum())
        sure = np.isfinite(near) & np.isfinite(slack)
        low, high = np.where(sure, near - slack, -np.inf), np.where(sure, near + slack, np.inf)
    rows = np.flatnonzero(high >= (np.partition(low, -k)[-k] if len(low) > k else -np.inf))
    whole = [int(c) for c in q]
    scores = [(-sum(a * int(b) for a, b in zip(whole, x[r])), int(ids[r])) for r in rows]
    return [(i, -s) for s, i in sorted(scores)[:k]]


def _top_k_in_integers(asking: DataFrame, base: DataFrame, scratch: Scratch, name: str, k: int, every: int, bucket_rows: int, query_rows: int) -> DataFrame:
    """(query_id, copy, vec_id, score) of the queries of ``asking`` among parts of ``base``; scores beyond a long become its ends."""

    def dealt(df: DataFrame, rows: int, out: str) -> DataFrame:
        parts = scratch.table(df.groupBy("dim").agg(F.ceil(F.count("*") / rows).alias("parts")), f"{name}_{out}s")
        return df.join(parts, "dim").withColumn(out, F.pmod(F.xxhash64("vec_id", F.lit(3)), "parts").cast("int")).drop("parts")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        is_query = g["copy"].notna()
        x, q = g[~is_query], g[is_query]
        out = []
        if len(x) and len(q):
            xv, ids = np.array(list(x["v"]), np.float64), x["vec_id"].to_numpy(np.int64)
            for q_id, copy, qv in zip(q["vec_id"].tolist(), q["copy"], q["v"]):
                other = ids != q_id
                out += [(q_id, int(copy), i, max(-LONG - 1, min(LONG, s))) for i, s in exact_best(np.asarray(qv, np.float64), xv[other], ids[other], k)]
        return pd.DataFrame(out, columns=["query_id", "copy", "vec_id", "score"]).astype("int64")

    queries = scratch.table(dealt(_asked(asking, every), query_rows, "q_block"), f"{name}_queries")
    rows = dealt(base.select("dim", "vec_id", "v"), bucket_rows, "part")
    blocks, parts = queries.select("dim", "q_block").distinct(), rows.select("dim", "part").distinct()
    both = rows.join(blocks, "dim").select("dim", "part", "q_block", "vec_id", "v", F.lit(None).cast("string").alias("copy"))
    both = both.union(queries.join(parts, "dim").select("dim", "part", "q_block", "vec_id", "v", F.col("copy").cast("string")))
    return both.groupBy("dim", "part", "q_block").applyInPandas(run, "query_id long, copy long, vec_id long, score long")


def _top_k_of(spark: SparkSession, v: DataFrame, n: int, scratch: Scratch, name: str, k: int, every: int, bucket_rows: int, query_rows: int, sample: int) -> DataFrame:
    """(query_id, copy, vec_id, score) with the ``k`` best of each bucket part that a query entered; all rows are of one width."""
    buckets = max(1, min(1024, math.ceil(n / bucket_rows)))
    at = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(v.agg(F.percentile_approx("n2", F.array(*map(F.lit, at)), 10_000).alias("p")).first()["p"])) if at else []
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > F.col("n2"))) if bounds else F.lit(0)  # 0: the longest
    rows = v.select("vec_id", "v", "n2", bucket.alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("n2").alias("x2")).orderBy("bucket").collect()  # at most 1,024 rows
    cut = {c["bucket"]: math.ceil(c["n"] / (2 * bucket_rows)) for c in counts}
    parts = F.create_map(*[F.lit(x) for kv in cut.items() for x in kv])
    rows = scratch.table(rows.select("vec_id", "v", "bucket", F.pmod(F.xxhash64("vec_id"), parts[F.col("bucket")]).cast("int").alias("part")), f"{name}_rows")
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct().withColumn("copy", F.xxhash64("v"))
    q_blocks = max(1, math.ceil(n / every / query_rows))
    queries = scratch.table(queries.withColumn("q_block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(q_blocks)).cast("int")), f"{name}_queries")
    share = math.ceil(min(1.0, sample / n) * (1 << 20))
    drawn = v.where(F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1 << 20)) < share).select("v").limit(2 * sample).toPandas()
    turn = spark.sparkContext.broadcast(rotation(np.array(list(drawn["v"]), np.float64)) if len(drawn) else None)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        is_query = g["floor"].notna()
        x, q = g[~is_query], g[is_query]
        out = {"query_id": [], "copy": [], "vec_id": [], "score": []}
        if len(x) and len(q):
            xv, qv = np.array(list(x["v"]), np.float64), np.array(list(q["v"]), np.float64)
            t = turn.value if turn.value is not None else np.eye(xv.shape[1])
            q_ids, copies = q["vec_id"].to_numpy(np.int64), q["copy"].to_numpy(np.int64)
            for j, ids, scores in search_block(qv, q_ids, q["floor"].to_numpy(), xv, x["vec_id"].to_numpy(np.int64), t, k):
                out["query_id"] += [q_ids[j]] * len(ids)
                out["copy"] += [copies[j]] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.astype(np.int64).tolist()
        return pd.DataFrame(out).astype("int64")

    def search(asked: DataFrame) -> DataFrame:
        """A group is a bucket part's rows with the queries of one block that enter it, and their floors."""
        entered = asked.groupBy("bucket", "part").agg(F.collect_set("q_block").alias("q_blocks"))
        base = rows.join(entered, ["bucket", "part"]).select("bucket", "part", F.explode("q_blocks").alias("q_block"), F.lit(None).cast("double").alias("floor"), F.lit(None).cast("long").alias("copy"), "vec_id", "v")
        both = base.unionByName(asked.select("bucket", "part", "q_block", "floor", "copy", "vec_id", "v"))
        return both.groupBy("bucket", "part", "q_block").applyInPandas(run, "query_id long, copy long, vec_id long, score long")

    def enter(queries: DataFrame, buckets: list) -> DataFrame:
        """Queries (with floor) dealt to the parts of the buckets whose lengths may reach their floors; there are at most 1,024 buckets."""
        places = F.array(*[F.struct(F.lit(c["bucket"]).alias("bucket"), F.lit(cut[c["bucket"]]).alias("parts"), F.lit(math.sqrt(c["x2"])).alias("length")) for c in buckets])
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        dealt = queries.withColumn("length", length).withColumn("c", F.explode(places))
        dealt = dealt.where(F.col("length") * F.col("c.length") * (1 + 1e-9) + 1e-6 >= F.col("floor"))
        dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("c.parts") - 1)))
        return dealt.select("c.bucket", "part", "q_block", "floor", "copy", "vec_id", "v")

    first = scratch.table(search(enter(queries.withColumn("floor", F.lit(-EXACT)), counts[:1])), f"{name}_first")
    if len(counts) == 1:
        return first
    rank = F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id"))
    floors = first.withColumn("r", rank).where(F.col("r") == k).select(F.col("query_id").alias("_q"), F.col("copy").alias("_c"), F.col("score").cast("double").alias("kth"))
    queries = queries.join(floors, (F.col("vec_id") == F.col("_q")) & (F.col("copy") == F.col("_c")), "left")
    rest = search(enter(queries.withColumn("floor", F.coalesce("kth", F.lit(-EXACT))), counts[1:]))
    return first.union(rest)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best for every 50th embedding, among all."""
    return top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
