"""Shared helpers: words, tables in the shared folder, distributed prefix sums, components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import shared_folder

#: A word: a run of anything but space, tab, LF, VT, FF and CR.  ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(r"[^\x20\x09-\x0d]+")

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text (null: 0), JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1 ... and the new name of each old one (of the first, where names repeat), so that no name can clash."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain, {c: f"c{i}" for i, c in reversed(list(enumerate(df.columns)))}


def give_back() -> None:
    """Return memory that a task has freed to the system; Spark keeps workers for later tasks, which would hold it beside the next ones'."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other C libraries have none
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that leaves no memory behind in its worker."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


class Scratch:
    """Parquet tables of one operator run in the shared folder, so that a lost executor costs no recomputation beyond them.

    They are deleted when the application ends, or before by :meth:`drop`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        path, fs = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back: its lineage is cut, its size known to the planner.  A task writes one file."""
        df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            path, fs = self._at(self.path(name))
            fs.delete(path, True)


def prefix_before(df: DataFrame, scratch: Scratch, group: list[str], bucket: str, order: list, value: str | list[str], out: str | list[str]) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group`` that come before this one; or several of both.

    Rows are ordered by (``bucket``, ``order``); ``group`` and ``bucket`` must not be null.
    No group is ever in one task: sums per (group, bucket), combined map-side, become each bucket's
    base, and only rows of one bucket are sorted together.
    """
    values, outs = ([x] if isinstance(x, str) else x for x in (value, out))
    sums = df.groupBy(*group, bucket).agg(*[F.sum(v).alias(f"_sum{i}") for i, v in enumerate(values)])
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*group, bucket, *[F.coalesce(F.sum(f"_sum{i}").over(before), F.lit(0)).alias(f"_base{i}") for i in range(len(values))])
    bases = scratch.table(bases, f"bases_{outs[0]}")
    local = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"_local{i}") for i, v in enumerate(values)])
    rows = rows.join(bases, [*group, bucket])
    kept = [c for c in rows.columns if c in df.columns]
    return rows.select(*kept, *[(F.col(f"_base{i}") + F.col(f"_local{i}")).alias(o) for i, o in enumerate(outs)])


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

    ``edges`` (src long, dst long), in any direction, repeats and loops allowed.  Returns (node, component)
    for each node that has a link to another one; component is the smallest node reachable.
    Each step takes a minimum per node, combined map-side, and an equi-join that adaptive execution may
    split, so that a star with a third of all links doesn't meet in one task.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = scratch.table(e, "cc_0")

    def star(e: DataFrame, large: bool, name: str) -> DataFrame:
        # Large star: every neighbour above u goes to the least one of u's neighbourhood.  Small star: those below.
        both = e.union(e.select("v", "u")) if large else e
        low = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m")), f"{name}_m")
        j = both.join(low, "u")
        if large:
            new = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            new = j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        new = new.where("u <> v").distinct()
        return new

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    old = mark(e)
    for i in range(1, most_rounds):
        name = f"cc_{i}"
        big = scratch.table(star(e, True, f"{name}_l"), f"{name}_big")
        e = scratch.table(star(big, False, f"{name}_s"), name)
        new = mark(e)
        scratch.drop(f"cc_{i - 1}", f"{name}_l_m", f"{name}_s_m", f"{name}_big")
        if new == old:
            break
        old = new
    else:
        raise RuntimeError("components: no fixed point")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
