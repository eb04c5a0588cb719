"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, by_place, prefix_before, word_count


def source_targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int, scratch: Scratch) -> DataFrame:
    """Targets of (source, source_size): shares by weight of all sizes, none above ``repeats`` times its source.

    Sharing the excess anew until no target is above its cap is water filling: target = min(cap, weight * level),
    with one level for all.  With sources in order of cap / weight, the level is the greatest of
    (total - caps before) / (weights from here on), so no loop is needed.  Sources are range-sorted twice, by name and by that
    order, with prefix sums over the ranges, as there may be as many sources as hosts; only single figures come to the driver.
    """
    by_name = F.col("source").asc_nulls_last()
    s = sizes.repartitionByRange(by_name).select("source", "source_size", F.lit(1).cast("long").alias("one"), F.spark_partition_id().alias("part"))
    s = prefix_before(scratch.table(s, "by_name"), scratch, [], "part", [by_name], "one", "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    s = s.select("source", "source_size", weight.alias("w"), (F.col("source_size") * repeats).alias("cap"))
    s = s.withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    s = scratch.table(s.repartitionByRange(F.col("ratio"), by_name).withColumn("part", F.spark_partition_id()), "by_cap")
    s = scratch.table(prefix_before(s, scratch, [], "part", [F.col("ratio"), by_name], ["cap", "w"], ["caps", "ws"]), "caps")
    total, all_w = s.agg(F.sum("source_size"), F.sum("w")).first()
    share = (F.lit(total) - F.col("caps")).cast("double") / (F.lit(all_w) - F.col("ws")).cast("double")
    level = s.agg(F.max(share)).first()[0]
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(level)).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = 17, buckets: int = 1024) -> DataFrame:
    """Mix ``docs`` (doc_id, source, text) to weighted shares of all their words.

    Sources by code point (null is a source, the last) weigh ``weights`` in turn.  Each source's documents stand
    in the order of an MD5 of seed and doc_id; a source's budget, the floor of its target, takes as many whole
    epochs as fit and then a prefix of one more, whose last document gives only the words still wanted.
    ``buckets`` (at most 65536) ranges of the key are what one task sorts.

    Returns doc_id, size (words), source_size, target, taken (words taken, repeats counted; ``repeats`` x size at most).
    A null text has size 0 and takes nothing; an empty table gives no rows; repeated rows each count, rows of equal
    doc_id follow by size; further columns of ``docs`` are ignored.
    """
    return _ordered(spark, docs, weights, repeats, seed, buckets).select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("last")).cast("long").alias("taken"))


def _key(seed: int, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _ordered(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...], repeats: int, seed: int, buckets: int) -> DataFrame:
    """A slim row per document: its source (s_null, s_val), its place (key, doc_id, size, tie), its source's figures, the
    source's whole epochs, and ``last``, the words that the prefix of one more takes."""
    scratch = Scratch(spark, "mix")
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(seed, F.col("doc_id")).alias("key"), F.xxhash64("text").alias("tie"))
    slim = slim.select("*", F.col("source").isNull().alias("s_null"), F.coalesce("source", F.lit("")).alias("s_val"), F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * buckets / 65536).cast("int").alias("bucket"))
    slim = scratch.table(slim, "slim")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = scratch.table(source_targets(sizes, weights, repeats, scratch).select(F.col("source").isNull().alias("s_null"), F.coalesce("source", F.lit("")).alias("s_val"), "source_size", "target"), "plan")
    rows = prefix_before(slim, scratch, ["s_null", "s_val"], "bucket", ["key", "doc_id", "size", "tie"], "size", "before")
    rows = rows.join(plan, ["s_null", "s_val"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    return rows.withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))))


def mixed_documents(spark: SparkSession, docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = 17, buckets: int = 1024) -> DataFrame:
    """``docs`` as :func:`mix` takes them: a row for each epoch a document is in; the document at a source's cut keeps only its first words.

    A source's cut is one place in its order, so a table with a row per source tells every document's share, and texts are
    not shuffled (unless there are so many sources that the planner won't broadcast them).  Documents without words aren't
    taken; of repeated rows at a cut, each is cut there.  Columns are those of ``docs``.
    """
    scratch = Scratch(spark, "mixed")
    plain, name = by_place(docs)  # so that no column of the input clashes with one of these
    doc_id, source, text = (F.col(name[c]) for c in ("doc_id", "source", "text"))
    rows = _ordered(spark, plain.select(doc_id.alias("doc_id"), source.alias("source"), text.alias("text")), weights, repeats, seed, buckets)
    place = F.struct("key", F.col("doc_id").alias("id"), "size", "tie")
    at_cut = (F.col("size") > 0) & (F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("size"))
    cuts = rows.groupBy("s_null", "s_val").agg(F.max("epochs").alias("epochs"), F.max(F.when(at_cut, F.struct(place.alias("at"), F.col("last").alias("words")))).alias("cut"))
    cuts = scratch.table(cuts, "cuts")
    own = F.struct(_key(seed, doc_id).alias("key"), doc_id.alias("id"), word_count(text).alias("size"), F.xxhash64(text).alias("tie"))
    j = plain.select("*", own.alias("own"), source.isNull().alias("s_null"), F.coalesce(source, F.lit("")).alias("s_val")).where("own.size > 0").join(cuts, ["s_null", "s_val"])
    whole = (F.col("epochs") + F.coalesce((F.col("own") < F.col("cut.at")) | ((F.col("own") == F.col("cut.at")) & (F.col("cut.words") == F.col("own.size"))), F.lit(False)).cast("long")).cast("int")
    part = F.when((F.col("own") == F.col("cut.at")) & (F.col("cut.words") < F.col("own.size")), F.col("cut.words").cast("int"))
    j = j.withColumn("words", F.explode(F.concat(F.array_repeat(F.lit(0), whole), F.when(part.isNotNull(), F.array(part)).otherwise(F.array().cast("array<int>")))))
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.greatest(F.col("words"), F.lit(1))), " ")
    cut = F.col("words") > 0
    changed = {"text": F.when(cut, head).otherwise(text)}
    if "n_chars" in name:
        changed["n_chars"] = F.when(cut, F.char_length(head)).otherwise(F.col(name["n_chars"])).cast(dict(plain.dtypes)[name["n_chars"]])
    of = {name[c]: x for c, x in changed.items()}
    return j.select(*[of.get(c, F.col(c)).alias(c) for c in plain.columns]).toDF(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER b, 0)::BIGINT AS caps, coalesce(sum(w) OVER b, 0)::BIGINT AS ws,
              (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS all_w FROM s1
       WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT source, source_size, least(cap::DOUBLE, w * max((total - caps)::DOUBLE / (all_w - ws)::DOUBLE) OVER ()) AS target FROM s2),
r AS (SELECT d.doc_id, d.size, s3.source_size, s3.target, floor(s3.target)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM e
"""


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed at weights 1, 2, 3, each source at most three times."""
    return mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
