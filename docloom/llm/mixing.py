"""Mixing sources to target weights by capped water-filling.

Sizes are words.  Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``all sizes`` by weight.  No source
may be read more than ``epochs`` times: a target above that is clamped, and what it leaves is shared again by weight among the
rest until none is above.  The end of that is a water level: with sources by (cap / weight), a source is clamped exactly if its
ratio is below the level that remains once those before it are clamped, which running sums over the sources give at once.

A source with target t and size s takes every document floor(t / s) times, and then a seeded sample once more: documents in order
of a keyed md5 of their id until the rest of the target is used up; the document at that point gives its first words.  So a
source's taken words differ from its target by less than one word, and a rerun takes the same.

A running total over a source would put a third of all rows into one task, so it is made in two steps: totals of hash slices, then
a running total inside each slice.

Defined cases: null text has size 0 (and takes nothing); all sizes 0: targets 0; rows with a repeated or null doc_id are documents of
their own; ties of the hash go by doc_key; an empty table gives no rows; a very long text is one row like others; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docloom.llm import common as c

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) of sized(source, size).  One row for each source is all that is ordered."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight: Column = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = sums.withColumn("weight", weight).withColumn("cap", epochs * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    used = lambda name: F.coalesce(F.sum(name).over(before), F.lit(0))
    level = (F.sum("source_size").over(every) - used("cap")) / (F.sum("weight").over(every) - used("weight"))
    clamped = weighed.withColumn("clamped", F.col("cap") / F.col("weight") < level)
    rest = F.sum("source_size").over(every) - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(rest.cast("double") * F.col("weight") / open_weight)
    return clamped.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_key, doc_id, source, size, source_size, target, taken) for every row of docs(doc_id, text, source)."""
    return _mix(c.documents(docs, F.col("source")), weights, epochs, seed)


def _mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """mix() of identified rows."""
    slices = max(64, c.buckets(rows))
    h = F.md5(F.concat_ws(":", F.col("doc_key").cast("string"), F.lit(str(seed))).cast("binary"))
    sized = c.checkpointed(
        rows.select("doc_key", "doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), h.alias("h")).withColumn(
            "slice", (F.conv(F.substring("h", 1, 6), 16, 10).cast("long") * slices / (1 << 24)).cast("int")
        )
    )
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    per_source = targets(sized, weights, epochs)
    sums = sized.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    starts = sums.select("source", "slice", (F.sum("n").over(Window.partitionBy("source").orderBy("slice")) - F.col("n")).alias("slice_start"))
    starts = starts.join(per_source, same(starts, per_source)).select(starts["source"].alias("of"), starts["slice"].alias("in"), "slice_start", "source_size", "target")
    inside = F.sum("size").over(Window.partitionBy("source", "slice").orderBy("h", "doc_key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    ordered = sized.withColumn("inside", inside)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    once = F.least(F.col("size"), F.greatest(F.lit(0), F.floor(rest + 0.5).cast("long") - F.col("slice_start") - F.col("inside")))
    joined = ordered.join(starts, ordered["source"].eqNullSafe(starts["of"]) & (ordered["slice"] == starts["in"]))
    return joined.select("doc_key", "doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + once).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as often as it is taken; a part of a document is its first words.  Columns of docs.

    A null text takes nothing and so has no row; columns may have any names; rows with a repeated or null doc_id are documents of their own;
    a text that is taken whole stays as it is, however long; n_chars, if there, is new; an empty table stays empty.
    """
    kept = c.documents(docs, F.col("source"), c.whole_row(docs))  # once: the keys of two calls need not agree
    taken = _mix(kept.select("doc_key", "doc_id", "text", "source"), **options).filter("taken > 0").select(F.col("doc_key").alias("key_taken"), "size", "taken")
    rows = kept.select("doc_key", "text", "whole_row").join(taken, kept["doc_key"] == taken["key_taken"])
    rows = rows.withColumn("part", F.explode(F.transform(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")), lambda i: F.least(F.col("size"), F.col("taken") - (i - 1) * F.col("size")))))
    first_words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    text = F.when(F.col("part") < F.col("size"), first_words).otherwise(F.col("text"))
    return c.unpacked(rows.select("whole_row", text.alias("text")), docs.columns, text=F.col("text"), n_chars=F.length("text").cast("long"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix the whole documents table."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(doc_id || ':7') AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 3 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (
  SELECT *, CAST(cap AS DOUBLE) / weight < CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS clamped
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE
    CAST(sum(source_size) OVER () - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER () AS DOUBLE) * weight / sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER () END AS target
  FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS used
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + least(size, greatest(0, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) - used)) AS BIGINT) AS taken
FROM r
"""
