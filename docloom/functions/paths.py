"""Heading paths as running windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Levels that headings can have.
DEEPEST = 6


def cleaned(path: Column) -> Column:
    """Without blanks and repeats, stripped."""
    from docloom.functions.text import strip

    return F.array_distinct(F.filter(F.transform(F.coalesce(path, F.array().cast("array<string>")), strip), lambda x: x != ""))


def running_path(rows: DataFrame, key: str, order: list[str], level: Column, title: Column, given: Column, cut_back: bool = True) -> DataFrame:
    """rows with ``path``, the heading path at each row.

    A row with a level (1 and up) puts its title below the path's first level - 1 titles; one with ``given`` (an array that isn't empty)
    sets the whole path.  Without such rows before it a row's path is empty.  With ``cut_back`` a title that is already among those
    that it would stand below cuts the path back to it.

    The depth after a heading is one more than before, or its level if that is less: a running minimum.  The title at a depth is the last
    one that was put there, because a path grows by one at a time.  So no list of headings is built for a row, however long the
    document, but where cut_back matters: in a document in which a title repeats one above it, its headings are folded row by row.
    """
    every = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    start = rows.withColumn("_given", F.when(F.size(given) > 0, given)).withColumn("_level", F.when(F.col("_given").isNull() & level.isNotNull(), F.greatest(level, F.lit(1)))).withColumn("_title", title)
    run = start.withColumn("_run", F.count("_given").over(every))
    inside = Window.partitionBy(key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = run.withColumn("_at", F.count("_level").over(inside)).withColumn("_base", F.coalesce(F.size(F.first("_given").over(inside)), F.lit(0)))
    run = run.withColumn("_base", F.when(F.col("_base") < 0, 0).otherwise(F.col("_base")))
    least = F.min(F.col("_level") - F.col("_at")).over(inside)
    depth = F.when(F.col("_level").isNotNull(), F.least(F.col("_base") + F.col("_at"), F.col("_at") + least))
    run = run.withColumn("_depth", depth.cast("int"))
    at = [F.last(F.when(F.col("_given").isNotNull(), F.get("_given", F.lit(k - 1))).when(F.col("_depth") == k, F.col("_title")), True).over(every).alias(f"_t{k}") for k in range(1, DEEPEST + 1)]
    now = F.last(F.when(F.col("_given").isNotNull(), F.size("_given")).otherwise(F.col("_depth")), True).over(every)
    # what holds now is the given path, or titles down to the depth
    whole = F.last(F.when(F.col("_given").isNotNull(), F.col("_given")).when(F.col("_depth").isNotNull(), F.array().cast("array<string>")), True).over(every)
    run = run.select("*", *at, now.alias("_now"), whole.alias("_whole"))
    none = F.array().cast("array<string>")
    titles = F.slice(F.array(*[f"_t{k}" for k in range(1, DEEPEST + 1)]), F.lit(1), F.coalesce("_now", F.lit(0)))
    run = run.withColumn("path", F.when(F.col("_now").isNull(), none).when(F.size("_whole") > 0, F.col("_whole")).otherwise(titles))
    if cut_back:
        above = F.col("_depth").isNotNull() & F.array_contains(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))), F.col("_title"))
        run = run.withColumn("_odd", F.max(F.coalesce(above, F.lit(False))).over(Window.partitionBy(key)))
        event = F.when(F.col("_odd") & (F.col("_given").isNotNull() | F.col("_level").isNotNull()), F.struct(F.col("_given").alias("given"), F.col("_level").alias("level"), F.col("_title").alias("title")))
        run = run.withColumn("path", F.when(F.col("_odd"), F.aggregate(F.collect_list(event).over(every), none, _step)).otherwise(F.col("path")))
    return run.drop(*[x for x in run.columns if x.startswith("_")])


def _step(path: Column, e: Column) -> Column:
    kept = F.slice(path, F.lit(1), F.greatest(e["level"] - 1, F.lit(0)).cast("int"))
    there = F.array_position(kept, e["title"]).cast("int")
    cut = F.when(there > 0, F.slice(kept, F.lit(1), there)).otherwise(F.concat(kept, F.array(e["title"])))
    return F.when(e["given"].isNotNull(), e["given"]).when((e["level"] <= 1) | (F.size(path) == 0), F.array(e["title"])).otherwise(cut)


def appended(kept: Column, value: Column, most: int = 512) -> Column:
    """A list in a fold with one more value.  kept: struct<full: array<array>, last: array>; only the short last part is copied each time."""
    over = F.size(kept["last"]) >= most
    return F.struct(
        F.when(over, F.concat(kept["full"], F.array(kept["last"]))).otherwise(kept["full"]).alias("full"),
        F.when(over, F.array(value)).otherwise(F.concat(kept["last"], F.array(value))).alias("last"),
    )


def no_values(kind: str) -> Column:
    return F.struct(F.array().cast(f"array<array<{kind}>>").alias("full"), F.array().cast(f"array<{kind}>").alias("last"))


def all_values(kept: Column) -> Column:
    return F.concat(F.flatten(kept["full"]), kept["last"])
