"""Article markers that a layout engine put into a box of their own, beside the body that they begin and end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docloom.functions import boxes, text as t
from docloom.operators.templates import CONTRACT_END, MEDIA

# Fixed value: a marker's label and what of the body's end follows it.
MARKER = r"\A\s*(第[一二三四五六七八九十百千万零〇两0-9]+条)\s*(.*)\z"
#: How much wider than its marker a body is, and what another heading path is worth beside a share of 100 for the overlap.
WIDER, OTHER_PATH = 1.8, 20


def join_markers(blocks: DataFrame) -> DataFrame:
    """blocks with split markers joined to their bodies: ``label body tail`` as a paragraph, marker_block_id names the marker, which goes.

    A marker is a block with a box whose first line is a label and a tail.  Its body is a block of the same page beside it that is much
    wider, or stands before it with an unfinished first line; of several the one that overlaps most and is nearest.  If several markers have
    one body, the last one is joined and the others go.  Blocks without a box stay as they are.

    Markers meet only bodies of their own page, by an equality join on document and page; both sides hold geometry alone, and texts are
    joined by block_id.
    """
    line = t.first_line(F.col("text"))
    label, tail = (t.strip(F.regexp_extract(line, "(?dU)" + MARKER, i)) for i in (1, 2))
    all_ = blocks.filter("bbox is not null").select("document_id", "page_number", "block_id", "reading_order", "bbox", "heading_path", "block_type", line.alias("line"), label.alias("label"), tail.alias("tail"))
    width = lambda b: b["x1"] - b["x0"]
    markers = all_.filter("label <> '' and tail <> ''").select("document_id", "page_number", F.struct("block_id", "reading_order", "bbox", "heading_path", "label", "tail").alias("m"))
    bodies = all_.filter((F.col("label") == "") & (F.col("line") != "") & ~F.col("block_type").isin(*MEDIA, "heading", "title"))
    bodies = bodies.select("document_id", "page_number", F.struct("block_id", "reading_order", "bbox", "heading_path", "line").alias("b"))
    pairs = markers.join(bodies, ["document_id", "page_number"]).withColumn("beside", boxes.overlap(F.col("m.bbox"), F.col("b.bbox"))).filter("beside > 0")
    before = (F.col("b.reading_order") < F.col("m.reading_order")) & ~t.matches(F.col("b.line"), CONTRACT_END)
    pairs = pairs.filter((width(F.col("b.bbox")) > WIDER * width(F.col("m.bbox"))) | before)
    other = (F.size("b.heading_path") > 0) & (F.size("m.heading_path") > 0) & (F.col("b.heading_path") != F.col("m.heading_path"))
    worth = F.col("beside") * 100 - F.abs(F.col("b.reading_order") - F.col("m.reading_order")) + F.when(other, OTHER_PATH).otherwise(0)
    best = F.row_number().over(Window.partitionBy("document_id", "m.block_id").orderBy(worth.desc(), "b.reading_order", "b.block_id"))
    taken = pairs.withColumn("best", best).filter("best = 1").select("document_id", F.col("m.block_id").alias("marker"), F.col("b.block_id").alias("block_id"), "m.label", "m.tail", F.col("m.reading_order").alias("at"))
    last = F.row_number().over(Window.partitionBy("document_id", "block_id").orderBy(F.col("at").desc(), F.col("marker").desc()))
    ends = taken.withColumn("last", last).filter("last = 1").select("document_id", "block_id", F.col("marker").alias("marker_block_id"), "label", "tail")
    kept = blocks.drop("marker_block_id").join(taken.select("document_id", F.col("marker").alias("block_id")), ["document_id", "block_id"], "left_anti").join(ends, ["document_id", "block_id"], "left")
    whole = F.concat(F.col("label"), F.lit(" "), t.strip(F.col("text")), F.when(t.strip(F.col("text")) == "", F.lit(" ")).otherwise(F.lit("")), F.col("tail"))
    there = F.col("marker_block_id").isNotNull()
    out = kept.withColumn("block_type", F.when(there & F.col("block_type").isin("list_item", "text"), "paragraph").otherwise(F.col("block_type")))
    if "markdown" in blocks.columns:
        out = out.withColumn("markdown", F.when(there & (F.col("markdown") != ""), whole).otherwise(F.col("markdown")))
    return out.withColumn("text", F.when(there, t.strip(whole)).otherwise(F.col("text"))).drop("label", "tail")
