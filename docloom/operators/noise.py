"""Layout noise: page numbers, dot leaders, running headers, and texts that repeat at page edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions import text as t

# What marks a block as noise.
PAGE_NUMBER = r"\A((第\s*)?\d{1,4}\s*页?|page\s+\d{1,4}|[—–-]\s*\d{1,4}\s*[—–-])\z"
DOT_LEADER = r"\A.*\.{4,}\s*\d{1,4}\z"
HEADER_HINT = r"confidential|draft|copyright|版权所有|保密|内部资料"
RUNNING_HEADER = (
    r"(保险股份有限公司\s*)?个人保险基本条款第[零一二三四五六七八九十\d]+版$",
    r"^[^。！？；：]{4,80}(寿险|保险|险)\S*利益条款$",
)
LEGAL_TITLE = r"\A第[零一二三四五六七八九十百千万\d]+[条款章节]"
TOP, BOTTOM = 90.0, 700.0


def page_edge(bbox: Column) -> Column:
    middle = (bbox["y0"] + bbox["y1"]) / 2
    return F.coalesce((middle <= TOP) | (middle >= BOTTOM), F.lit(False))


def running_header(text: Column, page: Column, bbox: Column) -> Column:
    body = t.strip(text)
    return (page > 1) & (F.length(body) <= 120) & ~t.matches(body, LEGAL_TITLE) & (t.matches(body, RUNNING_HEADER[0]) | t.matches(body, RUNNING_HEADER[1])) & (bbox.isNull() | page_edge(bbox))


def mark_noise(blocks: DataFrame) -> DataFrame:
    """blocks(document_id, page_number, block_type, text, bbox, ...) with noise_reason (null: content).

    A text of at most 120 characters that looks like a header on two or more pages is noise wherever it stands.
    """
    text = F.coalesce("text", F.lit(""))
    marked = blocks.withColumn("_norm", t.normalized_text(text))
    looks = page_edge(F.col("bbox")) | t.matches(text, HEADER_HINT, True) | running_header(text, F.col("page_number"), F.col("bbox"))
    page = F.when((F.col("_norm") != "") & (F.length("_norm") <= 120) & looks, F.col("page_number"))
    same = Window.partitionBy("document_id", "_norm")
    marked = marked.withColumn("_again", F.min(page).over(same) < F.max(page).over(same))
    body = t.strip(text)
    reason = (
        F.when(body == "", "blank")
        .when(F.col("block_type").isin("header", "footer", "page_number"), "block_type")
        .when((F.length(body) <= 20) & t.matches(body, PAGE_NUMBER, True), "page_number")
        .when((F.length(body) <= 160) & t.matches(body, DOT_LEADER), "toc_dot_leader")
        .when(running_header(text, F.col("page_number"), F.col("bbox")), "running_header_pattern")
        .when(F.col("_again"), "repeated_page_edge")
    )
    return marked.withColumn("noise_reason", reason).select(*blocks.columns, "noise_reason")


def drop_noise(blocks: DataFrame) -> DataFrame:
    return mark_noise(blocks).filter("noise_reason is null").drop("noise_reason")


def _zones(pages: DataFrame, zone: int) -> DataFrame:
    """pages(document_id, page_number, text) with their lines, and for each line whether it is in the first or last ``zone``."""
    return pages.withColumn("lines", F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"))


def header_footer_lines(pages: DataFrame, zone: int = 3, share: float = 0.5) -> DataFrame:
    """(document_id, zone, norm): lines in the first or last ``zone`` lines of a ``share`` (rounded down) of a document's pages, if it has three or more.

    pages(document_id, page_number, text).  A line counts once for a page and zone.
    """
    each = _zones(pages, zone)
    part = lambda name, lines: F.struct(F.lit(name).alias("zone"), F.array_distinct(F.filter(F.transform(lines, t.normalized_line), lambda x: x != "")).alias("norms"))
    first, last = F.slice("lines", 1, zone), F.slice("lines", F.greatest(F.size("lines") - zone + 1, F.lit(1)), zone)
    both = each.select("document_id", F.explode(F.array(part("header", first), part("footer", last))).alias("z")).select("document_id", "z.zone", F.explode("z.norms").alias("norm"))
    counts = both.groupBy("document_id", "zone", "norm").agg(F.count("*").alias("n"))
    sizes = pages.groupBy("document_id").agg(F.count("*").alias("pages")).filter("pages >= 3")
    return counts.join(sizes, "document_id").filter(F.col("n") >= F.floor(F.col("pages") * share)).select("document_id", "zone", "norm")


def strip_headers(pages: DataFrame, zone: int = 3, share: float = 0.5) -> DataFrame:
    """pages without the lines that header_footer_lines() finds in either zone, in both; texts of documents that have some are stripped."""
    found = header_footer_lines(pages, zone, share).groupBy("document_id").agg(F.collect_set("norm").alias("gone"))
    joined = _zones(pages, zone).join(found, "document_id", "left")
    at_edge = lambda i: (i < zone) | (i >= F.size("lines") - zone)
    kept = F.filter("lines", lambda x, i: ~(at_edge(i) & F.array_contains("gone", t.normalized_line(x))))
    return joined.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(t.strip(F.array_join(kept, "\n")))).select(*pages.columns)


def removed(marked: DataFrame, examples: int = 5) -> DataFrame:
    """(document_id, removed, examples) of mark_noise(): how many blocks go, and the first few, cut at 80 characters."""
    gone = marked.filter("noise_reason is not null").withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "reading_order")))
    few = F.sort_array(F.collect_list(F.when((F.col("rank") <= examples) & (t.strip(F.coalesce("text", F.lit(""))) != ""), F.struct("rank", F.substring(t.strip(F.col("text")), 1, 80).alias("text")))))
    return gone.groupBy("document_id").agg(F.count("*").alias("removed"), F.transform(few, lambda x: x["text"]).alias("examples"))


def kept_on_pages(pages: DataFrame, marked: DataFrame) -> DataFrame:
    """pages(document_id, page_number, block_ids) without the ids of removed blocks."""
    gone = marked.filter("noise_reason is not null").groupBy("document_id", "page_number").agg(F.collect_set("block_id").alias("gone"))
    left = F.filter("block_ids", lambda x: ~F.coalesce(F.array_contains("gone", x), F.lit(False)))
    return pages.join(gone, ["document_id", "page_number"], "left").withColumn("block_ids", left).select(*pages.columns)
