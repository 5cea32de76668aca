"""Flat chunks: paragraph packing, sliding windows, page offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docloom.functions import paths, text as t


def _placed(pages: DataFrame) -> DataFrame:
    """pages with body (the stripped text), gap (line ends before it), and where it ends in the joined text."""
    order = Window.partitionBy("document_id").orderBy("page_number")
    body = pages.withColumn("body", t.strip(F.coalesce("text", F.lit(""))))
    ended = t.matches(F.col("body"), r"[。！？；.!?;）)」』\"]\z")
    last = F.last(F.when(F.col("body") != "", ended), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    sized = body.withColumn("gap", F.when((F.col("body") != "") & last, 2).otherwise(0))
    return sized.withColumn("end", F.sum(F.col("gap") + F.length("body")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def page_offsets(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, start, end) of each page's text in the joined text of the document.

    A page that ends a sentence is followed by a blank line, another runs on; a blank page is an empty range.
    """
    return _placed(pages).select("document_id", "page_number", (F.col("end") - F.length("body")).alias("start"), "end")


def joined_pages(pages: DataFrame) -> DataFrame:
    """(document_id, text): pages' texts as page_offsets() places them."""
    parts = F.sort_array(F.collect_list(F.struct("page_number", "gap", "body")))
    return _placed(pages).groupBy("document_id").agg(F.array_join(F.transform(parts, lambda x: F.concat(F.repeat(F.lit("\n"), x["gap"]), x["body"])), "").alias("text"))


def page_of(points: DataFrame, offsets: DataFrame) -> DataFrame:
    """points(document_id, at) with the page whose half-open range holds them; the last page beyond all, 1 without pages.

    An equality on the document keeps this from being a cross join.
    """
    inside = points.join(offsets, (points["document_id"] == offsets["document_id"]) & (F.col("start") <= F.col("at")) & (F.col("at") < F.col("end")), "left").select(points["document_id"], "at", "page_number")
    last = offsets.groupBy("document_id").agg(F.max("page_number").alias("last_page"))
    return inside.join(last, "document_id", "left").select("document_id", "at", F.coalesce("page_number", "last_page", F.lit(1)).alias("page_number"))


def sliding_windows(docs: DataFrame, size: int = 400, overlap: int = 100) -> DataFrame:
    """(document_id, chunk_index, text) of windows of ``size`` words, each starting size - overlap after the one before."""
    if not 0 <= overlap < size or size < 50:
        raise ValueError("size must be 50 or more, and overlap less than size")
    words = F.filter(F.split("text", rf"(?U){t.SPACE}+"), lambda w: w != "")
    step = size - overlap
    count = F.when(F.size("w") <= size, 1).otherwise(F.ceil((F.size("w") - size) / step) + 1).cast("int")
    return docs.select("document_id", words.alias("w")).filter(F.size("w") > 0).select("document_id", "w", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index")).select("document_id", "chunk_index", F.array_join(F.slice("w", F.col("chunk_index") * step + 1, size), " ").alias("text"))


def paragraph_numbers(units, budget: int):
    """Chunk number of each paragraph's token count by greedy packing (counts are summed as they are)."""
    start = F.struct(F.lit(-1).alias("n"), F.lit(0).cast("long").alias("sum"), paths.no_values("int").alias("out"))

    def step(s, u):
        over = (s["n"] < 0) | (s["sum"] + u > budget)
        n = s["n"] + F.when(over, 1).otherwise(0)
        return F.struct(n.alias("n"), F.when(over, u).otherwise(s["sum"] + u).alias("sum"), paths.appended(s["out"], n).alias("out"))

    return F.aggregate(units, start, step, lambda s: paths.all_values(s["out"]))


def paragraph_chunks(blocks: DataFrame, budget: int = 400) -> DataFrame:
    """(document_id, chunk_index, n_blocks, tokens) of paragraphs packed under a token budget."""
    each = blocks.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "reading_order", t.estimate_tokens(F.col("text")).alias("tokens")))).alias("u"))
    tokens = F.transform("u", lambda x: x["tokens"])
    return each.select("document_id", F.explode(F.arrays_zip(tokens.alias("tokens"), paragraph_numbers(tokens, budget).alias("n"))).alias("x")).groupBy("document_id", F.col("x.n").alias("chunk_index")).agg(F.count("*").alias("n_blocks"), F.sum("x.tokens").alias("tokens"))


def paged_chunks(pages: DataFrame, budget: int = 400) -> DataFrame:
    """Flat chunks of pages(document_id, page_number, text): paragraphs of the joined text packed under a budget.

    (document_id, chunk_index, page_number, text, chapter, section, domain_hint): the page is the one where the chunk begins, and the rest is
    what that page says of itself.  A paragraph is two characters longer in the count of places than it is, a blank one is two.
    """
    order = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    each = joined_pages(pages).select("document_id", F.posexplode(F.transform(F.split("text", rf"(?dU)\n{t.SPACE}*\n"), t.strip)).alias("pos", "body"))
    each = each.withColumn("at", F.coalesce(F.sum(F.length("body") + 2).over(order), F.lit(0)).cast("long")).filter("body <> ''")
    docs = each.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("pos", "at", "body", t.estimate_tokens(F.col("body")).alias("tokens")))).alias("u"))
    rows = docs.select("document_id", F.explode(F.arrays_zip(F.col("u"), paragraph_numbers(F.transform("u", lambda x: x["tokens"]), budget).alias("n"))).alias("x"))
    chunks = rows.groupBy("document_id", F.col("x.n").alias("n")).agg(F.min("x.u.at").alias("at"), F.sort_array(F.collect_list(F.struct("x.u.pos", "x.u.body"))).alias("m"))
    text = t.clean_chunk_text(F.array_join(F.transform("m", lambda x: x["body"]), "\n\n"))
    kept = chunks.select("document_id", "n", "at", text.alias("text")).filter("text <> ''")
    index = (F.row_number().over(Window.partitionBy("document_id").orderBy("n")) - 1).cast("int")
    found = page_of(kept.select("document_id", "at").distinct(), page_offsets(pages))
    said = pages.select("document_id", "page_number", t.page_metadata(F.coalesce("text", F.lit(""))).alias("meta"))
    full = kept.withColumn("chunk_index", index).join(found, ["document_id", "at"]).join(said, ["document_id", "page_number"], "left")
    return full.select("document_id", "chunk_index", "page_number", "text", "meta.chapter", "meta.section", "meta.domain_hint")
