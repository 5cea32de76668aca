"""Headings, heading paths and the section table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions import ids, paths, text as t

# Heading shapes.
_N = r"[零一二三四五六七八九十百千万\d]+"
LEGAL_ARTICLE = rf"\A第{_N}[条款章节]{{1,2}}(\s|\z)"
STRUCTURED = rf"\A\s*(\d+(\.\d+){{0,4}}\s+\S+|chapter\s+\d+\b.*|section\s+\d+\b.*|part\s+\d+\b.*|appendix\b.*|第{_N}[章节目篇卷]\s*\S*)"
SENTENCE_END, ORPHAN = r"[。！？…；.!?]\z", r"\A[，、；：…—]"
NUMBERED, CN_MARK, DATE = r"\A\s*(\d+(\.\d+){0,5})\s+\S+", rf"\A\s*第{_N}([章节目篇卷条款])", r"\A\d{4}\s*[年/\-.]\s*\d{1,2}"


def heading_reason(kind: Column, text: Column) -> Column:
    """Why a block is a heading: parser_heading, legal_article_pattern or structured_heading_pattern; null if it isn't."""
    line = t.first_line(text)
    n, ends, shaped = F.length(line), t.matches(F.substring(line, -1, 1), SENTENCE_END), t.matches(line, STRUCTURED, True)
    bad = (line == "") | (n > 80) | t.matches(line, ORPHAN) | t.matches(line, DATE)
    given = F.when(~bad & (shaped | (~ends & (n <= 30))), "parser_heading")
    inferred = F.when(bad | ends, F.lit(None)).when((n <= 40) & t.matches(line, LEGAL_ARTICLE), "legal_article_pattern").when(shaped, "structured_heading_pattern")
    return F.when(kind.isin("heading", "title"), given).when(kind.isin("paragraph", "text"), inferred)


def heading_level(text: Column, font_rank: Column | None = None, hint: Column | None = None) -> Column:
    """A level that the parser gave, else the depth of a dotted number, a Chinese mark, a first word, the rank of the font size, else 1."""
    line = t.first_line(text)
    dotted = F.regexp_extract(line, "(?dU)" + NUMBERED, 1)
    mark = F.regexp_extract(line, "(?dU)" + CN_MARK, 1)
    low = F.lower(line)
    starts = lambda *w: F.coalesce(*[F.when(F.startswith(low, F.lit(x)), True) for x in w], F.lit(False))
    given = F.lit(None).cast("int") if hint is None else F.when(hint.isNotNull(), F.least(F.greatest(hint, F.lit(1)), F.lit(6)))
    return F.coalesce(
        given,
        F.when(dotted != "", F.least(F.size(F.split(dotted, r"\.")), F.lit(6)))
        .when(mark.isin("章", "篇", "卷"), 1).when(mark.isin("节", "目", "条"), 2).when(mark == "款", 3)
        .when(starts("chapter ", "part ", "appendix"), 1).when(starts("section "), 2),
        F.lit(None) if font_rank is None else font_rank, F.lit(1),
    ).cast("int")


def heading_paths(blocks: DataFrame) -> DataFrame:
    """blocks(document_id, page_number, reading_order, block_type, text, heading_path) with block_type, heading_path, section_id,
    heading_level and heading_reason settled.

    A path that the parser gave wins.  Else a heading of level n puts its title below the path's first n - 1 titles.  level_hint and
    font_size, if there, help to find n.  Blocks before any heading are under "Document".
    """
    path = paths.cleaned(F.col("heading_path"))
    own = F.coalesce(F.size("heading_path"), F.lit(0)) > 0
    line = F.col("_line")  # a column of its own: found once
    reason = F.when(own, "parser_heading_path").otherwise(heading_reason(F.col("block_type"), line))
    marked = blocks.withColumn("_line", t.first_line(F.col("text"))).withColumn("heading_reason", reason)
    rank = None
    if "font_size" in blocks.columns:  # few sizes for each document
        found = font_ranks(blocks).groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("font_size", "rank"))).alias("font_ranks"))
        marked, rank = marked.join(found, "document_id", "left"), F.try_element_at("font_ranks", F.col("font_size"))
    hint = F.col("level_hint") if "level_hint" in blocks.columns else None
    # a given path's blocks keep the level that the parser gave them
    level = F.when(own, F.coalesce(hint, F.size(path)) if hint is not None else F.size(path)).when(F.col("heading_reason").isNotNull(), heading_level(line, rank, hint))
    marked = marked.withColumn("heading_level", level.cast("int")).drop("font_ranks")
    heads = ~F.col("heading_reason").eqNullSafe("parser_heading_path") & F.col("heading_reason").isNotNull()
    found = paths.running_path(marked, "document_id", ["page_number", "reading_order"], F.when(heads, F.col("heading_level")), line, F.when(own, path))
    full = F.when(F.size("path") > 0, F.col("path")).otherwise(F.array(F.lit("Document")))
    promoted = F.when(F.col("heading_reason").endswith("_pattern"), "heading").otherwise(F.col("block_type"))
    return found.withColumn("block_type", promoted).withColumn("heading_path", full).withColumn("section_id", ids.section_id(F.col("document_id"), F.col("heading_path"))).drop("path")


def section_table(blocks: DataFrame) -> DataFrame:
    """A row for each prefix of each heading path: title, level, pages, and how many blocks stand right under it."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("heading_path")), lambda i: F.slice("heading_path", 1, i))
    each = blocks.filter(F.size("heading_path") > 0).select("document_id", "page_number", F.size("heading_path").alias("depth"), F.explode(prefixes).alias("path"))
    found = each.groupBy("document_id", "path").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.count_if(F.size("path") == F.col("depth")).alias("n_blocks"))
    parent = F.slice("path", 1, F.size("path") - 1)
    return found.select(
        "document_id", ids.section_id(F.col("document_id"), F.col("path")).alias("section_id"), F.when(F.size("path") > 1, ids.section_id(F.col("document_id"), parent)).alias("parent_section_id"),
        F.element_at("path", -1).alias("title"), F.size("path").alias("level"), "page_start", "page_end", "n_blocks", F.col("path").alias("heading_path"),
    )


def font_ranks(blocks: DataFrame) -> DataFrame:
    """(document_id, font_size, rank): the six largest sizes of a document, the largest 1."""
    sizes = blocks.filter("font_size is not null").select("document_id", "font_size").distinct()
    return sizes.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("font_size").desc()))).filter("rank <= 6")
