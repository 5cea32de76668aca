"""Page texts as blocks: headers and footers removed, wrapped lines put together, headings found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions import ids, paths, text as t
from docloom.operators import noise

# What ends a line, begins a block, looks like a heading, and the characters between which white space is an artefact.
ENDS_LINE = r"[。！？…；：.!?」』\"»›]\z"
BEGINS_BLOCK = r"\A(第[零一二三四五六七八九十百千万\d]+[章节条款篇]|chapter\s+\d+|section\s+\d+|article\s+\d+|\d+(\.\d+){1,3}\s+\S)"
LOOKS_HEADED = (r"\A(?i:chapter|section)\s+\d+", r"\A\d+(\.\d+){0,3}\s+\S+", r"\A第.+[章节条]\s*")
WIDE = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3000}-\x{303f}\x{ff00}-\x{ffef}"


def reflowed(lines: Column) -> Column:
    """Lines put together to paragraphs.

    A paragraph ends at a blank line, after a line that ends a sentence, and before one that begins a chapter, an article or a numbered section.
    Lines are joined with a space between two ASCII letters, else with nothing; white space between two wide characters goes.
    """
    clean = F.transform(lines, t.strip)
    letter = lambda x, at: F.substring(x, at, 1).rlike("[A-Za-z]")
    start = F.struct(F.lit("").alias("now"), F.lit(False).alias("ends"), paths.no_values("string").alias("out"))

    def step(s: Column, x: Column) -> Column:
        blank, open_ = x == "", s["now"] != ""
        new = open_ & (blank | s["ends"] | t.matches(x, BEGINS_BLOCK, True))
        gap = F.when(letter(s["now"], -1) & letter(x, 1), " ").otherwise("")
        now = F.when(blank, F.lit("")).when(new | ~open_, x).otherwise(F.concat(s["now"], gap, x))
        return F.struct(now.alias("now"), x.rlike(ENDS_LINE).alias("ends"), F.when(new, paths.appended(s["out"], s["now"])).otherwise(s["out"]).alias("out"))

    done = F.aggregate(clean, start, step, lambda s: paths.all_values(F.when(s["now"] != "", paths.appended(s["out"], s["now"])).otherwise(s["out"])))
    return F.transform(done, lambda p: F.regexp_replace(p, rf"(?U)(?<=[{WIDE}]){t.SPACE}+(?=[{WIDE}])", ""))


def paragraphs(c: Column) -> Column:
    """Paragraphs of a page: blank lines part them, and lines inside are put together."""
    return reflowed(F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n"))


def looks_headed(c: Column) -> Column:
    line = t.first_line(c)
    found = t.matches(line, LOOKS_HEADED[0]) | t.matches(line, LOOKS_HEADED[1]) | t.matches(line, LOOKS_HEADED[2])
    return (line != "") & (F.length(line) <= 80) & ~line.rlike(ENDS_LINE) & found


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of pages(document_id, page_number, text).

    A page's path begins with the chapter and the section that it names; a heading on it sets the path for the rest of the page.
    """
    clean = noise.strip_headers(pages.withColumn("text", t.strip(F.coalesce("text", F.lit("")))))
    meta = t.page_metadata(F.col("text"))
    named = F.array_distinct(F.array_compact(F.array(meta["chapter"], meta["section"])))
    each = clean.select("document_id", "page_number", F.coalesce(named, F.array().cast("array<string>")).alias("named"), F.posexplode(F.transform(paragraphs(F.col("text")), t.clean_chunk_text)).alias("at", "text")).filter("text <> ''")
    each = each.withColumn("block_type", F.when(looks_headed(F.col("text")), "heading").otherwise("paragraph"))
    within = Window.partitionBy("document_id", "page_number").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("block_type") == "heading", F.array(t.first_line(F.col("text")))), True).over(within)
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "at")) - 1
    rows = each.select("document_id", "page_number", order.cast("int").alias("reading_order"), "block_type", "text", F.coalesce(own, "named").alias("heading_path"), F.lit("pypdf").alias("source_parser"))
    return rows.withColumn("block_id", ids.block_id(F.col("document_id"), F.col("page_number"), F.col("reading_order"), F.col("block_type")))


def page_text_files(files: DataFrame) -> DataFrame:
    """Blocks of files whose pages are text, parted by form feeds; files that aren't text make none."""
    text = F.col("content").cast("string")
    whole = files.filter(F.is_valid_utf8(text) & ~F.startswith(text, F.lit("%PDF")) & ~F.lower("path").endswith(".json"))
    each = whole.select("document_id", F.posexplode(F.split(text, "\x0c")).alias("i", "text"))
    return page_blocks(each.select("document_id", (F.col("i") + 1).alias("page_number"), "text"))
