"""Plain text and Markdown as blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions import ids, text as t

# One-line headings of plain text, and the words that open one.
_ALONE = ("abstract", "references", "contents", "faq")
_OPENERS = ("chapter ", "section ", "part ", "appendix ")
MD_HEADING = r"\A\s{0,3}#{1,6}\s+(.+)\z"
#: Bytes of text that a task has.
PART_BYTES = 4 << 20
LIST_MARK = r"\A\s*([-*+]\s+|\d+[.)]\s+|[①-⑩])"


def parted(docs: DataFrame) -> DataFrame:
    """(document_id, reading_order, part) of docs(document_id, text): paragraphs between blank lines; where there is only one, its lines.

    Documents are dealt out before they are cut, in parts of about PART_BYTES however many there are: all that follows works on a document
    at a time, in the task that has it.
    """
    kept = lambda x: F.filter(F.transform(x, t.strip), lambda p: p != "")
    if not docs.isStreaming:
        docs = docs.repartition(-(-volume(docs) // PART_BYTES) or 1, "document_id")
    # columns of their own: found once
    body = docs.select("document_id", F.regexp_replace("text", "\r\n?", "\n").alias("body")).withColumn("paragraphs", kept(F.split("body", rf"(?dU)\n{t.SPACE}*\n")))
    found = F.when(F.size("paragraphs") > 1, F.col("paragraphs")).otherwise(kept(F.split("body", "\n")))
    return body.select("document_id", F.posexplode(found).alias("reading_order", "part"))


def volume(docs: DataFrame) -> int:
    """Bytes of docs(text)."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def is_heading(part: Column) -> Column:
    line = t.first_line(part)
    low = F.lower(line)
    opens = low.isin(*_ALONE)
    for word in _OPENERS:
        opens = opens | F.startswith(low, F.lit(word))
    return t.matches(part, MD_HEADING) | ((F.length(line) <= 80) & opens)


def text_blocks(docs: DataFrame, document: str = "document_id", content: str = "text") -> DataFrame:
    """Blocks of docs(document_id, text): headings, list items and paragraphs, with the heading path that they stand under."""
    part = parted(docs.select(F.col(document).cast("string").alias("document_id"), F.col(content).alias("text")))
    title = F.when(t.matches(F.col("part"), MD_HEADING), t.strip(F.regexp_extract("part", "(?dU)" + MD_HEADING, 1))).otherwise(F.col("part"))
    kind = F.when(is_heading(F.col("part")), "heading").when(t.matches(F.col("part"), LIST_MARK), "list_item").otherwise("paragraph")
    typed = part.select("document_id", F.lit(1).alias("page_number"), "reading_order", kind.alias("block_type"), title.alias("text"))
    running = Window.partitionBy("document_id").orderBy("reading_order").rowsBetween(Window.unboundedPreceding, 0)
    path = F.last(F.when(F.col("block_type") == "heading", F.array(t.first_line(F.col("text")))), True).over(running)
    return typed.select(
        ids.block_id(F.col("document_id"), F.col("page_number"), F.col("reading_order"), F.col("block_type")).alias("block_id"),
        "*", F.coalesce(path, F.array().cast("array<string>")).alias("heading_path"),
    )


def file_blocks(files: DataFrame) -> DataFrame:
    """Blocks of files(document_id, path, content): .txt, .md and .markdown as UTF-8 (what isn't is replaced); other files make none."""
    known = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("txt", "md", "markdown"))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\A\x{feff}", "")
    return text_blocks(known.select("document_id", text.alias("text"))).withColumn("source_parser", F.lit("text_file"))
