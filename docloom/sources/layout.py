"""Layout exports as blocks: content lists and exported documents, both JSON.

Items have fields of many shapes (a caption is text or a list, a table is HTML, text or rows of cells, a box nests), so a file's items are
given one shape in Python, a file at a time over Arrow; paths, captions and ids are columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions import boxes, ids, paths, text as t

# What exports call the kinds of blocks.
TYPES = {
    "section_header": "heading", "text": "paragraph", "paragraph": "paragraph", "list": "list_item", "list_item": "list_item", "table": "table", "picture": "figure", "figure": "figure", "caption": "caption",
    "title": "heading", "formula": "formula", "header": "header", "footer": "footer", "page_number": "page_number", "interline_equation": "formula",
}
HEADINGS, FIGURES = ("title", "heading", "section_header"), ("image", "figure", "picture")

_SHAPED = f"document_id string, pos int, page_number int, block_type string, raw_text string, markdown string, html string, caption string, level int, given array<string>, bbox {boxes.BOX}, confidence double, width double, height double, kind string, footnote string"
_NAMES = [x.split()[0] for x in _SHAPED.replace(boxes.BOX, "box").split(", ")]


def block_type(name: Column) -> Column:
    """The kind of block that a name stands for; a paragraph if it isn't known."""
    low = F.lower(F.coalesce(name, F.lit("paragraph")))
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, low), F.when(low.isin(*sorted(set(TYPES.values()))), low), F.lit("paragraph"))


def _kind(name: str) -> str:
    low = name.lower()
    known = TYPES.get(low, low if low in TYPES.values() else "paragraph")
    return "heading" if low in HEADINGS else "figure" if low in FIGURES else known


def _whole(item: dict, *names: str) -> int | None:
    return next((item[n] for n in names if isinstance(item.get(n), int) and not isinstance(item[n], bool)), None)


def _words(value: Any, joint: str) -> str:
    """Text, or a list of texts put together; nothing for other values."""
    if isinstance(value, str):
        return value.strip()
    return joint.join(str(x).strip() for x in value if str(x).strip()).strip() if isinstance(value, list) else ""


def _first(item: dict, names: tuple[str, ...]) -> Any:
    return next((item[n] for n in names if item.get(n)), None)


def _text_of(item: dict, names: tuple[str, ...]) -> str:
    return next((_words(item[n], "\n") for n in names if isinstance(item.get(n), (str, list))), "")


def _level(item: dict, *names: str) -> int:
    found = next((item[n] for n in names if item.get(n)), None)
    return max(1, min(found, 6)) if isinstance(found, int) and not isinstance(found, bool) else 1


def _page(item: dict) -> int:
    from_0 = _whole(item, "page_idx", "page_index")
    return from_0 + 1 if from_0 is not None else _whole(item, "page", "page_no", "page_number") or 1


def markdown_rows(rows: list) -> str:
    """Rows of cells as a Markdown table; what isn't a row is passed over."""
    cells = [[str(x).strip().replace("\n", " ").replace("|", "\\|") for x in r] for r in rows if isinstance(r, list)]
    wide = max(map(len, cells), default=0)
    cells = [r + [""] * (wide - len(r)) for r in cells]
    body = [*cells[:1], ["---"] * wide, *(cells[1:] or [[""] * wide])] if cells else []
    return "\n".join(f"| {' | '.join(r)} |" for r in body)


def table_markdown(body: Any) -> str | None:
    """A table's body as Markdown: HTML, text, or rows of cells."""
    if isinstance(body, str):
        return t.html_markdown(body) if "<table" in body.lower() else body.strip()
    return markdown_rows(body) if isinstance(body, list) else None


def _content_item(item: dict) -> dict:
    name = str(item.get("type") or item.get("content_type") or "text")
    kind = _kind(name)
    html = next((item[n] for n in ("table_body", "html", "table_html") if isinstance(item.get(n), str) and "<table" in item[n].lower()), None) if kind == "table" else None
    markdown = table_markdown(_first(item, ("table_body", "html", "table_html", "md", "markdown", "text"))) if kind == "table" else None
    captions = ("table_caption", "caption") if kind == "table" else ("img_caption", "image_caption", "figure_caption", "caption")
    width, height = boxes.page_size_of(item.get("page_size") or item.get("page_info") or item)
    return {
        "page_number": _page(item), "block_type": kind, "raw_text": markdown or _text_of(item, ("text", "content", "md", "markdown")), "markdown": markdown, "html": html, "caption": " ".join(x for x in (_words(item.get(n), " ") for n in captions) if x) or None,
        "level": _level(item, "text_level", "level"), "given": [], "bbox": boxes.coerce(item), "confidence": next((x for x in (boxes.number(item.get(n)) for n in ("confidence", "score", "prob")) if x is not None), None), "width": width, "height": height, "kind": name.lower(), "footnote": next((x for x in (_words(item.get(n), " ") for n in ("table_footnote", "footnote")) if x), None),
    }


def _exported_item(item: dict) -> dict:
    prov = item.get("prov") or {}
    places = [*(p for p in (prov if isinstance(prov, list) else [prov]) if isinstance(p, dict)), item]
    name = str(item.get("label") or "text")
    kind = _kind(name)
    plain = next((item[n].strip() for n in ("text", "orig", "name") if isinstance(item.get(n), str) and item[n].strip()), "")
    markdown, html = (item[n].strip() or None if isinstance(item.get(n), str) else None for n in ("markdown", "html"))
    meta = item.get("meta") or {}
    text = (markdown or plain) if kind == "table" else (plain or markdown or "")
    return {
        "page_number": next((p for p in (_whole(x, "page_no", "page", "page_number") for x in places) if p is not None), 1), "block_type": kind, "raw_text": text, "markdown": markdown if kind == "table" or markdown != text else None, "html": html if kind == "table" else None,
        "caption": " ".join(x for x in (_words(item.get(n), " ") for n in ("caption", "captions")) if x) or None, "level": _level(item, "level", "text_level"), "given": [str(x).strip() for x in meta.get("headings") or [] if str(x).strip()],
        "bbox": next((b for b in map(boxes.coerce, places) if b), None), "confidence": None, "width": None, "height": None, "kind": name.lower(), "footnote": None,
    }


def _listed(content: bytes, lists: tuple[str, ...]) -> list[dict]:
    """Items of JSON: an array, or an object with lists (or tables of items) of these names, one after another; none if it isn't JSON."""
    try:
        value = json.loads(bytes(content))
    except ValueError:
        return []
    if isinstance(value, dict):
        parts = [value.get(n) or [] for n in lists]
        value = [x for p in parts for x in (p.values() if isinstance(p, dict) else p)]
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _shaped(files: DataFrame, shape: Callable[[dict], dict], lists: tuple[str, ...]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for document, content in zip(frame["document_id"], frame["content"], strict=True):
                found = [{"document_id": document, "pos": i, **shape(x)} for i, x in enumerate(_listed(content, lists))]
                for x in found:
                    x["bbox"] = dict(zip(("x0", "y0", "x1", "y1"), x["bbox"], strict=True)) if x["bbox"] else None
                yield pd.DataFrame(found, columns=_NAMES)

    return files.select("document_id", "content").mapInPandas(run, _SHAPED)


def content_list(files: DataFrame) -> DataFrame:
    """Items of files(document_id, content) that hold a content list."""
    return _shaped(files, _content_item, ("items",))


def exported(files: DataFrame) -> DataFrame:
    """Items of files(document_id, content) that hold an exported document: label, text, level, prov, captions, markdown, html, meta.headings."""
    return _shaped(files, _exported_item, ("texts", "tables", "pictures", "figures", "items"))


def item_blocks(shaped: DataFrame, source: str) -> DataFrame:
    """Blocks of content_list() or exported() items.

    A caption that the text doesn't hold goes before it; a figure without text is its caption; what is blank then goes, its place stays.
    """
    lacks = F.coalesce((F.col("caption") != "") & ~F.col("raw_text").contains(F.col("caption")), F.lit(False))
    put = lambda x: F.when(lacks, t.strip(F.concat(F.col("caption"), F.lit("\n\n"), x))).otherwise(x)
    figure = (F.col("block_type") == "figure") & (t.strip(F.col("raw_text")) == "")
    full = shaped.withColumn("text", F.when(figure, F.coalesce("caption", F.lit("[Figure]"))).otherwise(t.strip(put(F.col("raw_text"))))).withColumn("markdown", F.when(F.col("markdown") != "", put(F.col("markdown")))).filter("text <> ''")
    heads = F.col("block_type") == "heading"
    found = paths.running_path(full, "document_id", ["pos"], F.when(heads, F.col("level")), t.first_line(F.col("text")), F.lit(None).cast("array<string>"), cut_back=False)
    order = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(F.when(heads, 1).otherwise(0)).over(order)
    early = F.first(F.when(~heads & (F.size("given") > 0), F.col("given")), True).over(order)
    path = F.when(seen == 0, F.coalesce(early, F.array().cast("array<string>"))).otherwise(F.col("path"))
    return found.select(
        "document_id", "page_number", F.col("pos").alias("reading_order"), "block_type", "text", path.alias("heading_path"), "bbox", "caption", "markdown", "html", "confidence", F.lit(source).alias("source_parser"),
    ).withColumn("block_id", ids.block_id(F.col("document_id"), F.col("page_number"), F.col("reading_order"), F.col("block_type")))


def item_pages(shaped: DataFrame) -> DataFrame:
    """(document_id, page_number, width, height) of all pages that items name; the first size that one gives."""
    first = lambda n: F.min_by(n, F.when(F.col(n).isNotNull(), F.col("pos"))).alias(n)
    return shaped.groupBy("document_id", "page_number").agg(first("width"), first("height"))


def exported_pages(files: DataFrame) -> DataFrame:
    """(document_id, page_number, width, height) of exported documents' page tables."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for document, content in zip(frame["document_id"], frame["content"], strict=True):
                try:
                    pages = json.loads(bytes(content)).get("pages") or {}
                except (ValueError, AttributeError):
                    continue
                for key, page in pages.items() if isinstance(pages, dict) else enumerate(pages, 1):
                    number = int(key) if str(key).isdigit() else _whole(page, "page_no", "page_number")
                    out += [(document, number, *boxes.page_size_of(page))] if number is not None else []
            yield pd.DataFrame(out, columns=["document_id", "page_number", "width", "height"])

    return files.select("document_id", "content").mapInPandas(run, "document_id string, page_number int, width double, height double")


def chunk_blocks(chunks: DataFrame) -> DataFrame:
    """Blocks of chunks that another parser made: (document_id, pos, raw_text, page_number, headings, chapter, section, content_type).

    Without headings the chapter and the section are the path.  A page that isn't a positive number is the first.
    """
    named = F.filter(F.transform(F.coalesce("headings", F.array().cast("array<string>")), t.strip), lambda x: x != "")
    other = F.array_distinct(F.filter(F.transform(F.array_compact(F.array("chapter", "section")), t.strip), lambda x: x != ""))
    page = positive(F.col("page_number"), 1)
    rows = chunks.filter(t.strip(F.coalesce("raw_text", F.lit(""))) != "").select(
        "document_id", page.alias("page_number"), F.col("pos").cast("int").alias("reading_order"), block_type(F.col("content_type")).alias("block_type"), t.strip(F.col("raw_text")).alias("text"), F.when(F.size(named) > 0, named).otherwise(other).alias("heading_path")
    )
    return rows.withColumn("markdown", F.when(F.col("block_type") == "table", F.col("text"))).withColumn("block_id", ids.block_id(F.col("document_id"), F.col("page_number"), F.col("reading_order"), F.col("block_type")))


def positive(c: Column, other: int) -> Column:
    """A number from 1 up, or another."""
    n = c.cast("string").try_cast("int")
    return F.when(n > 0, n).otherwise(F.lit(other))


def chapter_and_section(headings: Column) -> Column:
    """struct<chapter, section> of a chunk's headings: the last that names a chapter, the first that doesn't."""
    is_chapter = lambda h: F.lower(h).contains("chapter") | h.rlike(r"第[一二三四五六七八九十百千万零\d]+[章编部篇]")
    last = F.filter(headings, is_chapter)
    rest = F.filter(headings, lambda h: ~is_chapter(h))
    return F.struct(F.when(F.size(last) > 0, F.element_at(last, -1)).alias("chapter"), F.get(rest, F.lit(0)).alias("section"))


def _json_files(files: DataFrame, opens: str) -> DataFrame:
    return files.filter(F.lower("path").endswith(".json") & (F.substring(F.ltrim(F.substring(F.col("content").cast("string"), 1, 1000)), 1, 1) == opens))


def exported_files(files: DataFrame) -> DataFrame:
    """Blocks of JSON files that hold an exported document (an object); other files make none."""
    return item_blocks(exported(_json_files(files, "{")), "docling")


def content_list_files(files: DataFrame) -> DataFrame:
    """Blocks of JSON files that hold a content list (an array); other files make none."""
    return item_blocks(content_list(_json_files(files, "[")), "mineru")
