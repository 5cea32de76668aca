"""Flat chunks: how older parsers' chunks are made, mended and merged.

chunks(document_id, source_type, page_number, chunk_index, text, chapter, section, domain_hint, headings, content_type).  A pass
folds a document's chunks in order; a merged text decides about the next one, so the fold is Python, a document at a time, over
Arrow.  Ids are made anew after each pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docloom.functions import ids, text as t
from docloom.operators.post import count_tokens

FIELDS = {"page_number": "int", "text": "string", "chapter": "string", "section": "string", "domain_hint": "string", "headings": "array<string>", "content_type": "string"}
_TYPE = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if k.startswith("array") else T.IntegerType() if k == "int" else T.StringType()) for n, k in FIELDS.items()])

# How text goes on, and what headings and lists look like.
HAN_END = re.compile("[一-鿿㐀-䶿豈-﫿]$")
MARK_START = re.compile(r"^[，、；：。！？…—）)》」』\]】]")
WEAK_END = re.compile(r"[:：;；、,，]$")
STRONG_END = re.compile(r"[。！？!?]$")
CN_HEADING = re.compile(r"^第[一二三四五六七八九十百千万零〇\d]+[章节条]")
EN_HEADING = re.compile(r"^(?:Chapter|Section)\s+\d+", re.IGNORECASE)
NUMERIC_HEADING = re.compile(r"^\d+\.")
LIST_ITEM = re.compile(r"^(?:[-*]\s*)?(?:[（(]?\d+[）).、]|[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]|[A-Za-z][.)、]|[一二三四五六七八九十百千万]+[、.])")
LONE_NUMBER = re.compile(r"^\d{4,8}$")


def _folded(chunks: DataFrame, fold: Callable[[list[dict]], list[dict]]) -> DataFrame:
    def run(found: pd.Series) -> pd.Series:
        return pd.Series([fold([{**r, "headings": list(r["headings"]) if r["headings"] is not None else []} for r in map(dict, rows)]) for rows in found], dtype=object)

    docs = chunks.groupBy("document_id", "source_type").agg(F.sort_array(F.collect_list(F.struct("chunk_index", F.struct(*FIELDS).alias("c")))).alias("rows"))
    done = docs.select("document_id", "source_type", F.posexplode(F.pandas_udf(run, T.ArrayType(_TYPE))(F.transform("rows", lambda x: x["c"]))).alias("chunk_index", "c"))
    return with_ids(done.select("document_id", "source_type", "chunk_index", "c.*"))


def with_ids(chunks: DataFrame) -> DataFrame:
    """chunks with the chunk_key of their page and a chunk_id."""
    d, p = F.col("document_id"), F.col("page_number")
    return chunks.withColumn("chunk_key", ids.chunk_key(d, p)).withColumn("chunk_id", ids.flat_chunk_id(d, F.col("source_type"), p, F.col("chunk_index")))


def _content(text: str) -> list[str]:
    """Lines with something on them but a number of 4 to 8 digits."""
    return [x for x in map(str.strip, text.splitlines()) if x and not LONE_NUMBER.match(x)]


def without_repeated_heading(first: str, second: str) -> str:
    """The second text without the lines at its top that are among the first five of the first; all of it if nothing else is there."""
    top = list(dict.fromkeys(x for x in map(str.strip, first.splitlines()) if x))[:5]
    lines = second.strip().splitlines()
    at = next((i for i, x in enumerate(lines) if x.strip() and x.strip() not in top), len(lines))
    return ("\n".join(lines[at:]).strip() if top and at else "") or second


def combined(a: dict, b: dict) -> dict:
    """One chunk of two: page and place of the first, headings of both in order."""
    either = {n: a[n] or b[n] for n in ("chapter", "section", "domain_hint", "content_type")}
    return {**a, **either, "text": f"{a['text']}\n{without_repeated_heading(a['text'], b['text'])}", "headings": list(dict.fromkeys([*a["headings"], *b["headings"]]))}


def _joining(joins: Callable[[dict, dict], bool]) -> Callable[[list[dict]], list[dict]]:
    def fold(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        for row in rows:
            if out and joins(out[-1], row):
                out[-1] = combined(out[-1], row)
            else:
                out.append(row)
        return out

    return fold


def _table(*rows: dict) -> bool:
    return any((r["content_type"] or "").lower() == "table" for r in rows)


def _same_section(a: dict, b: dict) -> bool:
    return (a["section"], a["chapter"]) == (b["section"], b["chapter"])


def broken(a: dict, b: dict, most: int) -> bool:
    """Whether b goes on in the middle of a sentence of a: a ends in a bare Han character, or b begins with a mark; within ``most`` tokens."""
    if _table(a, b) or not (HAN_END.search(a["text"].rstrip()) or MARK_START.match(b["text"].lstrip())):
        return False
    return count_tokens(a["text"]) + count_tokens(b["text"]) <= most


def mend_broken(chunks: DataFrame, max_tokens: int = 400, over: float = 0.5) -> DataFrame:
    """Chunks after broken sentences are joined, up to ``over`` beyond the budget."""
    most = int(max_tokens * (1 + over))
    return _folded(chunks, _joining(lambda a, b: broken(a, b, most)))


def is_anchor(row: dict) -> bool:
    """Whether a chunk's section is a heading that others can follow."""
    section = (row["section"] or "").strip()
    numbered = NUMERIC_HEADING.match(section) and (row["content_type"] or "").lower() != "list_item"
    return bool(section and (CN_HEADING.match(section) or EN_HEADING.match(section) or numbered))


def is_continuation(row: dict) -> bool:
    """Whether a chunk looks like the rest of a list or paragraph: an item, a line that is no heading, or a section that is none."""
    named = {x.strip() for x in (row["chapter"], row["section"], *row["headings"]) if x and x.strip()}
    lines = _content(row["text"])
    own = next((x for x in lines if x not in named), "")
    section = (row["section"] or "").strip()
    if (row["content_type"] or "").lower() == "list_item" or any(LIST_ITEM.match(x) for x in (section, lines[0] if lines else "", own)):
        return True
    if own and not any(p.match(own) for p in (CN_HEADING, EN_HEADING, NUMERIC_HEADING)):
        return True
    return bool(section) and not is_anchor(row)


def is_open(row: dict) -> bool:
    """Whether a chunk's last line asks for more: a weak mark, or a list item without an end."""
    tail = _content(row["text"])[-1:] or [""]
    return bool(WEAK_END.search(tail[0]) or (LIST_ITEM.match(tail[0]) and not STRONG_END.search(tail[0])))


def continues(a: dict, b: dict) -> bool:
    if _table(a, b) or not 0 <= b["page_number"] - a["page_number"] <= 1 or (a["chapter"] and b["chapter"] and a["chapter"] != b["chapter"]):
        return False
    return is_open(a) and is_continuation(b) and (_same_section(a, b) or is_anchor(a))


def join_continuations(chunks: DataFrame) -> DataFrame:
    """Chunks after paragraphs and lists that go on in the next one are joined, whatever their size."""
    return _folded(chunks, _joining(continues))


def merge_orphans(chunks: DataFrame, least: int = 50, max_tokens: int = 400, over: float = 0.2) -> DataFrame:
    """Chunks after those under ``least`` tokens joined the one before, or else the one after, of the same section; up to ``over`` beyond the budget."""
    most = int(max_tokens * (1 + over))

    def fits(a: dict, b: dict) -> bool:
        return _same_section(a, b) and count_tokens(a["text"]) + count_tokens(b["text"]) <= most

    def fold(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        rows = list(reversed(rows))
        alone = len(rows) < 2
        while rows:
            row = rows.pop()
            if alone or least <= 0 or _table(row) or count_tokens(row["text"]) >= least:
                out.append(row)
            elif out and not _table(out[-1]) and fits(out[-1], row):
                out[-1] = combined(out[-1], row)
            elif rows and not _table(rows[-1]) and fits(row, rows[-1]):
                out.append(combined(row, rows.pop()))
            else:
                out.append(row)
        return out

    return _folded(chunks, fold)


def _packed(items: list[dict], max_tokens: int) -> list[dict]:
    """Chunks of items(kind, level, text, page_number): headings and tables alone, text packed under the budget."""
    out: list[dict] = []
    stack: list[str] = []
    held: list[dict] = []

    def chunk(text: str, page: int, kind: str) -> dict:
        return {"page_number": page, "text": text, "chapter": stack[0] if stack else None, "section": stack[-1] if stack else None, "domain_hint": None, "headings": list(stack), "content_type": kind}

    def close() -> None:
        text = held[0]["joint"].join(x["text"] for x in held).strip() if held else ""
        if text:
            out.append(chunk(text, held[0]["page_number"], held[-1]["kind"]))
        held.clear()

    for x in items:
        if x["kind"] in ("title", "table"):
            close()
            if x["kind"] == "title":
                stack[max(x["level"] - 1, 0) :] = [x["title"]]
            out.append(chunk(x["text"], x["page_number"], x["kind"]))
        else:
            if held and count_tokens("\n\n".join([*(y["text"] for y in held), x["text"]])) > max_tokens:
                close()
            held.append(x)
    close()
    return out


def _chunked(items: DataFrame, source: str, max_tokens: int) -> DataFrame:
    """Flat chunks of items(document_id, pos, kind, level, title, text, page_number, joint)."""

    def run(found: pd.Series) -> pd.Series:
        return pd.Series([_packed([dict(r) for r in rows], max_tokens) for rows in found], dtype=object)

    docs = items.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("kind", "level", "title", "text", "page_number", "joint").alias("x")))).alias("rows"))
    done = docs.select("document_id", F.lit(source).alias("source_type"), F.posexplode(F.pandas_udf(run, T.ArrayType(_TYPE))(F.transform("rows", lambda r: r["x"]))).alias("chunk_index", "c"))
    return with_ids(done.select("document_id", "source_type", "chunk_index", "c.*"))


def content_list_chunks(items: DataFrame, max_tokens: int = 400) -> DataFrame:
    """Flat chunks of a content list's items: titles and tables (caption, body and footnote) alone, text packed; a chunk's kind is its last item's."""
    raw = F.col("kind")
    kind = F.when(raw.isin("title", "heading"), "title").when(raw == "table", "table").when(raw.isin("list", "list_item"), "list_item").when(raw.contains("equation") | raw.contains("formula"), "formula").otherwise("text")
    table = F.array_join(F.array_compact(F.array(F.col("caption"), F.nullif("raw_text", F.lit("")), F.col("footnote"))), "\n\n")
    text = F.when(raw == "table", table).otherwise(t.strip(F.col("raw_text")))
    rows = items.select("document_id", "pos", kind.alias("kind"), "level", text.alias("title"), text.alias("text"), "page_number", F.lit("\n\n").alias("joint"))
    return _chunked(rows.filter("text <> ''"), "mineru", max_tokens)


def markdown_chunks(docs: DataFrame, max_tokens: int = 400) -> DataFrame:
    """Flat chunks of Markdown (document_id, text): headings alone with their marks, other blocks packed, measured as paragraphs and joined as lines."""
    parts = F.filter(F.transform(F.split("text", r"\n{2,}"), t.strip), lambda x: x != "")
    each = docs.select("document_id", F.posexplode(parts).alias("pos", "text"))
    marks, title = (F.regexp_extract("text", r"(?dU)\A(#{1,6})\s+(.+)\z", i) for i in (1, 2))
    rows = each.select("document_id", "pos", F.when(marks != "", "title").otherwise("text").alias("kind"), F.length(marks).alias("level"), t.strip(title).alias("title"), "text", F.lit(1).alias("page_number"), F.lit("\n").alias("joint"))
    return _chunked(rows, "markdown", max_tokens)


def from_children(children: DataFrame, source: str) -> DataFrame:
    """Children of packages as flat chunks."""
    order = F.struct("parent_order", "child_index", "chunk_id")
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("document_id").orderBy(order)) - 1
    top: Column = F.get("heading_path", F.lit(0))
    return with_ids(children.select("document_id", F.lit(source).alias("source_type"), index.cast("int").alias("chunk_index"), F.col("page_start").alias("page_number"), "text", top.alias("chapter"), F.get("heading_path", F.size("heading_path") - 1).alias("section"), t.domain_hint(F.col("text")).alias("domain_hint"), F.col("heading_path").alias("headings"), F.col("chunk_type").alias("content_type")))


def flat_chunks(chunks: DataFrame, max_tokens: int = 400, min_chunk_tokens: int = 50) -> DataFrame:
    """All passes over flat chunks, in order."""
    return merge_orphans(join_continuations(mend_broken(chunks, max_tokens)), min_chunk_tokens, max_tokens)
