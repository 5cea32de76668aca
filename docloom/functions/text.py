"""Text functions as columns.  All stay in the JVM.

Patterns follow Python's meaning of \\s, \\d and \\w on text: (?U) makes them Unicode, (?d) makes only \\n a line end.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The character ranges and word shape that a token estimate counts.
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{20000}-\x{2a6df}]"
LATIN = r"[a-zA-Z0-9]+(?:[-'][a-zA-Z0-9]+)*"
SPACE = r"[\s\x1c-\x1f]"
#: The characters that SPACE stands for.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_UNI = "(?dU)"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def first_line(c: Column) -> Column:
    """The first line with something on it, stripped."""
    return rstrip(F.substring_index(lstrip(c), "\n", 1))


def matches(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether a pattern is found."""
    return c.rlike(("(?dUi)" if ignore_case else _UNI) + pattern)


def cjk_count(c: Column) -> Column:
    """ASCII text, told by its bytes, has none and isn't searched."""
    return F.when(F.octet_length(c) == F.length(c), F.lit(0)).otherwise(F.regexp_count(c, F.lit(CJK))).cast("long")


def latin_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(LATIN)).cast("long")


def tokens_of(cjk: Column, latin: Column) -> Column:
    """One for a CJK character, 1.3 for a Latin word, rounded down."""
    return cjk + F.floor(latin * 13 / 10).cast("long")


def estimate_tokens(c: Column) -> Column:
    return tokens_of(cjk_count(c), latin_count(c))


def clean_chunk_text(c: Column) -> Column:
    """Without page markers, lines of 4 to 8 digits alone, and more than one blank line in a row."""
    marks = r"第\s*\d+\s*页(\s*(共|/)\s*\d+\s*页)?|(?m:(^|\s)[-—]\s*\d+\s*[-—](\s|$))|Page\s+\d+(\s+of\s+\d+)?"
    lines = F.filter(F.split(F.regexp_replace(c, f"(?dUi){marks}", ""), "\n"), lambda x: ~x.rlike(rf"{_UNI}\A{SPACE}*\d{{4,8}}{SPACE}*\z"))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def normalized_line(c: Column) -> Column:
    """For comparing lines over pages: runs of digits become #, runs of white space one space."""
    return F.regexp_replace(F.regexp_replace(strip(c), rf"{_UNI}\d+", "#"), rf"{_UNI}{SPACE}+", " ")


def normalized_text(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(c), rf"{_UNI}{SPACE}+", " "))


# Words that hint at a page's domain.
DOMAIN_WORDS = {
    "Engine": ["engine", "starter", "oil", "coolant", "temperature", "fuel", "rpm", "crankcase"],
    "Generator": ["generator", "voltage", "regulator", "contactor", "rectifier", "field", "brush"],
    "Troubleshooting": ["troubleshoot", "fault", "symptom", "will not", "won't", "problem", "fails", "stops"],
    "保险条款": ["保险金", "被保险人", "投保人", "保险费", "保险期间", "保险责任", "责任免除", "犹豫期"],
    "理赔": ["理赔", "给付", "赔偿", "赔付", "申请保险金"],
    "合同条款": ["合同成立", "合同效力", "合同解除", "合同终止", "合同变更", "现金价值"],
}


def domain_hint(c: Column) -> Column:
    """The domain whose words occur; Troubleshooting first if several do, else the first of them; null if none."""
    low = F.lower(c)
    hits = F.array_compact(F.array(*[F.when(_any(low, words), F.lit(name)) for name, words in DOMAIN_WORDS.items()]))
    return F.when(F.size(hits) > 1, F.when(F.array_contains(hits, "Troubleshooting"), F.lit("Troubleshooting")).otherwise(hits[0])).when(F.size(hits) == 1, hits[0])


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def heading_joined(path: Column) -> Column:
    return F.array_join(path, " > ")


def with_heading(body: Column, path: Column, prefix: str = "") -> Column:
    """A chunk's text: its heading path, unless the body opens with it (or with its deepest part), a prefix that the body doesn't hold, then the body."""
    deepest = F.when(F.size(path) > 0, strip(F.element_at(path, -1))).otherwise(F.lit(""))
    parents = heading_joined(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))))
    heading = F.when((deepest != "") & F.startswith(body, deepest), parents).otherwise(F.when(F.startswith(body, heading_joined(path)), F.lit("")).otherwise(heading_joined(path)))
    parts = [strip(heading), *([F.when(~body.contains(prefix), F.lit(prefix.strip())).otherwise("")] if prefix.strip() else []), strip(body)]
    return strip(F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n"))


def table_markdown(rows: Column) -> Column:
    """A matrix (array of arrays of cells) as a Markdown table; a header alone gets one blank row."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda x: F.regexp_replace(F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"\n", " "), r"\|", r"\\|")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = F.transform(rows, lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))))
    blank = F.array(F.array_repeat(F.lit(""), width))
    body = F.when(F.size(rows) > 1, F.slice(padded, 2, F.greatest(F.size(rows), F.lit(1)))).otherwise(blank)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(padded[0])), F.array(line(F.array_repeat(F.lit("---"), width))), F.transform(body, line)), "\n")).otherwise(F.lit(""))


_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>|<!--.*?-->|<[!?][^>]*>", re.DOTALL)


def _cells(source: str | None) -> list[list[str]]:
    """Cells of a table, row by row: text between a cell's tags, entities resolved, white space as one space; rows without cells are left out."""
    rows: list[list[str]] = []
    row: list[str] | None = None
    cell: list[str] | None = None
    at = 0
    for tag in _TAG.finditer(source or ""):
        if cell is not None:
            cell.append(html.unescape(source[at : tag.start()]))
        at, closes, name = tag.end(), tag[1], (tag[2] or "").lower()
        if name == "tr" and not closes:
            row = []
        elif name == "tr":
            rows += [row] if row else []
            row = None
        elif name in ("td", "th") and row is not None:
            if closes and cell is not None:
                row.append(" ".join("".join(cell).split()))
            cell = None if closes else []
    return rows


def html_markdown(source: str) -> str:
    """An HTML table as Markdown; without rows, the text without its tags."""
    rows = _cells(source)
    if not rows:
        return html.unescape(re.sub(r"<[^>]+>", " ", source)).strip()
    wide = max(map(len, rows))
    cells = [[x.replace("|", "\\|") for x in r] + [""] * (wide - len(r)) for r in rows]
    lines = [cells[0], ["---"] * wide, *(cells[1:] or [[""] * wide])]
    return "\n".join(f"| {' | '.join(r)} |" for r in lines)


def html_table_markdown(source: Column) -> Column:
    """html_markdown() of a column."""

    def run(found: pd.Series) -> pd.Series:
        return found.map(lambda x: None if x is None else html_markdown(x))

    return F.pandas_udf(run, T.StringType())(source)


# How a page names its chapter and section.
_CN = r"[一二三四五六七八九十百千万零\d]+"
PAGE_CHAPTER = rf"(?:Chapter\s+(\d+(?:-\d+)?)|第(?:{_CN})[章编部篇])"
PAGE_SECTION = rf"(?:Section\s+(\d+)\.\s*(.+?)(?=\n|Section\s+\d+|Chapter\s+\d+|$)|第(?:{_CN})[条节]\s*(.{{0,40}}))"


def page_metadata(c: Column) -> Column:
    """struct<chapter, section, section_title, domain_hint> of a page's text; null for a blank one."""
    some = lambda x: F.nullif(strip(x), F.lit(""))
    chapter = lambda i: some(F.regexp_extract(c, f"(?dUi){PAGE_CHAPTER}", i))
    section = lambda i: some(F.regexp_extract(c, f"(?dUis){PAGE_SECTION}", i))
    title = F.when(section(1).isNotNull(), section(2)).otherwise(section(3))
    return F.when(strip(c) != "", F.struct(
        F.coalesce(chapter(1), chapter(0)).alias("chapter"), F.coalesce(section(1), section(0)).alias("section"),
        some(F.substring(F.split(title, "\n")[0], 1, 80)).alias("section_title"), domain_hint(c).alias("domain_hint"),
    ))


# Words that tell a chunk's domain from its headings and the beginning of its text, first match first.
HEADING_DOMAINS = (
    ("Troubleshooting", ("troubleshoot",)), ("Engine", ("removal", "installation")), ("Generator", ("generator",)), ("Maintenance", ("maintenance", "lubrication", "filter")),
    ("Engine", ("engine", "fuel", "coolant")), ("Electrical", ("electric", "circuit", "wiring")), ("Maintenance", ("repair", "torque", "adjustment")),
    ("责任免除", ("责任免除", "免责")), ("保险责任", ("保险责任", "保险金", "给付")), ("理赔", ("理赔", "赔偿", "赔付", "申请保险金")), ("合同条款", ("合同成立", "合同效力", "合同解除", "合同终止")),
    ("保险费", ("保险费", "缴费", "费率")), ("期间条款", ("犹豫期", "宽限期", "等待期")), ("保险条款", ("被保险人", "投保人", "受益人")),
)


def heading_domain(headings: Column, c: Column) -> Column:
    """The domain that headings and the first 1200 characters speak of; null if none."""
    low = F.lower(F.concat(F.array_join(headings, " "), F.lit(" "), F.substring(c, 1, 1200)))
    return F.coalesce(*[F.when(_any(low, list(words)), F.lit(name)) for name, words in HEADING_DOMAINS])


def preview(c: Column, most: int = 120) -> Column:
    """The first characters, white space as one space."""
    return F.substring(strip(F.regexp_replace(c, rf"{_UNI}{SPACE}+", " ")), 1, most)


def without_marker(c: Column, pattern: str) -> Column:
    """Without what the anchored pattern matches, stripped."""
    return strip(F.regexp_replace(c, "(?dUi)" + pattern, ""))
