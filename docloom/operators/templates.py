"""Nine templates as column planners over one packing fold.

A planner says, for each block of a document in reading order, which block opens a parent (and with what title), which block
must begin a child (``breaks``), stands alone (``solo``), or may exceed the budget (``free``), and what type its child has.  The template is
a column: documents of different templates are planned in one pass.  One fold over two integers for each block numbers the children; one
assembly makes parents and children.  Everything stays in the JVM and needs one shuffle by document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.config import TEMPLATES, ChunkConfig
from docloom.functions import ids, paths, text as t
from docloom.functions.boxes import BOX

MEDIA = ("table", "figure", "caption")
SKIPPED = ("header", "footer", "page_number")

# What opens a chapter, an article, a clause, a question and so on in each kind of document.
_M = "[一二三四五六七八九十百千万零〇两0-9]+"
_L = "[一-鿿0-9〇]+"
CONTRACT_CHAPTER, CONTRACT_ARTICLE = rf"\A\s*(第{_M}[章编部篇卷]|chapter\s+\d+|part\s+\d+)", rf"\A\s*(第{_M}条|article\s+\d+)"
CLAUSE = r"\A\s*([（(][一二三四五六七八九十百千万零〇两0-9a-zA-Z]+[）)]|[①-⑩]|\d+[.)、])"
CONTRACT_END, CONTRACT_ORPHAN = r"[。！？；.!?]\z", r"\A[，、；：…）)]"
PAGE_JUNK = (
    r"\A第\s*\d+\s*页\s*\z",
    r"\A(?i:page)\s+\d+\s*\z",
    r"\A\d{4,6}\s*\z",
    r".*\[\d{4}\].*号\s*\z",
    r".*基本条款第[一二三四五六七八九十百千万\d]+版\s*\z",
)
NUMERIC_ARTICLE = r"\A\s*\d+(\.\d+){0,2}\s+\S+"
LAW_PARENT, LAW_ARTICLE, LAW_ITEM = rf"\A\s*(第{_L}[章节编]|chapter\s+\d+|section\s+\d+)", rf"\A\s*(第{_L}条|article\s+\d+)", r"\A\s*([（(][一-鿿0-9〇a-zA-Z]+[）)]|\d+[.)、])"
BOOK_CHAPTER = r"\A\s*(chapter\s+\d+|book\s+\d+|part\s+\d+|第.+[章节卷篇])"
PAPER_SECTION = r"\A\s*(\d+(\.\d+)*\s+)?(abstract|introduction|background|methods?|methodology|results?|discussion|conclusion|references|appendix)\b"
PROCEDURE, CALLOUT, TROUBLE = r"\A\s*(step\s+\d+|\d+[.)]\s+)", r"\A\s*(warning|caution|note|danger|important)\b", r"troubleshoot|fault|symptom|cause|remedy|maintenance|installation"
QUESTION, ANSWER = r"\A\s*(q(uestion)?\s*[:：]|问[:：]|问题[:：])", r"\A\s*(a(nswer)?\s*[:：]|答[:：]|答案[:：])"


#: Columns that blocks may have beside the required ones.
OPTIONAL = {
    "bbox": BOX, "caption": "string", "markdown": "string", "html": "string", "confidence": "double", "section_id": "string", "heading_level": "int", "heading_reason": "string",
    "sheet_name": "string", "row_index": "int", "columns": "array<string>", "marker_block_id": "string",
    "context": "struct<context_before:string,context_after:string,context_strategy:string,context_block_ids_before:array<string>,context_block_ids_after:array<string>,context_caption_block_ids:array<string>>",
}


def with_optional(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns({n: F.lit(None).cast(kind) for n, kind in OPTIONAL.items() if n not in blocks.columns})


@dataclass(frozen=True)
class Plan:
    """Columns of a template; text, block_type, heading_path and line (the block's first line) can be used."""

    default: str
    opens: Column  # whether a block opens a parent
    title: Column  # its key and title
    breaks: Column
    free: Column
    solo: Column
    kind: Column  # type of the child that the block is in, from its first block
    article: Column | None = None
    keep: Column | None = None  # blocks that take part
    listed: Column | None = None  # of those, blocks that children have too
    body: Column | None = None  # blocks without one of which a child is not made
    follow: bool = False  # until a parent opens, the first heading path's title is the parent


def _media() -> Column:
    return F.col("block_type").isin(*MEDIA)


def _child_kind() -> Column:
    return F.when(_media(), F.col("block_type")).otherwise(F.lit("text"))


def _no() -> Column:
    return F.lit(False)


def _generic(c: ChunkConfig) -> Plan:
    depth = 1 if c.parent_granularity == "chapter" else 2
    return Plan("Document", F.size("heading_path") > 0, F.array_join(F.slice("heading_path", 1, depth), " > "), _no(), _no(), _media(), _child_kind())


def page_junk(text: Column) -> Column:
    """Whether a short block is a page's footer or header: as a whole, or each of its parts between wide gaps."""
    body = t.strip(text)
    one = lambda x: _any([t.matches(x, p) for p in PAGE_JUNK])
    parts = F.filter(F.transform(F.split(body, rf"(?dU){t.SPACE}{{2,}}"), t.strip), lambda x: x != "")
    wide = (F.length(body) > 20) & (F.size(parts) > 1) & F.forall(parts, one)
    return (body != "") & (F.length(body) <= 120) & (one(body) | wide)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for x in tests[1:]:
        out = out | x
    return out


def _contract(c: ChunkConfig) -> Plan:
    line, heading = F.col("line"), F.col("block_type") == "heading"
    article = t.matches(line, CONTRACT_ARTICLE, True)
    clause = t.matches(line, CLAUSE, True)
    real = (line != "") & ~clause & ~t.matches(line, CONTRACT_END) & ~t.matches(line, CONTRACT_ORPHAN) & (F.length(line) <= 30)
    chapter = real & (t.matches(line, CONTRACT_CHAPTER, True) | (heading & ~article))
    begins = article | (heading & t.matches(line, NUMERIC_ARTICLE))
    raw_title = (F.col("block_type") == "title") & ~article & real & (F.size("heading_path") > 0)
    title = F.when(chapter, line).otherwise(F.element_at("heading_path", 1))
    kind = F.when(_media(), F.col("block_type")).otherwise(F.lit("contract_clause"))
    lines = F.filter(F.split("text", "\n"), lambda x: t.strip(x) != "")
    body = ~F.col("block_type").isin("heading", "title") | ~(chapter | begins) | (F.size(lines) > 1)
    return Plan("Document", chapter | raw_title, title, begins, (F.col("block_type") == "list_item") | clause, _media(), kind, F.when(begins & ~chapter, line), listed=~page_junk(F.col("text")), body=body)


def _laws(c: ChunkConfig) -> Plan:
    line = F.col("line")
    article = t.matches(line, LAW_ARTICLE, True)
    kind = F.when(_media(), F.col("block_type")).otherwise(F.lit("legal_article"))
    item = (F.col("block_type") == "list_item") | t.matches(line, LAW_ITEM, True)
    return Plan("Document", t.matches(line, LAW_PARENT, True) & ~article, line, article, item, _media(), kind, F.when(article, line), follow=True)


def _paper(c: ChunkConfig) -> Plan:
    line, title = F.col("line"), F.lower(F.col("parent_title"))
    whole = title.contains("abstract") | title.contains("references")
    kind = F.when(_media(), F.col("block_type")).otherwise(F.lit("paper_text"))
    return Plan("Front Matter", (F.col("block_type") == "heading") | t.matches(line, PAPER_SECTION, True), line, _no(), whole, _media(), kind)


def _book(c: ChunkConfig) -> Plan:
    line, low = F.col("line"), F.lower(F.col("line"))
    heading = F.col("block_type") == "heading"
    named = F.startswith(low, F.lit("preface")) | F.startswith(low, F.lit("appendix")) | F.startswith(low, F.lit("chapter")) | F.startswith(low, F.lit("part "))
    listing = low.isin("contents", "table of contents", "目录", "index", "索引")
    kind = F.when(_media(), F.col("block_type")).otherwise(F.lit("book_section"))
    return Plan("Front Matter", t.matches(line, BOOK_CHAPTER, True) | (heading & named), line, heading, _no(), _media(), kind, keep=~(listing & heading), follow=True)


def _manual(c: ChunkConfig) -> Plan:
    line = F.col("line")
    callout = t.matches(line, CALLOUT, True) & ~_media()
    step = ((F.col("block_type") == "list_item") | t.matches(line, PROCEDURE, True)) & ~callout & ~_media()
    kind = (
        F.when((F.col("block_type") == "table") & t.matches(F.col("text"), TROUBLE, True), "manual_troubleshooting_table")
        .when(_media(), F.col("block_type")).when(callout, "manual_callout").when(step, "manual_procedure").otherwise("manual_text")
    )
    return Plan("Manual", F.col("block_type") == "heading", line, F.col("turns"), step, _media() | callout, kind, follow=True)


def _table(c: ChunkConfig) -> Plan:
    sheet = F.coalesce("sheet_name", F.when(F.size("heading_path") > 0, F.element_at("heading_path", 1)), F.lit("Table"))
    return Plan("Table", F.lit(True), sheet, _no(), _no(), _no(), F.lit("table_row_group"))


def _picture(c: ChunkConfig) -> Plan:
    kind = F.when(_media(), "image_context").otherwise("ocr_text")
    return Plan("Page", F.lit(True), F.concat(F.lit("Page "), F.col("page_number").cast("string")), _no(), _no(), _media(), kind)


def _qa(c: ChunkConfig) -> Plan:
    question = t.matches(F.col("line"), QUESTION, True)
    heading = (F.col("block_type") == "heading") & ~question
    return Plan("QA", heading, F.col("line"), question, F.lit(True), _no(), F.lit("qa_pair"), listed=~heading, follow=True)


PLANNERS: dict[str, Callable[[ChunkConfig], Plan]] = {
    "generic_structured": _generic, "contract_terms": _contract, "laws": _laws, "paper": _paper, "book": _book, "manual": _manual, "table_data": _table, "picture_pdf": _picture, "qa": _qa,
}


def pack(units: Column, budget: int) -> Column:
    """Child number of each of units, array<struct<cjk, latin, breaks, free, solo>>, by greedy packing under a token budget."""
    start = F.struct(F.lit(0).alias("child"), F.lit(0).cast("long").alias("cjk"), F.lit(0).cast("long").alias("latin"), F.lit(False).alias("open"), paths.no_values("int").alias("out"))

    def step(s: Column, u: Column) -> Column:
        over = t.tokens_of(s["cjk"] + u["cjk"], s["latin"] + u["latin"]) > budget
        fresh = u["solo"] | ~s["open"] | u["breaks"] | (over & ~u["free"])
        child = s["child"] + F.when(s["open"] & fresh, 1).otherwise(0)
        return F.struct(
            (child + F.when(u["solo"], 1).otherwise(0)).alias("child"), F.when(fresh, u["cjk"]).otherwise(s["cjk"] + u["cjk"]).alias("cjk"),
            F.when(fresh, u["latin"]).otherwise(s["latin"] + u["latin"]).alias("latin"), (~u["solo"]).alias("open"), paths.appended(s["out"], child).alias("out"),
        )

    return F.aggregate(units, start, step, lambda s: paths.all_values(s["out"]))


_UNIT = ("page_number", "reading_order", "block_id", "block_type", "text", "body", "heading_path", "bbox", "row_index", "columns", "sheet_name", "marker_block_id", "context")


def planned(blocks: DataFrame, names: tuple[str, ...], config: ChunkConfig) -> DataFrame:
    """Content blocks of documents with a ``template`` among names, with parent_key, pos (in the parent) and, where children have the block, child_no and kind."""
    plans = {name: PLANNERS[name](config) for name in names}

    def chosen(get: Callable[[Plan], Column | None], other: Column) -> Column:
        out = other
        for name, plan in plans.items():
            if (column := get(plan)) is not None:
                out = F.when(F.col("template") == name, column).otherwise(out)
        return out

    none = F.lit(None).cast("string")
    body = with_optional(blocks).filter(~F.col("block_type").isin(*SKIPPED) & (t.strip(F.coalesce("text", F.lit(""))) != "")).withColumn("line", t.first_line(F.col("text")))
    body = body.withColumn("body", F.when(F.col("markdown") != "", F.col("markdown")).otherwise(F.col("text")))
    order = Window.partitionBy("document_id").orderBy("page_number", "reading_order")
    step = (F.col("block_type") == "list_item") | t.matches(F.col("line"), PROCEDURE, True)
    body = body.withColumn("turns", F.coalesce(step != F.lag(step).over(order), F.lit(False)))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    top = F.when(F.size("heading_path") > 0, F.element_at("heading_path", 1))
    body = body.filter(chosen(lambda p: p.keep, F.lit(True)))
    opened = F.last(F.when(chosen(lambda p: p.opens, _no()), chosen(lambda p: p.title, none)), True).over(running)
    first = F.first(F.when(chosen(lambda p: F.lit(p.follow), _no()), top), True).over(running)
    body = body.withColumn("parent_title", F.coalesce(opened, first, chosen(lambda p: F.lit(p.default), F.lit("Document"))))
    # what stands before a paper's first section goes by the heading that it has, but is one parent
    front = F.when((F.col("template") == "paper") & (F.col("parent_title") == "Front Matter"), top)
    unit = F.struct(
        *_UNIT, front.alias("front"), chosen(lambda p: p.kind, F.lit("text")).alias("kind"), chosen(lambda p: p.article, none).alias("article"), chosen(lambda p: p.listed, F.lit(True)).alias("listed"), chosen(lambda p: p.body, F.lit(True)).alias("has_body"),
        t.cjk_count(F.col("body")).alias("cjk"), t.latin_count(F.col("body")).alias("latin"), chosen(lambda p: p.breaks, _no()).alias("breaks"), chosen(lambda p: p.free, _no()).alias("free"), chosen(lambda p: p.solo, _no()).alias("solo"),
        t.matches(F.col("line"), QUESTION, True).alias("asks"), t.matches(F.col("line"), ANSWER, True).alias("answers"), F.col("line").alias("line"),
    )
    # a column of its own: in an aggregate it would be interpreted, not compiled
    grouped = body.withColumn("unit", unit).groupBy("document_id", "template", "parent_title").agg(F.sort_array(F.collect_list("unit")).alias("units"))
    return grouped.withColumn("listed", F.filter("units", lambda u: u["listed"])).withColumn("numbers", pack(F.transform("listed", lambda u: F.struct(u["cjk"], u["latin"], u["breaks"], u["free"], u["solo"])), config.child_max_tokens))


def chunk(blocks: DataFrame, template: str, config: ChunkConfig = ChunkConfig()) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of settled blocks(document_id, block_id, page_number, reading_order, block_type, text, heading_path), all by one template."""
    return chunk_typed(blocks.withColumn("template", F.lit(template)), config, (template,))


def chunk_typed(blocks: DataFrame, config: ChunkConfig = ChunkConfig(), names: tuple[str, ...] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of settled blocks with the ``template`` that each document goes by."""
    groups = planned(blocks, names, config)
    all_of = lambda name: F.transform("units", lambda x: x[name])
    fronts = F.filter(all_of("front"), lambda x: x.isNotNull())
    title = F.when(F.size(fronts) > 0, F.get(fronts, F.size(fronts) - 1)).otherwise(F.col("parent_title"))
    # a generic parent is a section of the document; those of other templates have keys of their own
    generic, depth = F.col("template") == "generic_structured", 1 if config.parent_granularity == "chapter" else 2
    section = F.slice(F.col("units")[0]["heading_path"], 1, depth)
    groups = groups.withColumn("parent_path", F.when(generic & (F.size(section) > 0), section).otherwise(F.array(title)))
    own = ids.stable_hash("template-section", F.col("document_id"), F.col("parent_title"))
    groups = groups.withColumn("section_key", F.when(generic, ids.section_id(F.col("document_id"), F.col("parent_path"))).otherwise(own))
    groups = groups.withColumn("parent_id", ids.parent_id(F.col("document_id"), F.col("section_key"))).withColumn("title", F.element_at("parent_path", -1))
    groups = groups.withColumn("parent_order", F.struct(F.col("units")[0]["page_number"].alias("page_number"), F.col("units")[0]["reading_order"].alias("reading_order")))
    text = F.when(F.col("template") == "generic_structured", F.array_join(all_of("text"), "\n\n")).otherwise(F.array_join(all_of("body"), "\n\n"))
    parents = groups.select(
        "document_id", "parent_id", F.col("section_key").alias("section_id"), "title", F.col("parent_path").alias("heading_path"), text.alias("text"),
        F.array_min(all_of("page_number")).alias("page_start"), F.array_max(all_of("page_number")).alias("page_end"), all_of("block_id").alias("source_block_ids"), "parent_order",
    )
    each = groups.select("document_id", "template", "parent_id", "title", "parent_order", F.posexplode(F.arrays_zip("listed", "numbers")).alias("pos", "x")).select("document_id", "template", "parent_id", "title", "parent_order", "pos", F.col("x.numbers").alias("child_no"), "x.listed.*")
    member = F.struct("pos", "block_id", "block_type", "text", "body", "heading_path", "kind", "article", "page_number", "bbox", "row_index", "columns", "sheet_name", "context", "has_body", "asks", "answers", "line")
    children = each.groupBy("document_id", "template", "parent_id", "title", "parent_order", "child_no").agg(F.sort_array(F.collect_list(member)).alias("members"))
    part = lambda name: F.transform("members", lambda x: x[name])
    some = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    lead = F.col("members")[0]
    # an article's label: the last one that began in the child; a contract's goes on through its parent
    found = some(part("article"))
    within = Window.partitionBy("document_id", "parent_id").orderBy("child_no")
    own = F.when((F.size(found) > 0) & F.col("template").isin("contract_terms", "laws"), F.element_at(found, -1))
    children = children.withColumn("article", own)
    carried = F.last("article", True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    children = children.withColumn("article", F.when(F.col("template") == "contract_terms", carried).otherwise(F.col("article")))
    children = children.withColumn("last_no", F.max("child_no").over(Window.partitionBy("document_id", "parent_id"))).filter(F.exists(part("has_body"), lambda x: x))
    children = children.withColumn("child_index", (F.row_number().over(within) - 1).cast("int"))
    path = F.array("title")
    heading = F.when(F.col("template") == "generic_structured", lead["heading_path"]).when(F.col("article").isNotNull() & (F.col("article") != F.col("title")), F.array("title", "article")).otherwise(path)
    low, ends = F.lower("title"), F.col("child_no") == F.col("last_no")
    typed = (
        F.when((F.col("template") == "generic_structured") & F.forall(part("block_type"), lambda x: x == "list_item"), "list")
        .when((lead["kind"] == "paper_text") & ends & low.contains("abstract"), "paper_abstract").when((lead["kind"] == "paper_text") & ends & low.contains("references"), "paper_references")
        .otherwise(lead["kind"])
    )
    joined = F.array_join(part("body"), "\n\n")
    children = children.withColumn("heading", heading).withColumn("chunk_text", F.when(F.size("heading") > 0, t.with_heading(joined, F.col("heading"))).otherwise(t.strip(joined)))
    answers = F.transform(F.filter("members", lambda x: ~x["asks"]), lambda x: F.when(x["answers"], t.without_marker(x["text"], ANSWER)).otherwise(x["text"]))
    # before the first question and answer there is nothing that a block could add to
    plain = ~F.coalesce(lead["asks"], F.lit(False)) & ~F.coalesce(lead["answers"], F.lit(False))
    answers = F.when(plain, F.slice(answers, 2, F.greatest(F.size(answers), F.lit(1)))).otherwise(answers)
    is_qa, is_rows = F.col("template") == "qa", F.col("template") == "table_data"
    blocks_of = part("block_id")
    refs = F.transform(F.filter("members", lambda x: x["bbox"].isNotNull()), lambda x: F.struct(x["block_id"].alias("block_id"), x["page_number"].alias("page_number"), x["bbox"].alias("bbox")))
    children = children.select(
        "document_id", "parent_id", ids.child_id(F.col("document_id"), F.col("template"), F.col("parent_id"), F.col("child_index"), blocks_of).alias("chunk_id"), "child_index", typed.alias("chunk_type"), "template",
        F.col("chunk_text").alias("text"), F.array_min(part("page_number")).alias("page_start"), F.array_max(part("page_number")).alias("page_end"), blocks_of.alias("source_block_ids"), F.col("heading").alias("heading_path"),
        t.estimate_tokens(F.col("chunk_text")).alias("token_count"), F.nullif("article", F.lit("")).alias("article"), "parent_order", refs.alias("bbox_refs"), part("block_type").alias("block_types"),
        F.when(is_qa & F.exists(part("asks"), lambda x: x), t.without_marker(F.element_at(F.transform(F.filter("members", lambda x: x["asks"]), lambda x: x["line"]), -1), QUESTION)).alias("question"),
        F.when(is_qa, F.nullif(t.strip(F.array_join(answers, "\n\n")), F.lit(""))).alias("answer"),
        F.when(typed.isin(*MEDIA), lead["context"]).alias("context"),
        F.when(is_rows, F.array_min(part("row_index"))).alias("row_start"), F.when(is_rows, F.array_max(part("row_index"))).alias("row_end"), F.when(is_rows, lead["columns"]).alias("columns"), F.when(is_rows, lead["sheet_name"]).alias("sheet_name"),
    )
    return parents, children.select(*[x for x in children.columns if x != "context"], "context.*")


def article_parts(children: DataFrame) -> DataFrame:
    """Children with article_part_index and article_part_count where an article of a contract's parent has several."""
    by = Window.partitionBy("document_id", "parent_id", "article")
    many = F.col("article").isNotNull() & (F.col("template") == "contract_terms") & (F.count("*").over(by) > 1)
    return children.withColumn("article_part_index", F.when(many, F.row_number().over(by.orderBy("child_index")))).withColumn("article_part_count", F.when(many, F.count("*").over(by)))
