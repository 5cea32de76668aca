"""Metrics, validation and monitoring of parents and children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.config import ChunkConfig
from docloom.functions import boxes, text as t

MEDIA_CHUNKS = ("table", "figure", "caption", "image_context")


def _counts(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(document_id, name): map of how often each value occurs in a document; null values aren't counted."""
    each = rows.select("document_id", value.cast("string").alias("value")).filter("value is not null").groupBy("document_id", "value").agg(F.count("*").alias("n"))
    return each.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n")))).alias(name))


def metrics(parents: DataFrame, children: DataFrame, config: ChunkConfig = ChunkConfig(), blocks: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """A row for each document with its measures; those that need blocks (or removed: document_id, removed) are there if these are given.

    Columns that a package may lack (part_index, bbox_refs, context_*, repairs, child_chunk_ids) count as absent.
    """
    col = lambda name, kind: F.col(name) if name in children.columns else F.lit(None).cast(kind)
    known = parents.select("document_id", "parent_id").distinct().withColumn("known", F.lit(1))
    covered = (col("context_before", "string").isNotNull() | col("context_after", "string").isNotNull()).cast("double")
    share = lambda *kinds: F.coalesce(F.avg(F.when(F.col("chunk_type").isin(*kinds), covered)), F.lit(1.0))
    c = children.join(known, ["document_id", "parent_id"], "left").groupBy("document_id").agg(
        F.count("*").alias("child_count"), F.count_if(F.col("known").isNull()).alias("orphan_child_count"), F.count_if(F.size("source_block_ids") == 0).alias("chunks_without_source_block_count"),
        F.count_if(F.coalesce(F.size(col("bbox_refs", "array<int>")), F.lit(0)) > 0).alias("chunks_with_bbox_refs_count"),
        F.count_if(F.col("token_count") > config.child_max_tokens).alias("over_max_token_child_count"), F.count_if(col("part_index", "int").isNotNull()).alias("split_overlong_child_count"),
        F.coalesce(F.sum(col("repairs", "long")), F.lit(0)).alias("boundary_repair_count"), share("table").alias("table_context_coverage"), share("figure", "image_context").alias("figure_context_coverage"),
        F.sum("token_count").alias("tokens"), F.max("token_count").alias("max_tokens_per_child"), F.min("token_count").alias("min_tokens_per_child"),
    )
    edges = F.sum(F.size("child_chunk_ids")) if "child_chunk_ids" in parents.columns else F.lit(0)
    p = parents.groupBy("document_id").agg(F.count("*").alias("parent_count"), edges.cast("long").alias("parent_child_edge_count"))
    out = p.join(c, "document_id", "full").join(_counts(children, F.col("chunk_type"), "child_type_counts"), "document_id", "left").join(_counts(children, col("context_strategy", "string"), "media_context_strategy_counts"), "document_id", "left")
    if blocks is not None:
        reasons = blocks.groupBy("document_id").agg(F.count_if(F.col("heading_reason").endswith("_pattern")).alias("inferred_heading_count"))
        out = out.join(reasons, "document_id", "full").join(_counts(blocks, F.col("block_type"), "block_type_counts"), "document_id", "left").join(_counts(blocks, F.col("heading_level"), "heading_level_counts"), "document_id", "left")
    if removed is not None:
        out = out.join(removed.select("document_id", F.col("removed").alias("layout_noise_removed_count")), "document_id", "left")
    none = F.create_map().cast("map<string,bigint>")
    value = lambda n: F.coalesce(n, none if n.endswith("_counts") else F.lit(1.0) if n.endswith("_coverage") else F.lit(0)).alias(n)
    names = [n for n in out.columns if n not in ("document_id", "tokens")]
    return out.select("document_id", *map(value, names), F.coalesce(F.col("tokens") / F.col("child_count"), F.lit(0.0)).alias("avg_tokens_per_child"))


def distributions(blocks: DataFrame, children: DataFrame) -> DataFrame:
    """(what, value, n) of block types, heading levels, child types and context strategies over all documents."""
    found = [(blocks, "block_type"), (blocks, "heading_level"), (children, "chunk_type"), (children, "context_strategy")]
    each = [rows.select(F.lit(what).alias("what"), F.col(what).cast("string").alias("value")) for rows, what in found if what in rows.columns]
    out = each[0]
    for x in each[1:]:
        out = out.union(x)
    return out.filter("value is not null").groupBy("what", "value").agg(F.count("*").alias("n"))


def context_coverage(children: DataFrame) -> DataFrame:
    """(document_id, table_context_coverage, figure_context_coverage); 1 where there is none to cover."""
    covered = (F.coalesce("context_before", "context_after")).isNotNull().cast("double")
    share = lambda *kinds: F.coalesce(F.avg(F.when(F.col("chunk_type").isin(*kinds), covered)), F.lit(1.0))
    return children.groupBy("document_id").agg(share("table").alias("table_context_coverage"), share("figure", "image_context").alias("figure_context_coverage"))


def page_table(blocks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(document_id, page_number, width, height, block_ids): pages that blocks are on, and those in sizes(document_id, page_number, width, height) without any."""
    order = "block_pos" if "block_pos" in blocks.columns else "reading_order"
    pages = blocks.groupBy("document_id", "page_number").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "block_id"))), lambda x: x["block_id"]).alias("block_ids"))
    if sizes is None:
        return pages.select("document_id", "page_number", F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"), "block_ids")
    return sizes.join(pages, ["document_id", "page_number"], "full").select("document_id", "page_number", "width", "height", F.coalesce("block_ids", F.array().cast("array<string>")).alias("block_ids"))


def block_counts(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(document_id, page_count, block_count, table_count, figure_count)."""
    found = blocks.groupBy("document_id").agg(
        F.count_distinct("page_number").alias("page_count"), F.count("*").alias("block_count"), F.count_if(F.col("block_type") == "table").alias("table_count"), F.count_if(F.col("block_type") == "figure").alias("figure_count")
    )
    if pages is None:
        return found
    sizes = pages.groupBy("document_id").agg(F.count("*").alias("pages"))
    return found.join(sizes, "document_id", "left").withColumn("page_count", F.coalesce("pages", "page_count")).drop("pages")


def _fault(rows: DataFrame, code: str, subject: str, position: Column | None = None) -> DataFrame:
    return rows.select("document_id", F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject"))


def _union(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def validate(parents: DataFrame, children: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, code, subject): what is wrong with a package.  No row, no fault.

    parents: document_id, parent_id, child_chunk_ids.  children: document_id, chunk_id, parent_id, chunk_type, source_block_ids, page_start, page_end.
    """
    by = ["document_id", "chunk_id"]
    again = children.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("parent_id"))).filter("n > 1")
    there = parents.select("document_id", "parent_id").distinct()
    orphan = children.join(there, ["document_id", "parent_id"], "left_anti")
    edges = parents.select("document_id", "parent_id", F.explode("child_chunk_ids").alias("chunk_id"))
    missing = edges.join(children.select(*by).distinct(), by, "left_anti")
    unlisted = children.join(edges, ["document_id", "parent_id", "chunk_id"], "left_anti").join(there, ["document_id", "parent_id"], "left_semi")
    media = blocks.filter(F.col("block_type").isin("table", "figure")).select("document_id", "block_id")
    used = children.select("document_id", "chunk_type", F.explode("source_block_ids").alias("block_id"))
    swallowed = used.filter(~F.col("chunk_type").isin(*MEDIA_CHUNKS)).join(media, ["document_id", "block_id"]).select("document_id", "block_id").distinct()
    return _union([
        _fault(again, "duplicate_chunk", "chunk_id"), _fault(orphan, "missing_parent", "chunk_id"), _fault(missing, "missing_child", "chunk_id"), _fault(unlisted, "not_listed_in_parent", "chunk_id"),
        _fault(children.filter(F.size("source_block_ids") == 0), "no_source", "chunk_id"), _fault(children.filter("page_start <= 0 or page_start > page_end"), "invalid_page_span", "chunk_id"),
        _fault(swallowed, "media_in_text_child", "block_id"),
    ])


def validate_blocks(blocks: DataFrame, pages: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """(document_id, code, subject): what is wrong with blocks(document_id, block_id, page_number, reading_order, block_pos, bbox).

    Repeated ids, pages below 1, boxes without area, and each page's first step back in reading order; with pages (page_table()) also blocks
    on pages that aren't there, that their page doesn't list, or with a box outside of it; with sections (section_table()) also
    blocks with a path, and sections with a parent, that isn't there, without a title, or that end before they begin.
    """
    by = Window.partitionBy("document_id", "page_number").orderBy("block_pos")
    back = blocks.withColumn("was", F.lag("reading_order").over(by)).filter("reading_order < was")
    firsts = back.groupBy("document_id", "page_number").agg(F.min_by("block_id", "block_pos").alias("block_id"))
    again = blocks.withColumn("n", F.row_number().over(Window.partitionBy("document_id", "block_id").orderBy("block_pos"))).filter("n > 1")
    found = [_fault(again, "duplicate_block", "block_id"), _fault(blocks.filter("page_number <= 0"), "invalid_page", "block_id"), _fault(firsts, "reading_order", "block_id")]
    if "bbox" in blocks.columns:
        found.append(_fault(blocks.filter("bbox.x0 = bbox.x1 or bbox.y0 = bbox.y1"), "empty_box", "block_id"))
    if pages is not None:
        met = blocks.join(pages.withColumn("there", F.lit(True)), ["document_id", "page_number"], "left")
        found += [_fault(met.filter("there is null"), "missing_page", "block_id"), _fault(met.filter(F.col("there") & ~F.array_contains("block_ids", F.col("block_id"))), "not_listed_in_page", "block_id")]
        if "bbox" in blocks.columns:
            found.append(_fault(met.filter(F.col("there") & F.col("bbox").isNotNull() & ~boxes.inside(F.col("bbox"), F.col("width"), F.col("height"))), "box_outside_page", "block_id"))
    if sections is not None:
        known = sections.select("document_id", "heading_path").distinct()
        ids = sections.select("document_id", F.col("section_id").alias("parent_section_id")).distinct()
        found += [
            _fault(blocks.filter(F.size("heading_path") > 0).join(known, ["document_id", "heading_path"], "left_anti"), "path_without_section", "block_id"), _fault(sections.filter(t.strip(F.col("title")) == ""), "section_without_title", "section_id"),
            _fault(sections.filter("page_start > page_end"), "section_ends_early", "section_id"), _fault(sections.filter("parent_section_id is not null").join(ids, ["document_id", "parent_section_id"], "left_anti"), "missing_parent_section", "section_id"),
        ]
    return _union(found)


# What a fault's code says to a reader, with the subject's place.
MESSAGES = {
    "duplicate_chunk": "Duplicate chunk_id: %s", "missing_parent": "Child %s references missing parent.", "missing_child": "Missing child %s is listed by its parent.", "not_listed_in_parent": "Child %s not listed in its parent.",
    "no_source": "Child %s has no source_block_ids.", "invalid_page_span": "Child %s has invalid page_span.", "media_in_text_child": "Media block %s is referenced by a non-media child.",
    "duplicate_block": "Duplicate block_id: %s", "invalid_page": "Block %s has invalid page_number.", "reading_order": "Block %s steps back in reading_order.", "empty_box": "Block %s has zero-area bbox.",
    "missing_page": "Block %s references a missing page.", "not_listed_in_page": "Block %s is missing from page block_ids.", "box_outside_page": "Block %s bbox is outside page bounds.",
    "path_without_section": "Block %s has a heading_path that is no section.", "section_without_title": "Section %s has empty title.", "section_ends_early": "Section %s ends before it begins.", "missing_parent_section": "Section %s references a missing parent.",
    "no_blocks": "Document %s has no blocks.", "layout_noise": "[layout_noise] removed blocks: %s", "boundary_repair": "[boundary_repair] joined: %s", "small_chunk_merge": "[small_chunk_merge] into %s", "overlong_split": "[overlong_split] split %s",
    "parser": "Parser %s",
}


def messages(faults: DataFrame) -> DataFrame:
    """faults(document_id, code, subject) with a message and the group that the monitor counts it in."""
    text = F.coalesce(*[F.when(F.col("code") == code, F.format_string(shape, "subject")) for code, shape in MESSAGES.items()], F.col("code"))
    group = F.when(text.startswith("["), F.regexp_extract(text, r"\A\[([^\]]*)\]", 1)).when(text.contains("Parser "), "parser").otherwise("general")
    return faults.withColumn("message", text).withColumn("group", group)


def risk_reasons(children: DataFrame) -> DataFrame:
    """children with the reasons for which a reader should look at them."""
    start = F.substring("text", 1, 1)
    part = F.col("part_index").isNotNull() if "part_index" in children.columns else F.col("chunk_id").contains(":part")
    reasons = F.array_compact(F.array(
        F.when(F.size("source_block_ids") == 0, F.lit("missing_source")), F.when(part, F.lit("overlong_split")), F.when(F.col("token_count") == 0, F.lit("empty_tokens")),
        F.when((F.col("text") == "") | start.isin(*",.;:!?，。；：！？、"), F.lit("starts_with_punctuation")),
    ))
    return children.withColumn("reasons", reasons)


def risk_samples(children: DataFrame, most: int = 5, largest: int = 3) -> DataFrame:
    """For each document the first ``most`` children with a reason; if there are fewer, also the ``largest`` by tokens, as far as they fit.

    With place, reasons and a preview of 240 characters.
    """
    by = Window.partitionBy("document_id")
    flagged = risk_reasons(children).withColumn("risky", F.size("reasons") > 0)
    ranked = flagged.withColumn("risk_rank", F.row_number().over(by.orderBy(F.col("risky").desc(), "parent_order", "child_index", "chunk_id")))
    ranked = ranked.withColumn("size_rank", F.row_number().over(by.orderBy(F.col("token_count").desc(), "parent_order", "child_index", "chunk_id"))).withColumn("risks", F.count_if("risky").over(by))
    chosen = ranked.filter((F.col("risky") & (F.col("risk_rank") <= most)) | (~F.col("risky") & (F.col("size_rank") <= largest) & (F.col("risks") < most)))
    place = F.row_number().over(by.orderBy(F.col("risky").desc(), F.when(F.col("risky"), F.col("risk_rank")).otherwise(F.col("size_rank"))))
    reasons = F.when(F.col("risky"), F.col("reasons")).otherwise(F.array(F.lit("largest_chunk")))
    return chosen.withColumn("place", place).filter(F.col("place") <= most).withColumn("reasons", reasons).withColumn("preview", F.substring("text", 1, 240))


def warning_groups(warnings: DataFrame, examples: int = 3) -> DataFrame:
    """(code, n, first_pos, examples, place) of warnings(pos, code, message); place: most frequent first, then first seen."""
    ranked = warnings.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("pos")))
    few = F.sort_array(F.collect_list(F.when(F.col("rank") <= examples, F.struct("pos", "message"))))
    found = ranked.groupBy("code").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.transform(few, lambda x: x["message"]).alias("examples"))
    # one row for each code is all that is ordered
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "first_pos")).cast("int"))


def search(children: DataFrame, query: str) -> DataFrame:
    """Children whose text has the query, whatever the case."""
    return children.filter(F.lower("text").contains(query.lower()))


# ----------------------------------------------------------------------------------------------------- monitor


def health_checks(summary: DataFrame) -> DataFrame:
    """(document_id, name, status, detail) of summary(document_id, parser_used, block_count, section_count, and the metrics)."""
    # fixed values: what the checks say
    said = lambda n, words: F.concat(F.col(n).cast("string"), F.lit(words))
    checks = [
        ("parser", F.col("parser_used").isNotNull(), F.concat(F.lit("Used "), F.col("parser_used")), F.lit("No parser result was recorded.")),
        ("blocks", F.col("block_count") > 0, said("block_count", " blocks"), F.lit("No blocks were extracted; check parser availability or file readability.")),
        ("sections", F.col("section_count") > 0, said("section_count", " sections"), F.lit("No section tree was detected; heading rules may need tuning.")),
        ("sources", F.col("chunks_without_source_block_count") == 0, F.lit("All chunks have source blocks"), said("chunks_without_source_block_count", " chunks have no source block.")),
        ("tokens", F.col("over_max_token_child_count") == 0, F.lit("No child chunk exceeds the configured limit"), said("over_max_token_child_count", " child chunks exceed the configured limit.")),
        ("relations", F.col("orphan_child_count") == 0, F.lit("No orphan child chunks"), said("orphan_child_count", " child chunks do not map to a parent.")),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), F.when(ok, "ok").otherwise("warning").alias("status"), F.when(ok, good).otherwise(bad).alias("detail")) for i, (n, ok, good, bad) in enumerate(checks, 1)])
    return summary.select("document_id", F.explode(rows).alias("x")).select("document_id", "x.*")


def execution_chain(summary: DataFrame) -> DataFrame:
    """(document_id, place, stage, status) of the six stages that a document went through."""
    stages = [
        ("upload", F.lit(True)), ("parse", F.col("block_count") > 0), ("normalize", F.lit(True)), ("detect_type", F.col("confidence") >= 0.5), ("chunk", F.col("child_count") > 0), ("postprocess", F.col("warning_count") == 0),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("stage"), F.when(ok, "ok").otherwise("warning").alias("status")) for i, (n, ok) in enumerate(stages, 1)])
    return summary.select("document_id", F.explode(rows).alias("x")).select("document_id", "x.*")


def suggestions(summary: DataFrame) -> DataFrame:
    """(document_id, suggestions): what to look at, in order."""
    # fixed values: what is suggested
    tests = [
        (F.col("block_count") == 0, "Parser produced no blocks; try a different parser or inspect parser availability."),
        ((F.col("inferred_heading_count") == 0) & ~F.col("document_type").isin("table_data", "qa"), "Few or no inferred headings; add heading patterns for this document style if chunks look too broad."),
        (F.col("over_max_token_child_count") > 0, "Some chunks exceed the token budget; tune child_max_tokens or improve section boundaries."),
        (F.col("chunks_without_source_block_count") > 0, "Chunks without source blocks indicate a chunker bug or missing source propagation."),
        (F.col("boundary_repair_count") > 0, "Boundary repair fired; inspect cross-page chunks and consider layout/header cleanup rules."),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(words)) for test, words in tests]))
    none = F.array(F.lit("No high-priority quality issue detected; inspect sample chunks for semantic completeness."))
    return summary.select("document_id", F.when(F.size(found) > 0, found).otherwise(none).alias("suggestions"))
