"""Packages as JSON, snapshots and debug views, and the whole way from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.config import ChunkConfig
from docloom.functions import text as t
from docloom.operators import quality
from docloom.plans.chunking import Package, chunk_package, kept_table
from docloom.sources import router


def _listed(rows: DataFrame, name: str, *order: str, without: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, name): a document's rows as an ordered list."""
    own = [c for c in rows.columns if c not in ("document_id", *without)]
    pos = F.struct(*order).alias("pos")
    return rows.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(pos, F.struct(*own).alias("x")))), lambda y: y["x"]).alias(name))


def _joined(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.join(other, "document_id", "left")
    return first


def package_json(package: Package, include_blocks: bool = True, include_debug: bool = False) -> DataFrame:
    """(document_id, json): a document's package as one JSON object.  Nesting happens here only; a document is one row."""
    parts = [
        _listed(package.parents, "parent_chunks", "parent_order", without=("parent_order",)), _listed(package.children, "child_chunks", "parent_order", "child_index", "chunk_id", without=("parent_order",)),
        _listed(quality.messages(package.faults()).select("document_id", "code", "message"), "warnings", "code", "message"),
    ]
    if include_blocks:
        parts.append(_listed(package.blocks, "blocks", "page_number", "reading_order", "block_id"))
    out = _joined(package.summary(), *parts)
    if include_debug:
        out = out.join(debug(package).withColumnRenamed("document_id", "of"), F.col("document_id") == F.col("of"), "left").drop("of")
    return out.select("document_id", F.to_json(F.struct(*out.columns)).alias("json"))


def write_json(package: Package, folder: str, **options) -> None:
    """One line of JSON for each document, under ``folder``."""
    package_json(package, **options).select("json").write.text(folder)


#: Fields that a child's metadata has, by template.
_METADATA = {
    "contract_terms": ("article", "template_rule"), "laws": ("article", "template_rule"), "paper": ("section", "template_rule"), "qa": ("answer", "question", "template_rule"), "table_data": ("columns", "row_end", "row_start", "sheet_name", "template_rule"),
}


def metadata_keys() -> Column:
    """Names of the fields that a child's metadata has, sorted."""
    own = F.coalesce(*[F.when(F.col("template") == name, F.array(*map(F.lit, keys))) for name, keys in _METADATA.items()], F.when(F.col("template") != "generic_structured", F.array(F.lit("template_rule"))), F.array().cast("array<string>"))
    more = [("article_part_index", ("article_part_count", "article_part_index")), ("context_strategy", ("context_block_ids_after", "context_block_ids_before", "context_caption_block_ids", "context_strategy")), ("part_index", ("original_chunk_id", "overlong_split", "split_part_count", "split_part_index"))]
    extra = [F.when(F.col(c).isNotNull(), F.array(*map(F.lit, keys))).otherwise(F.array().cast("array<string>")) for c, keys in more]
    return F.array_sort(F.concat(F.array(F.lit("block_types")), own, *extra))


def snapshot(package: Package) -> DataFrame:
    """(document_id, snapshot): what two runs can be compared by: counts, metrics, parents and children without their ids."""
    c = package.children
    children = c.select("document_id", F.struct("parent_order", "child_index", "chunk_id").alias("at"), "chunk_type", "heading_path", F.array("page_start", "page_end").alias("page_span"), F.size("source_block_ids").alias("source_blocks"), "token_count", metadata_keys().alias("metadata_keys"), t.preview(F.col("text")).alias("text_preview"))
    parents = package.parents.select("document_id", "parent_order", "title", F.size("child_chunk_ids").alias("child_count"), F.array("page_start", "page_end").alias("page_span"))
    out = _joined(package.summary(), _listed(children, "children", "at", without=("at",)), _listed(parents, "parents", "parent_order", without=("parent_order",)))
    names = [n for n in out.columns if n not in ("document_id", "signals", "requested", "confidence")]
    return out.select("document_id", F.struct(*sorted(names)).alias("snapshot"))


def debug(package: Package) -> DataFrame:
    """(document_id, section_tree, with_bbox, with_section, parent_child_graph, orphan_child_ids)."""
    b = package.blocks.groupBy("document_id").agg(F.count_if(F.col("bbox").isNotNull()).alias("with_bbox"), F.count_if(F.col("section_id").isNotNull()).alias("with_section"))
    graph = package.parents.select("document_id", "parent_order", "parent_id", "title", F.array("page_start", "page_end").alias("page_span"), F.size("child_chunk_ids").alias("child_count"), "child_chunk_ids")
    orphans = package.children.join(package.parents.select("document_id", "parent_id"), ["document_id", "parent_id"], "left_anti").groupBy("document_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("orphan_child_ids"))
    tree = package.sections.select("document_id", "section_id", "parent_section_id", "title", "level", "page_start", "page_end", "heading_path")
    return _joined(b, _listed(tree, "section_tree", "page_start", "heading_path"), _listed(graph, "parent_child_graph", "parent_order", without=("parent_order",)), orphans)


def edges(parents: DataFrame) -> DataFrame:
    """(document_id, parent_id, chunk_id, place) of what parents list."""
    return parents.select("document_id", "parent_id", F.posexplode("child_chunk_ids").alias("place", "chunk_id"))


def chunk_files(spark: SparkSession, path: str, config: ChunkConfig = ChunkConfig()) -> Package:
    """The package of all files under a path."""
    found = router.read_files(spark, path, config.parser)
    return chunk_package(found.blocks, config, kept_table(found.documents)).materialize()


def register_functions(spark: SparkSession) -> None:
    """SQL functions for a session: estimate_tokens(text), stable_hash32(text)."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION estimate_tokens(c STRING) RETURNS BIGINT RETURN
        regexp_count(c, r'{t.CJK}') + floor(regexp_count(c, r"{t.LATIN}") * 13 / 10)""")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION stable_hash32(c STRING) RETURNS STRING RETURN substring(sha2(c, 256), 1, 32)")


def capabilities() -> dict:
    """Which parsers there are and which of them can be used, and the templates."""
    from docloom.config import TEMPLATES

    found = router.available()
    return {"parsers": found, "default_parser": next((n for n, ok in found.items() if ok), "pypdf"), "templates": ["auto", *TEMPLATES]}
