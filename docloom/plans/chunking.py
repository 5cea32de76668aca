"""The whole way from blocks to packages."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docloom.config import TEMPLATES, ChunkConfig
from docloom.functions.boxes import BOX
from docloom.operators import doctype, markers, noise, post, quality, sections, templates


@dataclass(frozen=True)
class Package:
    """Tables of a chunking run, all keyed by document_id.  They are plans: what isn't read isn't computed.

    Faults, metrics and outputs read blocks and children many times: materialize() first.
    """

    blocks: DataFrame
    planned_parents: DataFrame
    children: DataFrame
    removed: DataFrame
    pages: DataFrame
    config: ChunkConfig = field(default_factory=ChunkConfig)
    parsed: DataFrame | None = None
    #: The same package with each of its tables handed to a function as soon as it is planned.
    again: Callable[[Callable[[DataFrame], DataFrame]], Package] | None = None
    kept_parents: DataFrame | None = None
    kept_sections: DataFrame | None = None

    def materialize(self) -> Package:
        """The same with its tables behind reliable checkpoints in the folder that the session names, each made from those before it."""
        made = self.again(kept_table) if self.again else self
        own = {"removed": kept_table(made.removed), "pages": kept_table(made.pages)}
        if not self.again:
            own |= {name: kept_table(getattr(made, name)) for name in ("blocks", "planned_parents", "children")}
        made = replace(made, **own, again=None)
        return replace(made, kept_parents=kept_table(made.parents), kept_sections=kept_table(made.sections))

    @property
    def parents(self) -> DataFrame:
        return with_children(self.planned_parents, self.children) if self.kept_parents is None else self.kept_parents

    @property
    def sections(self) -> DataFrame:
        return sections.section_table(self.blocks) if self.kept_sections is None else self.kept_sections

    @property
    def types(self) -> DataFrame:
        return doctype.detect(self.blocks, self.config.template)

    def faults(self) -> DataFrame:
        """(document_id, code, subject) of all that was noticed: what parsing said, noise, blocks, passes, and the package itself."""
        c = self.children
        row = lambda rows, code, subject: rows.select("document_id", F.lit(code).alias("code"), subject.cast("string").alias("subject"))
        each = lambda n: F.explode(F.sequence(F.lit(1), F.col(n)))
        repaired = c.filter("repairs > 0").select("document_id", "chunk_id", each("repairs").alias("i"))
        merged = c.filter("merges > 0 and coalesce(part_index, 1) = 1").select("document_id", F.coalesce("original_chunk_id", "chunk_id").alias("chunk_id"), each("merges").alias("i"))
        found = [
            row(self.removed, "layout_noise", F.col("removed")), quality.validate_blocks(self.blocks.withColumn("block_pos", F.struct("page_number", "reading_order")), self.pages, self.sections),
            row(repaired, "boundary_repair", F.col("chunk_id")), row(merged, "small_chunk_merge", F.col("chunk_id")), row(c.filter("part_index = 1"), "overlong_split", F.col("original_chunk_id")), quality.validate(self.parents, c, self.blocks),
        ]
        if self.parsed is not None:
            found.append(self.parsed.select("document_id", F.lit("parser").alias("code"), F.explode("warnings").alias("subject")))
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out

    def metrics(self) -> DataFrame:
        return quality.metrics(self.parents, self.children, self.config, self.blocks, self.removed)

    def summary(self) -> DataFrame:
        """A row for each document: type, counts, metrics and how many warnings."""
        warnings = self.faults().groupBy("document_id").agg(F.count("*").alias("warning_count"))
        found = self.sections.groupBy("document_id").agg(F.count("*").alias("section_count"))
        parser = self.parsed.select("document_id", "parser_used") if self.parsed is not None else self.types.select("document_id", F.lit("blocks").alias("parser_used"))
        out = self.types.join(parser, "document_id", "left").join(quality.block_counts(self.blocks, self.pages), "document_id", "left").join(found, "document_id", "left").join(self.metrics(), "document_id", "left").join(warnings, "document_id", "left")
        return out.fillna(0, ["section_count", "block_count", "warning_count", "page_count", "table_count", "figure_count"])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a temporary one only where all executors are in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="docloom-")


def kept_table(df: DataFrame) -> DataFrame:
    """``df`` behind a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def settled(blocks: DataFrame) -> DataFrame:
    """Blocks without layout noise, with headings and heading paths."""
    full = blocks if "bbox" in blocks.columns else blocks.withColumn("bbox", F.lit(None).cast(BOX))
    return sections.heading_paths(noise.drop_noise(full))


def chunk_package(blocks: DataFrame, config: ChunkConfig = ChunkConfig(), parsed: DataFrame | None = None, page_sizes: DataFrame | None = None) -> Package:
    """All of a run over blocks(document_id, block_id, page_number, reading_order, block_type, text, heading_path, ...).

    With template "auto" each document goes by its type; all templates are planned in one pass.  parsed: (document_id, parser_used, warnings).
    page_sizes: (document_id, page_number, width, height).
    """
    full = blocks if "bbox" in blocks.columns else blocks.withColumn("bbox", F.lit(None).cast(BOX))
    return _package(full, "bbox" in blocks.columns, config, parsed, page_sizes, lambda table: table)


def _package(full: DataFrame, boxed: bool, config: ChunkConfig, parsed: DataFrame | None, page_sizes: DataFrame | None, keep: Callable[[DataFrame], DataFrame]) -> Package:
    marked = keep(noise.mark_noise(full))
    ready = sections.heading_paths(marked.filter("noise_reason is null").drop("noise_reason"))
    names = TEMPLATES if config.template == "auto" else (config.template if config.template in TEMPLATES else "generic_structured",)
    typed = keep(doctype.typed(post.with_context(ready, config.table_context_blocks, config.image_context_blocks), config.template).withColumnRenamed("document_type", "template"))
    settled_blocks = typed.select(*ready.columns)
    if "contract_terms" in names and boxed:
        contract = markers.join_markers(typed.filter("template = 'contract_terms'"))
        typed = typed.filter("template <> 'contract_terms'").unionByName(contract, allowMissingColumns=True)
    parents, children = templates.chunk_typed(typed, config, names)
    final = keep(post.split_overlong(post.merge_small(post.repair_boundaries(templates.article_parts(children)), config), config))
    pages = noise.kept_on_pages(quality.page_table(marked.select(*full.columns), page_sizes), marked)
    return Package(settled_blocks, parents, final, noise.removed(marked), pages, config, parsed, lambda put: _package(full, boxed, config, parsed, page_sizes, put))


def with_children(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Parents with child_chunk_ids in order, and with the pages and blocks of what their children took in.

    If a child was joined to one of another parent in a document, its parents without children go.
    """
    part = F.coalesce("part_index", F.lit(0)) if "part_index" in children.columns else F.lit(0)
    one = F.struct("child_index", part.alias("part"), "chunk_id", "source_block_ids", "page_start", "page_end")
    found = children.groupBy("document_id", "parent_id").agg(F.sort_array(F.collect_list(one)).alias("m"))
    of = lambda name: F.transform("m", lambda x: x[name])
    found = found.select("document_id", "parent_id", of("chunk_id").alias("child_chunk_ids"), F.array_min(of("page_start")).alias("first_page"), F.array_max(of("page_end")).alias("last_page"), F.flatten(of("source_block_ids")).alias("more"))
    none = F.array().cast("array<string>")
    out = parents.join(found, ["document_id", "parent_id"], "left").withColumn("child_chunk_ids", F.coalesce("child_chunk_ids", none))
    # blocks of another parent tell that a child was taken in
    crossed = F.max(F.size(F.array_except(F.coalesce("more", none), F.col("source_block_ids"))) > 0).over(Window.partitionBy("document_id"))
    out = out.withColumn("crossed", crossed).filter(~F.col("crossed") | (F.size("child_chunk_ids") > 0))
    return out.select(
        "document_id", "parent_id", "section_id", "title", "heading_path", "text", F.least("page_start", "first_page").alias("page_start"), F.greatest("page_end", "last_page").alias("page_end"),
        F.array_distinct(F.concat("source_block_ids", F.coalesce("more", none))).alias("source_block_ids"), "child_chunk_ids", "parent_order",
    )


def chunk_blocks(blocks: DataFrame, config: ChunkConfig = ChunkConfig()) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of blocks, all passes done: see chunk_package()."""
    found = chunk_package(blocks, config)
    return found.parents, found.children
