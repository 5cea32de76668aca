"""Files of any kind as blocks: which parser reads a file, and what is tried if it finds nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docloom.config import PARSERS, parsers_for
from docloom.functions import ids
from docloom.sources import layout, pages, table, text

#: What a parser makes of files(path, document_id, content): blocks, or None if it isn't available.
Parser = Callable[[DataFrame], DataFrame | None]


@dataclass(frozen=True)
class Parsed:
    """Blocks, and for each document (document_id, path, file_type, parser_used, parser_fallback_chain, warnings)."""

    blocks: DataFrame
    documents: DataFrame


def _texts(files: DataFrame) -> DataFrame:
    return text.file_blocks(files)


def _tables(files: DataFrame) -> DataFrame:
    return table.file_blocks(files)


#: Parsers by name; others can be registered.  PDF bytes need an engine of their own: register one that yields page texts or layout JSON.
REGISTRY: dict[str, Parser] = {"text_file": _texts, "table_file": _tables, "docling": layout.exported_files, "mineru": layout.content_list_files, "pypdf": pages.page_text_files}


def register(name: str, parser: Parser) -> None:
    """Make a parser known under a name (one of PARSERS to be tried by itself)."""
    REGISTRY[name] = parser


def available() -> dict[str, bool]:
    """Which of the known parsers can be used here."""
    return {name: name in REGISTRY for name in PARSERS}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def read_files(spark: SparkSession, path: str, parser: str = "auto", priority: tuple[str, ...] = ("docling", "mineru", "pypdf")) -> Parsed:
    """Blocks of all files under ``path`` (binary scan).  Each file goes to its first parser; if that makes no blocks, to the next.

    A file's document_id is the hash of its bytes.  Files that no parser can read have no blocks and say so in their warnings.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("document_id"), "content").dropDuplicates(["document_id"])
    kinds = {"csv": "t.csv", "txt": "t.txt", "other": "t.pdf"}
    chains = {kind: parsers_for(name, parser, priority) for kind, name in kinds.items()}
    ext = suffix(F.col("path"))
    kind = F.when(ext.isin("csv", "tsv", "xlsx", "xlsm"), "csv").when(ext.isin("txt", "md", "markdown"), "txt").otherwise("other")
    files = files.withColumn("chain", F.coalesce(*[F.when(kind == k, F.array(*map(F.lit, chain))) for k, chain in chains.items()]))
    names = list(dict.fromkeys(n for chain in chains.values() for n in chain))
    made = []
    for name in names:  # at most five
        parse = REGISTRY.get(name)
        mine = files.filter(F.array_contains("chain", name))
        found = parse(mine.drop("chain")) if parse else None
        if found is not None:
            made.append(found.withColumn("parser", F.lit(name)))
    every = made[0]
    for x in made[1:]:
        every = every.unionByName(x, allowMissingColumns=True)
    # of the parsers that made blocks, a file's first one counts
    ranked = every.join(files.select("document_id", "chain"), "document_id").withColumn("rank", F.array_position("chain", F.col("parser")))
    first = F.min("rank").over(Window.partitionBy("document_id"))
    blocks = ranked.withColumn("first", first).filter("rank = first")
    used = blocks.groupBy("document_id").agg(F.first("parser").alias("parser_used"), F.first("rank").cast("int").alias("tries"))
    documents = files.join(used, "document_id", "left")
    tried = F.slice("chain", F.lit(1), F.coalesce("tries", F.size("chain")))
    failed = F.when(F.col("parser_used").isNull(), tried).otherwise(F.slice("chain", F.lit(1), F.greatest(F.col("tries") - 1, F.lit(0))))
    said = F.transform(failed, lambda n: F.concat(n, F.when(n.isin(*REGISTRY), F.lit(" produced no blocks.")).otherwise(F.lit(" is not available."))))
    documents = documents.select("document_id", "path", ext.alias("file_type"), "parser_used", tried.alias("parser_fallback_chain"), said.alias("warnings"))
    return Parsed(blocks.drop("chain", "rank", "first", "parser"), documents)


def block_ids(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("block_id", ids.block_id(F.col("document_id"), F.col("page_number"), F.col("reading_order"), F.col("block_type")))
