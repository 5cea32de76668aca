"""Content-derived ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_hash(*parts: Column | str) -> Column:
    """The first 32 hex digits of the SHA-256 of the parts, joined by colons; null parts are empty."""
    columns = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(":", *columns).cast("binary"), 256), 1, 32)


def document_id(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def block_id(document: Column, page: Column, order: Column, kind: Column) -> Column:
    return stable_hash("block", document, page, order, kind)


def section_id(document: Column, path: Column) -> Column:
    return stable_hash("section", document, F.coalesce(F.nullif(F.array_join(path, " > "), F.lit("")), F.lit("Document")))


def parent_id(document: Column, section_key: Column) -> Column:
    return stable_hash("parent", document, section_key)


def child_id(document: Column, template: Column, parent: Column, index: Column, blocks: Column) -> Column:
    return stable_hash("child", document, template, parent, index, F.array_join(blocks, ","))


def chunk_key(document: Column, page: Column) -> Column:
    """Of a flat chunk: its document and page."""
    return F.concat(document, F.lit(":"), page.cast("string"))


def flat_chunk_id(document: Column, source: Column, page: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws(":", document, source, page.cast("string"), index.cast("string")).cast("binary"), 256)
