"""Tables as row blocks."""

from __future__ import annotations

import csv
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docloom.functions import ids


def headers(cells: Column) -> Column:
    """Column names of a header row: blank becomes column_i, a name that is already there gets _i."""
    stripped = F.transform(cells, lambda x, i: F.when(F.trim(F.coalesce(x, F.lit(""))) == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(F.trim(x)))
    numbered = F.transform(stripped, lambda x, i: F.struct(x.alias("name"), i.alias("at")))
    return F.aggregate(
        numbered, F.array().cast("array<string>"),
        lambda out, x: F.concat(out, F.array(F.when(F.array_contains(out, x["name"]), F.concat(x["name"], F.lit("_"), (x["at"] + 1).cast("string"))).otherwise(x["name"]))),
    )


def row_text(sheet: Column, index: Column, names: list[str] | Column, values: Column) -> Column:
    """Sheet, row, then a line for each cell that has something."""
    names = F.array(*map(F.lit, names)) if isinstance(names, list) else names
    lines = F.filter(F.zip_with(names, values, lambda n, v: F.when(F.trim(v) != "", F.concat(n, F.lit(": "), F.trim(v)))), lambda x: x.isNotNull())
    return F.array_join(F.concat(F.array(F.concat(F.lit("Sheet: "), sheet), F.concat(F.lit("Row: "), index.cast("string"))), lines), "\n")


def sheet_blocks(rows: DataFrame, sheet: str, order: str, columns: list[str]) -> DataFrame:
    """Row blocks of a typed table; order: a column whose value is the 0-based row (data rows count from 2)."""
    values = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    index = F.col(order) + 2
    return rows.select(
        F.lit(sheet).alias("document_id"), F.lit(1).alias("page_number"), F.col(order).cast("int").alias("reading_order"), F.lit("table").alias("block_type"),
        row_text(F.lit(sheet), index, columns, values).alias("text"), F.array(F.lit(sheet)).alias("heading_path"), index.cast("int").alias("row_index"), F.array(*map(F.lit, columns)).alias("columns"), F.lit(sheet).alias("sheet_name"),
    ).withColumn("block_id", ids.block_id(F.col("document_id"), F.col("page_number"), F.col("reading_order"), F.col("block_type")))


def _rows(batches: Iterator) -> Iterator:
    import pandas as pd

    from docloom.sources.sheets import read_workbook

    for batch in batches:
        out = []
        for document, path, content in zip(batch["document_id"], batch["path"], batch["content"], strict=True):
            stem, _, ext = path.rpartition("/")[2].rpartition(".")
            if ext.lower() in ("xlsx", "xlsm"):
                try:
                    out += [(document, at, sheet, i, cells) for at, (sheet, i, cells) in enumerate(read_workbook(bytes(content)))]
                except Exception:  # not a workbook: it makes no blocks, which the router says
                    continue
            else:
                out += [(document, i, stem, i, cells) for i, cells in enumerate(_delimited(bytes(content), ext.lower()))]
        yield pd.DataFrame(out, columns=["document_id", "at", "sheet", "row", "cells"])


def _delimited(content: bytes, ext: str) -> Iterator[list[str]]:
    """Rows of CSV or TSV bytes; a blank line is a row without cells."""
    text = content.decode("utf-8-sig", "replace")
    delimiter = "\t" if ext == "tsv" else ","
    if ext != "tsv":
        try:
            delimiter = csv.Sniffer().sniff(text[:4096], delimiters=",;\t|").delimiter
        except csv.Error:
            pass
    for row in csv.reader(text.splitlines(), delimiter=delimiter):
        yield [x.strip() for x in row]


def file_blocks(files: DataFrame) -> DataFrame:
    """Row blocks of files(document_id, path, content): CSV, TSV, XLSX and XLSM; other files make none.

    The first row names the columns.  The delimiter of a CSV file is found from its first 4096 characters.  Spark's own reader can't find
    delimiters or keep these row numbers, so a file is parsed whole by one task.
    """
    known = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("csv", "tsv", "xlsx", "xlsm"))
    rows = known.select("document_id", "path", "content").mapInPandas(_rows, "document_id string, at int, sheet string, row int, cells array<string>")
    # a sheet's header goes to its rows by a window over the sheet
    head = F.first(F.when(F.col("row") == 0, headers(F.col("cells"))), True).over(Window.partitionBy("document_id", "sheet").orderBy("row"))
    body = rows.withColumn("names", head).filter("row > 0")
    width = F.size("names")
    cells = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.greatest(width - F.size("cells"), F.lit(0)))), F.lit(1), width)
    full = body.withColumn("cells", cells).filter(F.exists("cells", lambda x: x != ""))
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("at")) - 1  # through all sheets
    return full.select(
        "document_id", F.lit(1).alias("page_number"), order.cast("int").alias("reading_order"), F.lit("table").alias("block_type"), row_text(F.col("sheet"), F.col("row") + 1, F.col("names"), F.col("cells")).alias("text"),
        F.array("sheet").alias("heading_path"), (F.col("row") + 1).alias("row_index"), F.col("names").alias("columns"), F.col("sheet").alias("sheet_name"), F.lit("table_file").alias("source_parser"),
    ).withColumn("block_id", ids.block_id(F.col("document_id"), F.col("page_number"), F.col("reading_order"), F.col("block_type")))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Row blocks of the tables under a path."""
    return file_blocks(spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("document_id"), "content"))
