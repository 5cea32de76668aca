"""Sheets of XLSX workbooks: a zip of XML, read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    """0 for A, 26 for AA, from a cell's reference."""
    n = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _text(node: ElementTree.Element | None) -> str:
    return "" if node is None else "".join(x.text or "" for x in node.iter(f"{_MAIN}t"))


def _value(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, found = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return _text(cell.find(f"{_MAIN}is")).strip()
    raw = (found.text or "") if found is not None else ""
    if kind == "s":
        return shared[int(raw)].strip() if raw else ""
    if kind == "b":
        return {"1": "True", "0": "False"}.get(raw, raw)
    if kind is None and re.fullmatch(r"-?\d+\.0+", raw):
        return raw.split(".")[0]
    return raw.strip()


def read_workbook(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row from 0, cells) of all rows with something in them, sheets in their order; blank rows don't count."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = links[sheet.get(_REL)].lstrip("/")
            rows = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row")
            kept = 0
            for row in rows:
                cells: list[str] = []
                for i, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = _column(cell.get("r")) if cell.get("r") else i
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = _value(cell, shared)
                if any(cells):
                    yield sheet.get("name"), kept, cells
                    kept += 1
