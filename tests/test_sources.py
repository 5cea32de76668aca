"""Files, layout exports and page texts as blocks."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import boxes, text as t
from docloom.operators import flat
from docloom.plans import output
from docloom.sources import layout, pages, router, sheets, table


def rows(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[1]}" for k, v in values.items()) or "x int"
    df = spark.createDataFrame([tuple(v[0] for v in values.values()) or (1,)], schema)
    return df.select(column.alias("out")).first().out


@pytest.mark.parametrize(("value", "want"), [
    ([1, 2, 3, 4], (1, 2, 3, 4)), ([3, 4, 1, 2], (1, 2, 3, 4)), (["1", "2", "3", "4.5"], (1, 2, 3, 4.5)), ([[1, 2], [5, 2], [5, 7], [1, 7]], (1, 2, 5, 7)), ([{"x": 1, "y": 9}, {"x": 4, "y": 2}], (1, 2, 4, 9)),
    ({"x0": 1, "y0": 2, "x1": 3, "y1": 4}, (1, 2, 3, 4)), ({"left": 1, "top": 2, "right": 3, "bottom": 4}, (1, 2, 3, 4)), ({"l": 9, "t": 2, "r": 3, "b": 4}, (3, 2, 9, 4)), ({"bbox": [1, 2, 3, 4]}, (1, 2, 3, 4)),
    ({"type": "text", "poly": [[0, 0], [2, 3]]}, (0, 0, 2, 3)), ({"bbox": {"l": 1, "t": 2, "r": 3, "b": 4}}, (1, 2, 3, 4)), ([1, 2], None), ({"x0": 1}, None), (None, None), ("text", None), ({"bbox": None, "box": [1, 2, 3, 4]}, (1, 2, 3, 4)),
])
def test_boxes(spark, value, want):
    got = one(spark, boxes.box(F.col("j")), j=(json.dumps(value), "string"))
    assert (None if got is None else tuple(got)) == want


def test_page_sizes_and_places(spark):
    size = boxes.page_size_of
    assert size({"width": 600, "h": "800"}) == (600, 800) and size({"size": [1, 2]}) == (1, 2) and size({"size": {"width": 3, "height": 4}}) == (3, 4) and size({}) == (None, None)
    b = F.expr("named_struct('x0', -0.5D, 'y0', 0D, 'x1', 100.9D, 'y1', 50D)")
    assert one(spark, boxes.inside(b, F.lit(100.0), F.lit(60.0))) and not one(spark, boxes.inside(b, F.lit(99.0), F.lit(60.0))) and one(spark, boxes.inside(b, F.lit(None).cast("double"), F.lit(1.0)))


CONTENT_LIST = [
    {"type": "title", "text": "Chapter 1", "text_level": 1, "page_idx": 0, "bbox": [1, 2, 3, 4], "page_size": {"width": 600, "height": 800}},
    {"type": "text", "text": "   ", "page_idx": 0},
    {"type": "section_header", "text": "Part\nmore", "level": 2, "page_idx": 0},
    {"type": "text", "content": ["one", "", "two"], "page_idx": 1, "confidence": "0.5"},
    {"type": "table", "table_caption": ["Table 1", "x"], "table_body": "<table><tr><th>K</th><th>V &eacute;</th></tr><tr><td>a|b</td><td> 1 <b>2</b></td></tr></table>", "page_idx": 1},
    {"type": "table", "table_body": [["h", 1], ["x"]], "page_no": 3, "table_footnote": ["note", "here"]},
    {"type": "image", "img_caption": "Fig", "page_idx": 1},
    {"type": "picture", "page_idx": 4},
    {"type": "list", "text": "- a", "page_idx": 1},
    {"type": "strange", "md": "end", "page_idx": "2"},
]


def test_content_list(spark):
    files = spark.createDataFrame([("d", json.dumps(CONTENT_LIST).encode())], "document_id string, content binary")
    items = layout.content_list(files)
    got = rows(layout.item_blocks(items, "mineru").orderBy("reading_order"), "reading_order", "page_number", "block_type", "text", "heading_path", "confidence")
    path = ["Chapter 1", "Part"]
    assert got == [
        (0, 1, "heading", "Chapter 1", ["Chapter 1"], None), (2, 1, "heading", "Part\nmore", path, None), (3, 2, "paragraph", "one\ntwo", path, 0.5),
        (4, 2, "table", "Table 1 x\n\n| K | V é |\n| --- | --- |\n| a\\|b | 1 2 |", path, None), (5, 3, "table", "| h | 1 |\n| --- | --- |\n| x |  |", path, None), (6, 2, "figure", "Fig", path, None), (7, 5, "figure", "[Figure]", path, None),
        (8, 2, "list_item", "- a", path, None), (9, 1, "paragraph", "end", path, None),
    ]
    assert sorted(rows(layout.item_pages(items), "page_number", "width", "height")) == [(1, 600, 800), (2, None, None), (3, None, None), (5, None, None)]
    assert layout.item_blocks(items, "mineru").filter("reading_order = 0").first().bbox.x1 == 3


def test_content_list_chunks(spark):
    files = spark.createDataFrame([("d", json.dumps([*CONTENT_LIST, {"type": "text", "text": "word " * 100}, {"type": "equation", "text": "x = 1"}]).encode())], "document_id string, content binary")
    got = rows(flat.content_list_chunks(layout.content_list(files), 50).orderBy("chunk_index"), "chunk_index", "content_type", "page_number", "section")
    assert got == [(0, "title", 1, "Chapter 1"), (1, "text", 1, "Chapter 1"), (2, "table", 2, "Chapter 1"), (3, "table", 3, "Chapter 1"), (4, "text", 2, "Chapter 1"), (5, "text", 1, "Chapter 1"), (6, "formula", 1, "Chapter 1")]
    tables = [r.text for r in flat.content_list_chunks(layout.content_list(files), 50).filter("content_type = 'table'").orderBy("chunk_index").collect()]
    assert tables[0].startswith("Table 1 x\n\n| K |") and tables[1] == "| h | 1 |\n| --- | --- |\n| x |  |\n\nnote here"


def test_exported_document(spark):
    doc = {
        "texts": [
            {"label": "text", "text": "early", "meta": {"headings": [" H ", ""]}}, {"label": "section_header", "text": "Top", "level": 1, "prov": [{"page_no": 2, "bbox": {"l": 1, "t": 2, "r": 3, "b": 4}}]}, {"label": "title", "text": "Sub", "level": 3},
            {"label": "list_item", "text": "- x", "prov": {"page_no": 2}}, {"label": "text", "text": ""},
        ],
        "tables": [{"label": "table", "markdown": "| a |", "html": "<table></table>", "captions": ["cap"], "prov": [{"page_no": 3}]}], "pictures": [{"label": "picture"}], "pages": {"2": {"size": {"width": 10, "height": 20}}, "9": {"width": 1, "height": 2}},
    }
    files = spark.createDataFrame([("d", json.dumps(doc).encode())], "document_id string, content binary")
    got = rows(layout.item_blocks(layout.exported(files), "docling").orderBy("reading_order"), "reading_order", "page_number", "block_type", "text", "heading_path", "markdown")
    path = ["Top", "Sub"]
    assert got == [(0, 1, "paragraph", "early", ["H"], None), (1, 2, "heading", "Top", ["Top"], None), (2, 1, "heading", "Sub", path, None), (3, 2, "list_item", "- x", path, None), (5, 3, "table", "cap\n\n| a |", path, "cap\n\n| a |"), (6, 1, "figure", "[Figure]", path, None)]
    assert sorted(rows(layout.exported_pages(files), "page_number", "width", "height")) == [(2, 10, 20), (9, 1, 2)]


def test_chunks_of_other_parsers(spark):
    data = [("d", 0, " text ", "2", ["A", " "], None, None, "text"), ("d", 1, "", "1", None, None, None, None), ("d", 2, "| t |", "x", None, "Ch", "Se", "table"), ("d", 3, "z", "-1", [], "Ch", "Ch", None)]
    df = spark.createDataFrame(data, "document_id string, pos int, raw_text string, page_number string, headings array<string>, chapter string, section string, content_type string")
    got = rows(layout.chunk_blocks(df).orderBy("reading_order"), "reading_order", "page_number", "block_type", "text", "heading_path", "markdown")
    assert got == [(0, 2, "paragraph", "text", ["A"], None), (2, 1, "table", "| t |", ["Ch", "Se"], "| t |"), (3, 1, "paragraph", "z", ["Ch"], None)]
    assert tuple(one(spark, layout.chapter_and_section(F.col("h")), h=(["Chapter 1", "a", "第二章", "b"], "array<string>"))) == ("第二章", "a")


@pytest.mark.parametrize(("lines", "want"), [
    (["a line", "goes on", "to its end.", "Next"], ["a line goes on to its end.", "Next"]), (["保险 责任", "包括", "第二条 x"], ["保险责任包括", "第二条 x"]), (["one", "", "two"], ["one", "two"]), (["see 1", "2 and", "1.2 Heading"], ["see 12 and", "1.2 Heading"]),
    (["Text", "Chapter 2 begins", "here"], ["Text", "Chapter 2 begins here"]), ([], []), (["  ", ""], []),
])
def test_lines_are_put_together(spark, lines, want):
    assert one(spark, pages.reflowed(F.col("l")), l=(lines, "array<string>")) == want


def test_page_texts(spark):
    words = ["red", "green", "blue", "black", "white"]
    body = [f"Running head {p}\nChapter {p} {w}\nthe {w} text of a page\nthat is {w}\ngoes on here.\nIts {w} end\n1.{p} More {w}\nlast {w}\nfoot {p}" for p, w in enumerate(words, 1)]
    df = spark.createDataFrame([("d", i + 1, x) for i, x in enumerate(body)], "document_id string, page_number int, text string")
    got = rows(pages.page_blocks(df).orderBy("reading_order"), "reading_order", "page_number", "block_type", "text", "heading_path")
    want = []
    for p, w in enumerate(words, 1):
        lead = f"Chapter {p} {w} the {w} text of a page that is {w} goes on here."
        want += [(3 * p - 3, p, "paragraph", lead, [str(p)]), (3 * p - 2, p, "paragraph", f"Its {w} end", [str(p)]), (3 * p - 1, p, "heading", f"1.{p} More {w} last {w}", [f"1.{p} More {w} last {w}"])]
    assert got == want


@pytest.mark.parametrize(("text", "want"), [
    ("Chapter 3-2 Engine\nSection 4. Oil change\nmore", ("3-2", "4", "Oil change", "Engine")), ("第三章 总则\n第五条 保险责任 如下", ("第三章", "第五条 保险责任 如下", "保险责任 如下", "保险条款")), ("plain words", (None, None, None, None)),
])
def test_page_metadata(spark, text, want):
    assert tuple(one(spark, t.page_metadata(F.col("x")), x=(text, "string"))) == want


def test_page_metadata_of_a_blank_page(spark):
    assert one(spark, t.page_metadata(F.col("x")), x=(" \n", "string")) is None


@pytest.mark.parametrize(("headings", "text", "want"), [([], "Troubleshooting", "Troubleshooting"), (["Removal"], "fuel", "Engine"), ([], "fuel", "Engine"), ([], "wiring", "Electrical"), (["责任免除"], "", "责任免除"), ([], "受益人", "保险条款"), ([], "x" * 1200 + "generator", None)])
def test_heading_domains(spark, headings, text, want):
    assert one(spark, t.heading_domain(F.col("h"), F.col("x")), h=(headings, "array<string>"), x=(text, "string")) == want


@pytest.mark.parametrize(("html", "want"), [
    ("<table><tr><th>K</th></tr></table>", "| K |\n| --- |\n|  |"), ("<TABLE><TR><TD>a</TD><TD> b\n c </TD></TR><tr></tr><tr><td>1 &amp; &copy;<b>2</b></td></tr></TABLE>", "| a | b c |\n| --- | --- |\n| 1 & ©2 |  |"), ("<p>no &lt;rows&gt; &mdash;</p>", "no <rows> —"), (None, None),
])
def test_html_tables(spark, html, want):
    assert one(spark, t.html_table_markdown(F.col("h")), h=(html, "string")) == want


def workbook(sheets_):
    """A small XLSX file: name to rows; numbers, shared and inline texts."""
    out, shared = io.BytesIO(), []
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        entries, links = "", ""
        for i, (name, data) in enumerate(sheets_.items(), 1):
            entries += f'<sheet name="{name}" sheetId="{i}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:id="r{i}"/>'
            links += f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>'
            body = ""
            for n, row in enumerate(data, 1):
                body += f'<row r="{n}">'
                for k, v in enumerate(row):
                    if v is None:
                        continue
                    ref = f'r="{chr(65 + k)}{n}"'
                    if isinstance(v, str) and k % 2:
                        body += f'<c {ref} t="inlineStr"><is><t>{v}</t></is></c>'
                    elif isinstance(v, str):
                        shared.append(v)
                        body += f'<c {ref} t="s"><v>{len(shared) - 1}</v></c>'
                    elif isinstance(v, bool):
                        body += f'<c {ref} t="b"><v>{int(v)}</v></c>'
                    else:
                        body += f"<c {ref}><v>{v}</v></c>"
                body += "</row>"
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f"<workbook {main}><sheets>{entries}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>")
    return out.getvalue()


BOOK = {"Zeta": [["Name", "Amount", None], ["x", 1.5, "note"], [None, None, None], ["y", 2, None]], "Alpha": [["K"], [True]]}


def test_workbooks(spark, tmp_path):
    content = workbook(BOOK)
    assert list(sheets.read_workbook(content)) == [("Zeta", 0, ["Name", "Amount"]), ("Zeta", 1, ["x", "1.5", "note"]), ("Zeta", 2, ["y", "2"]), ("Alpha", 0, ["K"]), ("Alpha", 1, ["True"])]
    (tmp_path / "b.xlsx").write_bytes(content)
    got = rows(table.read_delimited(spark, str(tmp_path)).orderBy("reading_order"), "reading_order", "row_index", "sheet_name", "text", "columns")
    assert got == [(0, 2, "Zeta", "Sheet: Zeta\nRow: 2\nName: x\nAmount: 1.5", ["Name", "Amount"]), (1, 3, "Zeta", "Sheet: Zeta\nRow: 3\nName: y\nAmount: 2", ["Name", "Amount"]), (2, 2, "Alpha", "Sheet: Alpha\nRow: 2\nK: True", ["K"])]


def test_files_go_to_their_parsers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Top\n\nQ: why?\n\nA: so.")
    (tmp_path / "b.csv").write_text("Name,Amount\nx,1\ny,2\n")
    (tmp_path / "c.xlsx").write_bytes(workbook(BOOK))
    (tmp_path / "d.json").write_text(json.dumps(CONTENT_LIST))
    (tmp_path / "e.pdf").write_text("Chapter 1\nfirst page.\x0csecond page.")
    (tmp_path / "f.xlsx").write_bytes(b"not a workbook")
    (tmp_path / "g.txt").write_bytes("caf\xe9 one".encode("latin-1"))
    found = router.read_files(spark, str(tmp_path))
    docs = {r.path.rpartition("/")[2]: r for r in found.documents.collect()}
    assert {k: r.parser_used for k, r in docs.items()} == {"a.md": "text_file", "b.csv": "table_file", "c.xlsx": "table_file", "d.json": "mineru", "e.pdf": "pypdf", "f.xlsx": None, "g.txt": "text_file"}
    assert docs["d.json"].parser_fallback_chain == ["docling", "mineru"] and docs["d.json"].warnings == ["docling produced no blocks."] and docs["f.xlsx"].warnings == ["table_file produced no blocks."] and docs["a.md"].warnings == []
    blocks = found.blocks.groupBy("document_id").count().join(found.documents, "document_id").select("path", "count").collect()
    assert {r.path.rpartition("/")[2]: r["count"] for r in blocks} == {"a.md": 3, "b.csv": 2, "c.xlsx": 3, "d.json": 9, "e.pdf": 2, "g.txt": 1}
    package = output.chunk_files(spark, str(tmp_path))
    types = {r.path.rpartition("/")[2]: r.document_type for r in package.types.join(found.documents, "document_id").collect()}
    assert types["a.md"] == "qa" and types["b.csv"] == types["c.xlsx"] == "table_data"
    child = package.children.join(found.documents.filter("path like '%b.csv'"), "document_id").first()
    assert (child.row_start, child.row_end, child.columns, child.sheet_name, child.chunk_type) == (2, 3, ["Name", "Amount"], "b", "table_row_group")
    assert sorted(output.capabilities()["templates"])[0] == "auto"


def test_flat_passes(spark):
    schema = "document_id string, source_type string, chunk_index int, page_number int, text string, chapter string, section string, domain_hint string, headings array<string>, content_type string"
    make = lambda *xs: spark.createDataFrame([("d", "pdf", i, *x) for i, x in enumerate(xs)], schema)
    texts = lambda df: [r.text for r in df.orderBy("chunk_index").collect()]
    plain = lambda text, page=1, section=None, kind="text": (page, text, None, section, None, [section] if section else [], kind)
    assert texts(flat.mend_broken(make(plain("保险责"), plain("任，完。"), plain("Next one."), plain("，then")))) == ["保险责\n任，完。", "Next one.\n，then"]
    assert texts(flat.mend_broken(make(plain("保险责"), plain("表", kind="table")))) == ["保险责", "表"]
    assert texts(flat.mend_broken(make(plain("保" * 50), plain("险" * 50)), 60)) == ["保" * 50, "险" * 50]
    assert texts(flat.join_continuations(make(plain("第一条 x\nas follows:", 1, "第一条"), plain("1. item one!", 2, "第一条"), plain("Done.", 2, "第一条")))) == ["第一条 x\nas follows:\n1. item one!", "Done."]
    small, large = plain("tiny text", 1, "s"), plain("word " * 60, 1, "s")
    assert len(texts(flat.merge_orphans(make(large, small, plain("other", 1, "t"))))) == 2
    assert texts(flat.merge_orphans(make(small, large)))[0].startswith("tiny text\nword")
    merged = flat.merge_orphans(make(plain("H\nfirst part", 1, "s"), plain("H\nsecond part", 1, "s"))).collect()
    assert [(r.text, r.chunk_index, r.chunk_key) for r in merged] == [("H\nfirst part\nsecond part", 0, "d:1")] and len(merged[0].chunk_id) == 64
    assert flat.without_repeated_heading("A\nB\nx", "A\n\nB") == "A\n\nB" and flat.without_repeated_heading("A\nB", "B\ny") == "y"


def test_markdown_chunks(spark):
    docs = spark.createDataFrame([("d", "# Top\n\npara\n\nmore\n\n## Sub\n\n\n\n" + "word " * 50 + "\n\nlast")], "document_id string, text string")
    got = rows(flat.markdown_chunks(docs, 60).orderBy("chunk_index"), "text", "content_type", "headings")
    assert got == [("# Top", "title", ["Top"]), ("para\nmore", "text", ["Top"]), ("## Sub", "title", ["Top", "Sub"]), (("word " * 50).strip(), "text", ["Top", "Sub"]), ("last", "text", ["Top", "Sub"])]


def test_sql_functions(spark):
    output.register_functions(spark)
    row = spark.sql("select estimate_tokens('第一条 本合同 policy 2025') n, stable_hash32('a:b') h").first()
    assert row.n == 8 and len(row.h) == 32
