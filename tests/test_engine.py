"""The chunking engine on small examples."""

import re
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docloom import catalog
from docloom.config import ChunkConfig, parsers_for
from docloom.functions import text as t
from docloom.operators import noise, post, quality, templates
from docloom.operators import doctype, markers, sections
from docloom.plans import output
from docloom.plans.chunking import chunk_blocks, chunk_package
from docloom.sources import table, text as text_source
from docloom.sources.text import text_blocks

SF = "/root/testdata/sf0.001"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rows(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_settings_are_checked():
    with pytest.raises(ValueError):
        ChunkConfig(child_max_tokens=10)
    with pytest.raises(ValueError):
        ChunkConfig(template="poem")
    assert ChunkConfig().merge_below == 40


@pytest.mark.parametrize(("path", "parser", "want"), [("a.CSV", "auto", ["table_file"]), ("a.md", "auto", ["text_file"]), ("a.pdf", "auto", ["docling", "mineru", "pypdf"]), ("a.pdf", "mineru", ["mineru", "pypdf"]), ("a.md", "pypdf", ["pypdf"])])
def test_parsers(path, parser, want):
    assert parsers_for(path, parser) == want


def test_strip_knows_unicode_space(spark):
    assert one(spark, t.strip(F.lit("　\x1c a b \xa0\n"))) == "a b"


def test_markdown_and_plain_blocks(spark):
    docs = spark.createDataFrame([("m", "# Top\n\npara one\n\n- item\n\n## Sub\n\nend"), ("p", "Chapter 1 x\nline\n1) thing"), ("e", ""), ("n", None)], "document_id string, text string")
    got = rows(text_blocks(docs).orderBy("document_id", "reading_order"), "document_id", "block_type", "text", "heading_path")
    assert got == [
        ("m", "heading", "Top", ["Top"]), ("m", "paragraph", "para one", ["Top"]), ("m", "list_item", "- item", ["Top"]), ("m", "heading", "Sub", ["Sub"]), ("m", "paragraph", "end", ["Sub"]),
        ("p", "heading", "Chapter 1 x", ["Chapter 1 x"]), ("p", "paragraph", "line", ["Chapter 1 x"]), ("p", "list_item", "1) thing", ["Chapter 1 x"]),
    ]


def test_question_document_has_one_merged_pair(spark):
    docs = spark.createDataFrame([("q", "# FAQ\n\nQ: what is it?\n\nA: a thing of note.\n\nQ: why?\n\nA: because of that.")], "document_id string, text string")
    parents, children = chunk_blocks(text_blocks(docs))
    (child,) = children.collect()
    assert (child.template, child.chunk_type, len(child.source_block_ids), parents.count()) == ("qa", "qa_pair", 4, 1)


def test_delimited_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Name;Amount;\nx;1;\n;;\ny;2;z\n")
    got = rows(table.read_delimited(spark, str(tmp_path)).orderBy("row_index"), "row_index", "text")
    assert got == [(2, "Sheet: t\nRow: 2\nName: x\nAmount: 1"), (4, "Sheet: t\nRow: 4\nName: y\nAmount: 2\ncolumn_3: z")]


def test_noise_needs_two_pages(spark):
    box = "named_struct('x0', 0D, 'y0', 10D, 'x1', 9D, 'y1', 20D)"
    data = spark.sql(f"select 'd' document_id, p page_number, 0 reading_order, 'paragraph' block_type, concat('Same  head') text, cast({box} as {BOX}) bbox from values 1, 2 v(p) union all select 'd', 1, 1, 'paragraph', '12', null union all select 'd', 1, 2, 'paragraph', 'body text', null union all select 'o', 1, 0, 'paragraph', 'Same head', {box}")
    got = sorted(rows(noise.mark_noise(data), "document_id", "page_number", "reading_order", "noise_reason"), key=str)
    assert got == [("d", 1, 0, "repeated_page_edge"), ("d", 1, 1, "page_number"), ("d", 1, 2, None), ("d", 2, 0, "repeated_page_edge"), ("o", 1, 0, None)]


def test_headers_are_stripped(spark):
    pages = spark.createDataFrame([("d", p, f"Report {p}\nunlike {'abc'[p]}\nx{'def'[p]}\ny{'ghi'[p]}\nz{'jkl'[p]}") for p in range(3)], "document_id string, page_number int, text string")
    assert all(r.text == "" for r in noise.strip_headers(pages).collect())  # of three pages one is half, rounded down
    pages = spark.createDataFrame([("d", p, f"Report {p}\nunlike {'abcde'[p]}\nx{'fghij'[p]}\nbody\n\ny{'klmno'[p]}\nz{'pqrst'[p]}\n- {p} -") for p in range(5)], "document_id string, page_number int, text string")
    assert sorted(r.text for r in noise.strip_headers(pages).collect()) == [f"unlike {'abcde'[p]}\nx{'fghij'[p]}\nbody\n\ny{'klmno'[p]}\nz{'pqrst'[p]}" for p in range(5)]


def merge_reference(tokens, protected, least):
    """Small children join what follows until nothing changes; a small last one joins what is before."""
    groups = [([i], n, p) for i, (n, p) in enumerate(zip(tokens, protected, strict=True))]
    changed = True
    while changed:
        changed = False
        for i, (own, n, p) in enumerate(groups):
            if p or n >= least:
                continue
            for a, b in ((i, i + 1), (i - 1, i)):
                if 0 <= a and b < len(groups) and not groups[a][2] and not groups[b][2]:
                    groups[a : b + 1] = [(groups[a][0] + groups[b][0], groups[a][1] + groups[b][1], False)]
                    changed = True
                    break
            if changed:
                break
    return [g for g, _, _ in groups]


def test_small_merge_is_the_restart_loop(spark):
    import random

    rng = random.Random(3)
    cases = [([10, 10, 50, 5], [False] * 4)] + [([rng.randrange(60) for _ in range(n)], [rng.random() < 0.2 for _ in range(n)]) for n in [1, 2, 3, 5, 8] * 12]
    df = spark.createDataFrame([(i, list(zip(a, b, strict=True))) for i, (a, b) in enumerate(cases)], "k int, u array<struct<tokens:bigint,protected:boolean>>")
    for r in df.select("k", post.merge_numbers(F.col("u"), 40).alias("n")).collect():
        got = {}
        for i, g in enumerate(r.n):
            got.setdefault(g, []).append(i)
        assert list(got.values()) == merge_reference(*cases[r.k], 40), cases[r.k]


def test_split_keeps_text_and_limit():
    text = "One two three! " * 30 + "\n\n" + "word " * 40
    parts = post.split_text(text, 20)
    assert all(post.count_tokens(p) <= 20 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())
    assert post.split_text("中" * 500, 100) == ["中" * 80] * 6 + ["中" * 20]


CHILD = "document_id string, parent_id string, chunk_id string, child_index int, chunk_type string, text string, page_start int, page_end int, source_block_ids array<string>, token_count bigint, parent_order int, bbox_refs array<struct<block_id:string,page_number:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"


def child(i, text, parent="p", page=None, kind="text", doc="d", box=None):
    page = i + 1 if page is None else page
    refs = [(f"b{i}", page, box)] if box else []
    return (doc, parent, f"{doc}{i}", i, kind, text, page, page, [f"b{i}"], 7, ord(parent[0]), refs)


def repaired(spark, *children):
    df = post.repair_boundaries(spark.createDataFrame(list(children), CHILD)).orderBy("document_id", "parent_order", "child_index")
    return [(r.text, r.page_start, r.page_end, r.repairs) for r in df.collect()]


LOW_BOX, HIGH_BOX = (0.0, 690.0, 9.0, 720.0), (0.0, 50.0, 9.0, 60.0)


@pytest.mark.parametrize(("a", "b", "pages", "boxes", "want"), [
    ("bene-", "fit goes", (1, 2), (None, None), ["benefit goes"]), ("the end", "of it", (1, 2), (None, None), ["the end of it"]), ("Done.", "Next", (1, 2), (None, None), ["Done.", "Next"]), ("the end", "of it", (1, 1), (None, None), ["the end", "of it"]),
    ("甲", "，乙", (1, 1), (None, None), ["甲，", "乙"]), ("甲", "，。", (1, 1), (None, None), ["甲，。"]), ("1. one.", "2. two", (1, 2), (None, None), ["1. one.2. two"]), ("1. one.", "4. two", (1, 2), (None, None), ["1. one.4. two"]), ("One.", "4. two", (1, 2), (None, None), ["One.", "4. two"]),
    ("No end", "Next", (1, 2), (LOW_BOX, HIGH_BOX), ["No end Next"]), ("No end", "Next", (1, 2), (HIGH_BOX, HIGH_BOX), ["No end", "Next"]), ("No end", "Next", (1, 3), (LOW_BOX, HIGH_BOX), ["No end", "Next"]), ("and,", "Next", (1, 2), (None, None), ["and, Next"]),
    ("保险责", "任", (1, 2), (None, None), ["保险责任"]), ("text", "① item", (1, 2), (None, None), ["text", "① item"]), ("", "x", (1, 2), (None, None), ["", "x"]),
])
def test_breaks(spark, a, b, pages, boxes, want):
    assert [r[0] for r in repaired(spark, child(0, a, page=pages[0], box=boxes[0]), child(1, b, page=pages[1], box=boxes[1]))] == want


def test_repair_goes_on(spark):
    assert repaired(spark, child(0, "one and"), child(1, "two and"), child(2, "three.")) == [("one and two and three.", 1, 3, 2)]
    assert repaired(spark, child(0, "one"), child(1, "table", kind="table"), child(2, "two")) == [("one", 1, 1, 0), ("table", 2, 2, 0), ("two", 3, 3, 0)]
    # a list item that goes on over two pages is still one when the next item comes
    assert repaired(spark, child(0, "3. three goes"), child(1, "on here."), child(2, "4. four")) == [("3. three goes on here.4. four", 1, 3, 2)]
    # marks move, and what gave them is tried with the next
    assert repaired(spark, child(0, "甲", page=1), child(1, "，乙和", page=1), child(2, "丙", page=2)) == [("甲，", 1, 1, 1), ("乙和丙", 1, 2, 1)]


def test_cross_parent_repair(spark):
    header = "个人保险基本条款第二版"
    assert repaired(spark, child(0, "保险责", "a", 8), child(1, "任，并且", "b", 9)) == [("保险责任，并且", 8, 9, 1)]
    assert len(repaired(spark, child(0, "保险责", "a", 8), child(1, "第二条 任", "b", 9))) == 2
    assert repaired(spark, child(0, "保险责", "a", 8), child(1, f"{header}\n任，并且", "b", 9)) == [("保险责任，并且", 8, 9, 1)]
    assert len(repaired(spark, child(0, "保险责", "a", 8), child(1, "任，并且", "b", 10))) == 2
    # a running header goes even if the children stay apart
    assert [r[0] for r in repaired(spark, child(0, "保险责", "a", 8), child(1, f"{header}\n第二条 任", "b", 9))] == ["保险责", "第二条 任"]


def test_tokens_after_repair(spark):
    df = spark.createDataFrame([child(0, "甲", page=1), child(1, "，乙", page=1), child(2, "Up and"), child(3, "down")], CHILD)
    got = {r.text: r.token_count for r in post.repair_boundaries(df).collect()}
    assert got == {"甲，": 7, "乙": 7, "Up and down": 3}  # moved marks alone don't change counts


def test_overlong_children_are_split(spark):
    docs = spark.createDataFrame([("d", "Chapter 1\n" + "word " * 300)], "document_id string, text string")
    children = templates.chunk(text_blocks(docs), "generic_structured", ChunkConfig(child_max_tokens=100))[1]
    parts = post.split_overlong(children, ChunkConfig(child_max_tokens=100)).collect()
    assert len(parts) > 3 and all(p.token_count <= 100 and p.text.startswith("Chapter 1") for p in parts if p.part_index)


def test_table_children_are_flagged(spark):
    blocks = catalog._sheet(spark, SF)
    parents, children = templates.chunk(blocks, "table_data")
    lists = children.groupBy("parent_id").agg(F.collect_list("chunk_id").alias("child_chunk_ids"))
    found = quality.validate(parents.join(lists, "parent_id"), children, blocks).groupBy("code").count().collect()
    assert [(r.code, r["count"]) for r in found] == [("media_in_text_child", blocks.count())]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for x in ("documents", "conversations", "supplier", "pages", "part", "customer"):
        con.execute(f"create view {x} as select * from '{SF}/{x}.parquet'")
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    flat = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    want = sorted((flat(r) for r in found.fetchall()), key=repr)
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted((flat(r) for r in df.select(*names).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_have_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1


def turns(spark, folder):
    """Conversations with short, empty, null and equal turns; their texts by conversation."""
    given = {1: ["Hi", "", None, "a longer turn of many words here.", "ok."], 2: ["the same turn", "the same turn", "the same turn", "No"], 3: ["."], 4: ["x", "y", "z"]}
    data = [(c, i, "user", x) for c, xs in given.items() for i, x in enumerate(xs)]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return {c: [x or "" for x in xs] for c, xs in given.items()}


def test_boundary_repair_has_every_turn(spark, tmp_path):
    given = turns(spark, tmp_path)
    got = rows(catalog.QUERIES["boundary_repair"](spark, f"file://{tmp_path}"), "document_id", "chunk_id", "text", "page_start", "page_end", "repairs")
    assert ("3", "3:1:0", "xx.", 2, 3, 1) in got  # one mark, cut into "x-" and "x."
    for c, xs in given.items():  # every page is in exactly one child, and every letter
        own = [r for r in got if r[0] == str(c)]
        assert sorted(p for r in own for p in range(r[3], r[4] + 1)) == list(range(2, 2 * len(xs) + 2))
        assert re.sub(r"[\sx-]", "", "".join(r[2] for r in sorted(own, key=lambda r: r[3]))) == re.sub(r"[\sx-]", "", "".join(xs))


def test_header_footer_has_every_repeated_line(spark, tmp_path):
    from hashlib import md5

    given, want = turns(spark, tmp_path), set()
    for c, xs in given.items():
        pages = [["Weekly report #", *(f"{name} {md5((x + more).encode()).hexdigest()}" for name, more in (("first", ""), ("second", "a"), ("third", "b"))), "- # -"] for x in xs]
        pages = [[re.sub("[0-9]+", "#", line) for line in page] for page in pages]
        for zone, part in (("header", slice(0, 3)), ("footer", slice(-3, None))):
            n = Counter(line for page in pages for line in page[part])
            want |= {(str(c), zone, line) for line, k in n.items() if len(pages) >= 3 and k >= len(pages) // 2}
    got = rows(catalog.QUERIES["header_footer"](spark, f"file://{tmp_path}"), "document_id", "zone", "norm")
    assert sorted(got) == sorted(want) and sum(not r[2].startswith(("Weekly", "-")) for r in got) > 8


def block(i, kind, text, page=1, path=(), box=None, **more):
    return {"document_id": "d", "block_id": f"b{i}", "page_number": page, "reading_order": i, "block_type": kind, "text": text, "heading_path": list(path), "bbox": box, **more}


BLOCK = f"document_id string, block_id string, page_number int, reading_order int, block_type string, text string, heading_path array<string>, bbox {BOX}"


def made(spark, *found, more=""):
    return spark.createDataFrame(list(found), BLOCK + more)


def path_by_hand(events):
    """(level or None, title, given path) of rows: the path at each, one row after another."""
    path, out = [], []
    for level, title, given in events:
        if given:
            path = list(dict.fromkeys(given))
        elif level is not None:
            kept = path[: level - 1] if level > 1 and path else []
            path = kept[: kept.index(title) + 1] if title in kept else [*kept, title]
        out.append(list(path))
    return out


def test_heading_paths_are_the_fold(spark):
    import random

    from docloom.functions import paths

    rng, data, want = random.Random(5), [], {}
    for d in range(60):
        events = []
        for i in range(rng.randrange(1, 40)):
            kind = rng.random()
            given = [f"g{rng.randrange(4)}" for _ in range(rng.randrange(1, 9))] if kind < 0.1 else []
            events.append((rng.randrange(1, 7) if 0.1 <= kind < 0.7 else None, f"t{rng.randrange(6 if d % 2 else 1000)}", list(dict.fromkeys(given))))
        data += [(str(d), i, *e) for i, e in enumerate(events)]
        want[str(d)] = path_by_hand(events)
    df = spark.createDataFrame(data, "document_id string, i int, level int, title string, given array<string>").repartition(5)
    got = paths.running_path(df, "document_id", ["i"], F.col("level"), F.col("title"), F.col("given")).orderBy("document_id", "i").collect()
    for d, paths_ in want.items():
        assert [r.path for r in got if r.document_id == d] == paths_, d


def test_levels_by_hint_and_font(spark):
    found = made(spark, block(0, "heading", "Big", font_size=18.0, level_hint=None), block(1, "heading", "Small", font_size=14.0, level_hint=None), block(2, "heading", "Deep", font_size=14.0, level_hint=9), block(3, "paragraph", "Body text.", font_size=10.0, level_hint=None), more=", font_size double, level_hint int")
    got = rows(sections.heading_paths(found).orderBy("reading_order"), "heading_level", "heading_path")
    assert got == [(1, ["Big"]), (2, ["Big", "Small"]), (6, ["Big", "Small", "Deep"]), (None, ["Big", "Small", "Deep"])]


@pytest.mark.parametrize(("text", "junk"), [("第 3 页", True), ("Page 12", True), ("20251", True), ("x [2020] y 号", True), ("保险基本条款第二版", True), ("基本条款第十三版", True), ("基本条款第九版  第 3 页  Page 4", True), ("基本条款第九版  more text here", False), ("第三条 内容", False), ("", False)])
def test_page_junk(spark, text, junk):
    assert spark.createDataFrame([(text,)], "x string").select(templates.page_junk(F.col("x")).alias("j")).first().j == junk


def test_split_markers_are_joined(spark):
    b = lambda x0, y0, x1, y1: dict(zip(("x0", "y0", "x1", "y1"), map(float, (x0, y0, x1, y1)), strict=True))
    found = made(
        spark, block(0, "paragraph", "第一条 定本办法。", box=b(10, 100, 60, 120)), block(1, "list_item", "为了规范管理，制", box=b(70, 98, 500, 122)), block(2, "paragraph", "第二条 完整的一条。", page=2, box=b(10, 100, 500, 120)),
        block(3, "paragraph", "far away", box=b(70, 400, 500, 420)), block(4, "heading", "第三条 尾", page=3, box=b(10, 100, 60, 120)), block(5, "table", "beside it", page=3, box=b(70, 98, 500, 122)),
    )
    got = {r.block_id: r for r in markers.join_markers(found).collect()}
    assert sorted(got) == ["b1", "b2", "b3", "b4", "b5"] and (got["b1"].text, got["b1"].block_type, got["b1"].marker_block_id) == ("第一条 为了规范管理，制定本办法。", "paragraph", "b0")
    assert all(got[k].marker_block_id is None for k in ("b2", "b3", "b4", "b5"))


def test_media_context(spark):
    found = made(
        spark, block(0, "paragraph", "one"), block(1, "paragraph", "two"), block(2, "figure", "f"), block(3, "caption", "cap 1"), block(4, "table", "t", caption="own"), block(5, "header", "h"), block(6, "paragraph", "three"),
        block(7, "paragraph", "other section"), block(8, "table", "u"), block(9, "caption", "next page", page=2), more=", caption string",
    ).withColumn("section_id", F.when(F.col("reading_order") < 7, "s").otherwise("r"))
    got = {r.block_id: r for r in post.media_context(found, 2, 1).collect()}
    assert (got["b4"].context_before, got["b4"].context_after, got["b4"].context_strategy) == ("own\n\ncap 1\n\ntwo\n\ncap 1", "three", "caption_and_same_section_neighbors")
    assert (got["b2"].context_before, got["b2"].context_after, got["b2"].context_block_ids_after) == ("cap 1\n\ntwo", "cap 1", ["b3"])
    assert (got["b8"].context_before, got["b8"].context_after, got["b8"].context_strategy) == ("other section", "next page", "same_section_neighbors")
    assert sorted(got) == ["b2", "b3", "b4", "b8", "b9"] and got["b3"].context_block_ids_before == ["b1"]


def package_of(spark, *found, config=ChunkConfig(), more=""):
    return chunk_package(made(spark, *found, more=more), config).materialize()


def test_contract_package(spark):
    box = {"x0": 1.0, "y0": 300.0, "x1": 9.0, "y1": 310.0}
    got = package_of(
        spark, block(0, "heading", "第一章 总则"), block(1, "paragraph", "第一条 保险合同由条款组成。" + "内容" * 60, box=box), block(2, "paragraph", "第 3 页"), block(3, "list_item", "（一）投保人；" + "说明" * 60), block(4, "table", "| a |", box=box, caption="表一"), block(5, "paragraph", "以上为准。" + "补充" * 60), block(6, "heading", "第二章 责任"),
        config=ChunkConfig(child_max_tokens=100, child_min_tokens=0), more=", caption string",
    )
    children = got.children.orderBy("parent_order", "child_index", "part_index").collect()
    assert {c.template for c in children} == {"contract_terms"} and {c.article for c in children} == {"第一条 保险合同由条款组成。" + "内容" * 60}
    table = next(c for c in children if c.chunk_type == "table")
    assert table.context_strategy == "caption_and_same_section_neighbors" and table.context_before.startswith("表一") and table.bbox_refs[0].block_id == "b4"
    parents = {p.title: p for p in got.parents.collect()}
    assert sorted(parents) == ["第一章 总则", "第二章 责任"] and parents["第二章 责任"].child_chunk_ids == []
    assert set(parents["第一章 总则"].child_chunk_ids) == {c.chunk_id for c in children}
    m = got.metrics().first()
    assert (m.parent_count, m.child_count, m.orphan_child_count, m.parent_child_edge_count, m.chunks_with_bbox_refs_count) == (2, len(children), 0, len(children), sum(bool(c.bbox_refs) for c in children))
    assert m.layout_noise_removed_count == 1 and m.media_context_strategy_counts == {"caption_and_same_section_neighbors": 1} and m.block_type_counts["table"] == 1 and m.table_context_coverage == 1.0
    assert got.faults().filter("code in ('missing_child', 'missing_parent', 'not_listed_in_parent', 'not_listed_in_page', 'missing_page')").count() == 0


def test_paper_abstract_ends_its_parent(spark):
    got = package_of(spark, block(0, "heading", "Abstract"), block(1, "paragraph", "Before the table."), block(2, "table", "t"), block(3, "paragraph", "After it, doi keywords."), config=ChunkConfig(template="paper", child_min_tokens=0))
    assert [c.chunk_type for c in got.children.orderBy("child_index").collect()] == ["paper_text", "table", "paper_abstract"]


def test_questions_and_answers(spark):
    docs = spark.createDataFrame([("q", "# FAQ\n\npreamble\n\nQ: what is it?\n\nA: a thing of note.\n\nmore of it\n\n问：为何\n\n因为")], "document_id string, text string")
    got = chunk_package(text_blocks(docs), ChunkConfig(template="qa", child_min_tokens=0)).children.orderBy("child_index").collect()
    assert [(c.question, c.answer) for c in got] == [(None, None), ("what is it?", "a thing of note.\n\nmore of it"), ("为何", "因为")]


def test_sections_as_parents(spark):
    found = [block(0, "heading", "1 Part"), block(1, "paragraph", "text."), block(2, "heading", "1.1 Sub"), block(3, "paragraph", "more.")]
    for granularity, want in (("chapter", [("1 Part", ["1 Part"], 4)]), ("section", [("1 Part", ["1 Part"], 2), ("1.1 Sub", ["1 Part", "1.1 Sub"], 2)])):
        got = package_of(spark, *found, config=ChunkConfig(template="generic_structured", parent_granularity=granularity, child_min_tokens=0))
        assert sorted((p.title, p.heading_path, len(p.source_block_ids)) for p in got.parents.collect()) == want
        assert got.parents.join(got.sections, ["document_id", "section_id"], "left_anti").count() == 0


def test_prefix_of_a_chunk(spark):
    text = lambda body, prefix: spark.createDataFrame([(body, ["A", "B"])], "b string, p array<string>").select(t.with_heading(F.col("b"), F.col("p"), prefix).alias("x")).first().x
    assert text("body", "Note") == "A > B\n\nNote\n\nbody" and text("B body Note", "Note") == "A\n\nB body Note" and text("A > B body", "") == "A > B body"


def test_requested_and_declared_types(spark):
    found = made(spark, block(0, "paragraph", "Abstract"), block(1, "table", "t"), block(2, "table", "u"))
    one_ = lambda df: (df.first().document_type, round(df.first().confidence, 2), df.first().signals)
    assert one_(doctype.detect(found)) == ("table_data", 0.67, ["table_ratio=0.67"]) and one_(doctype.detect(found, "laws"))[:2] == ("laws", 1.0) and one_(doctype.detect(found, "poem"))[:2] == ("generic_structured", 0.2)
    assert one_(doctype.detect(found.withColumn("declared_type", F.lit("book"))))[:2] == ("book", 0.95)
    assert doctype.typed(found).select("document_type").distinct().collect()[0][0] == "table_data"


def test_faults_of_blocks(spark):
    b = lambda x0, y0, x1, y1: dict(zip(("x0", "y0", "x1", "y1"), map(float, (x0, y0, x1, y1)), strict=True))
    found = made(spark, block(0, "paragraph", "a", path=["A"], box=b(0, 0, 5, 5)), block(2, "paragraph", "b", path=["B"], box=b(0, 0, 500, 5)), block(1, "paragraph", "c", path=["A"], box=b(1, 1, 1, 9)), block(3, "paragraph", "d", page=0, path=["A"]), block(4, "paragraph", "e", page=7, path=["A"])).withColumn("block_pos", F.when(F.col("reading_order") == 2, 0.5).otherwise(F.col("reading_order").cast("double")))
    found = found.unionByName(found.filter("reading_order = 0").withColumn("block_pos", F.lit(9.0)))
    pages_ = spark.createDataFrame([("d", 1, 100.0, 100.0, ["b0", "b1"]), ("d", 0, None, None, ["b3"])], "document_id string, page_number int, width double, height double, block_ids array<string>")
    tree = spark.createDataFrame([("d", "s1", None, "A", 1, 2, ["A"]), ("d", "s2", "gone", " ", 3, 2, ["A", " "])], "document_id string, section_id string, parent_section_id string, title string, page_start int, page_end int, heading_path array<string>")
    got = sorted((r.code, r.subject) for r in quality.validate_blocks(found, pages_, tree).collect())
    assert got == sorted([("duplicate_block", "b0"), ("invalid_page", "b3"), ("reading_order", "b1"), ("empty_box", "b1"), ("missing_page", "b4"), ("not_listed_in_page", "b2"), ("box_outside_page", "b2"), ("path_without_section", "b2"), ("section_without_title", "s2"), ("section_ends_early", "s2"), ("missing_parent_section", "s2")])


def test_golden_table(spark, tmp_path):
    (tmp_path / "price_table.csv").write_text("Name,Amount,Category\nalpha,10,north\nbeta,20,south\ngamma,30,east\n")
    package = output.chunk_files(spark, str(tmp_path))
    snap = output.snapshot(package).first().snapshot
    assert (snap.document_type, snap.parser_used, snap.page_count, snap.block_count, snap.table_count, snap.parent_count, snap.child_count, snap.warning_count) == ("table_data", "table_file", 1, 3, 3, 1, 1, 3)
    (only,) = snap.children
    assert (only.chunk_type, only.source_blocks, only.token_count, only.heading_path) == ("table_row_group", 3, 45, ["price_table"])
    assert only.metadata_keys == ["block_types", "columns", "row_end", "row_start", "sheet_name", "template_rule"] and only.text_preview.startswith("price_table Sheet: price_table Row: 2 Name: alpha")


def test_outputs(spark):
    import json

    docs = spark.createDataFrame([("m", "# Top\n\nStep 1 do it\n\nWARNING hot\n\ntext of maintenance")], "document_id string, text string")
    package = chunk_package(text_blocks(docs)).materialize()
    found = json.loads(output.package_json(package, include_debug=True).first().json)
    assert found["document_type"] == "manual" and len(found["child_chunks"]) == found["child_count"] and len(found["blocks"]) == 4 and found["parent_child_graph"][0]["child_count"] == found["child_count"]
    assert output.edges(package.parents).count() == found["child_count"]
    summary = package.summary()
    assert [r.status for r in quality.health_checks(summary).orderBy("place").collect()] == ["ok"] * 6
    assert [r.stage for r in quality.execution_chain(summary).orderBy("place").collect()] == ["upload", "parse", "normalize", "detect_type", "chunk", "postprocess"]
    assert len(quality.suggestions(summary).first().suggestions) >= 1


def test_warning_groups_are_ordered(spark):
    data = [(i, c, f"m{i}") for i, c in enumerate("abbcccbaab")]
    got = quality.warning_groups(spark.createDataFrame(data, "pos int, code string, message string")).orderBy("place").collect()
    assert [(r.code, r.n, r.examples) for r in got] == [("b", 4, ["m1", "m2", "m6"]), ("a", 3, ["m0", "m7", "m8"]), ("c", 3, ["m3", "m4", "m5"])]


def test_requests_are_checked():
    from docloom.config import FlatConfig, check_request, priority_from, setting_from

    assert check_request("a.MD", template="qa").template == "qa"
    for bad in (lambda: check_request("a.exe"), lambda: check_request(""), lambda: check_request("a.md", colour="red"), lambda: check_request("a.md", parser="x"), lambda: FlatConfig(chunk_size_tokens=100, overlap_tokens=100), lambda: FlatConfig(min_chunk_tokens=501)):
        with pytest.raises(ValueError):
            bad()
    env = {"A": "Yes", "B": "0", "C": "7", "D": "x", "E": "0.5"}
    assert [setting_from(env, k, d) for k, d in (("A", False), ("B", True), ("C", 1), ("D", 3), ("E", 1.0), ("F", True))] == [True, False, 7, 3, 0.5, True]
    assert priority_from({}) == ("docling", "mineru", "pypdf") and priority_from({"DOCLOOM_PARSER_PRIORITY": "PyPDF, x,mineru"}) == ("pypdf", "mineru")


def test_stream_is_the_batch(spark):
    names = "document_id", "chunk_type", "text", "token_count"
    batch = chunk_blocks(text_blocks(catalog._docs(spark, SF)), ChunkConfig(template="generic_structured"))[1]
    assert sorted(rows(catalog.QUERIES["stream_chunks"](spark, SF), *names)) == sorted(rows(batch, *names))


def test_paged_chunks(spark):
    from docloom.operators import legacy

    pages_ = [("d", 1, "Chapter 7 begins\n\n" + "one " * 30 + "."), ("d", 2, ""), ("d", 3, "two " * 30 + "\n\nPage 4"), ("d", 4, "three.")]
    got = rows(legacy.paged_chunks(spark.createDataFrame(pages_, "document_id string, page_number int, text string"), 45).orderBy("chunk_index"), "chunk_index", "page_number", "text", "chapter")
    assert got == [(0, 1, "Chapter 7 begins\n\n" + "one " * 30 + ".", "7"), (1, 3, ("two " * 30).strip() + "\n\nthree.", None)]


def test_strip_and_first_line_are_linear(spark):
    """A run of blanks inside a text isn't gone through from each of its places."""
    began = time.monotonic()
    text = F.concat(F.lit("\x1c　a"), F.repeat(F.lit(" "), F.lit(400_000)), F.lit("b\n\nc  "))
    found = spark.range(1).select(F.length(t.strip(text)), F.length(t.first_line(text)), t.first_line(F.lit(" \n\x0b\n  d e \nf"))).first()
    assert tuple(found) == (400_005, 400_002, "d e") and time.monotonic() - began < 20


def test_documents_are_dealt_out_by_size(spark, monkeypatch):
    """The more text, the more parts, so that a task's memory doesn't grow with the table."""
    monkeypatch.setattr(text_source, "PART_BYTES", 1000)
    docs = spark.range(40).select(F.col("id").cast("string").alias("document_id"), F.concat(F.lit("Chapter 1\n"), F.repeat(F.lit("some words. "), F.lit(80))).alias("text"))
    blocks = text_blocks(docs)
    assert blocks.rdd.getNumPartitions() == 39 and blocks.count() == 80
    assert templates.chunk(blocks, "generic_structured")[1].rdd.getNumPartitions() == 39


def test_materialized_tables_are_made_from_each_other(spark):
    """Kept children, parents and pages come from the tables kept before them, not from the texts again."""
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    docs = spark.range(1).select(F.lit("d").alias("document_id"), F.udf(seen)(F.lit("Chapter 1\nwords of it.\nmore of them.")).alias("text"))
    package = chunk_package(text_blocks(docs)).materialize()
    assert package.children.count() == 1 and package.parents.count() == 1 and package.pages.count() == 1
    assert read.value <= 2  # once for the volume, once for the blocks
