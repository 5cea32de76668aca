"""Registered queries and their DuckDB counterparts.

The supplied prose has no headings, articles or questions of its own, so queries put some in by rule: a line's number in its
document decides what it becomes, in Spark and in SQL alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docloom.config import ChunkConfig
from docloom.functions import boxes, ids, text as t
from docloom.operators import doctype, flat, legacy, noise, post, quality, sections, templates
from docloom.plans import chunking, output
from docloom.sources import layout, pages, table
from docloom.sources.text import text_blocks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("document_id"), "text")


def _decorated(spark: SparkSession, sf: str, rule: Callable[[Column, Column], Column]) -> DataFrame:
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x, i: rule(F.trim(x), i))
    return _docs(spark, sf).select("document_id", F.array_join(lines, "\n").alias("text"))


def _book_line(x: Column, i: Column) -> Column:
    return F.when(i % 5 == 0, F.concat(F.lit("Chapter "), F.floor(i / 5 + 1).cast("string"))).when(i % 5 == 3, F.concat(F.lit("- "), x)).otherwise(x)


def _law_line(x: Column, i: Column) -> Column:
    return F.when(i % 6 == 0, F.concat(F.lit("Chapter "), F.floor(i / 6 + 1).cast("string"))).when(i % 6 == 1, F.concat(F.lit("Article "), i.cast("string"))).when(i % 6 == 3, F.concat(F.lit("(a) "), x)).otherwise(x)


def _manual_line(x: Column, i: Column) -> Column:
    return F.when(i % 6 == 0, F.concat(F.lit("Section "), F.floor(i / 6 + 1).cast("string"))).when(i % 6 == 2, F.concat(F.lit("Step "), i.cast("string"), F.lit(" "), x)).when(i % 6 == 4, F.concat(F.lit("WARNING "), x)).otherwise(x)


def _paper_line(x: Column, i: Column) -> Column:
    return F.when(i == 0, "Abstract").when(i == 2, "1 Introduction").when(i % 6 == 5, "References").otherwise(x)


_PARTS = r"""
lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS raw, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) - 1 AS i
  FROM documents),
blocks AS (
  SELECT document_id, i, CASE WHEN i % 5 = 0 THEN 'Chapter ' || (i // 5 + 1) WHEN i % 5 = 3 THEN '- ' || trim(raw) ELSE trim(raw) END AS text,
    CASE WHEN i % 5 = 0 THEN 'heading' WHEN i % 5 = 3 THEN 'list_item' ELSE 'paragraph' END AS block_type, 'Chapter ' || (i // 5 + 1) AS heading,
    CAST(len(regexp_extract_all(CASE WHEN i % 5 = 0 THEN 'Chapter ' || (i // 5 + 1) ELSE raw END, '[a-zA-Z0-9]+(?:[-''][a-zA-Z0-9]+)*')) AS BIGINT) AS latin
  FROM lines)"""


@query("SELECT doc_id, sha256(text) AS document_id FROM documents")
def doc_ids(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", ids.document_id(F.col("text")).alias("document_id"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{20000}-\x{2a6df}]')) + len(regexp_extract_all(text, '[a-zA-Z0-9]+(?:[-''][a-zA-Z0-9]+)*')) * 13 // 10 AS BIGINT) AS tokens FROM documents""")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", t.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"""WITH d AS (SELECT doc_id, '第' || doc_id || '条 本合同 naïve 𠀀豈㐀 a-b''c ' || text AS x FROM documents) SELECT doc_id, CAST(len(regexp_extract_all(x, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{20000}-\x{2a6df}]')) + len(regexp_extract_all(x, '[a-zA-Z0-9]+(?:[-''][a-zA-Z0-9]+)*')) * 13 // 10 AS BIGINT) AS tokens FROM d""")
def token_estimate_cjk(spark: SparkSession, sf: str) -> DataFrame:
    x = F.concat(F.lit("第"), F.col("doc_id").cast("string"), F.lit("条 本合同 naïve 𠀀豈㐀 a-b'c "), F.col("text"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", t.estimate_tokens(x).alias("tokens"))


@query(f"""WITH {_PARTS} SELECT document_id, CAST(i AS INTEGER) AS reading_order, block_type, heading, left(sha256('block:' || document_id || ':1:' || i || ':' || block_type), 32) AS block_id FROM blocks""")
def line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return text_blocks(_decorated(spark, sf, _book_line)).select("document_id", "reading_order", "block_type", t.heading_joined(F.col("heading_path")).alias("heading"), "block_id")


@query(f"""WITH {_PARTS} SELECT document_id, left(sha256('section:' || document_id || ':' || heading), 32) AS section_id, heading AS title, CAST(1 AS INTEGER) AS level, count(*) AS n_blocks FROM blocks GROUP BY ALL""")
def section_table(spark: SparkSession, sf: str) -> DataFrame:
    return sections.section_table(sections.heading_paths(text_blocks(_decorated(spark, sf, _book_line)))).select("document_id", "section_id", "title", "level", "n_blocks")


def _numbered_line(x: Column, i: Column) -> Column:
    k = F.floor(i / 6 + 1).cast("string")
    return F.when(i % 6 == 0, F.concat(k, F.lit(" Part"))).when(i % 6 == 2, F.concat(k, F.lit(".1 Sub"))).when(i % 6 == 3, F.concat(k, F.lit(".1.1 Deep"))).when(i % 6 == 5, F.concat(F.lit("2025 年 8 月 "), k)).otherwise(F.concat(x, F.lit(".")))


@query("""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(range(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))) AS i FROM documents), k AS (SELECT *, i // 6 + 1 AS k FROM l)
SELECT document_id, CAST(i AS INTEGER) AS reading_order, CAST(CASE i % 6 WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS INTEGER) AS heading_level, CASE WHEN i % 6 IN (0, 2, 3) THEN 'structured_heading_pattern' END AS heading_reason,
  k || ' Part' || CASE WHEN i % 6 >= 2 THEN ' > ' || k || '.1 Sub' ELSE '' END || CASE WHEN i % 6 >= 3 THEN ' > ' || k || '.1.1 Deep' ELSE '' END AS heading FROM k""")
def heading_levels(spark: SparkSession, sf: str) -> DataFrame:
    found = sections.heading_paths(text_blocks(_decorated(spark, sf, _numbered_line)))
    return found.select("document_id", "reading_order", "heading_level", "heading_reason", t.heading_joined(F.col("heading_path")).alias("heading"))


_RULES = "\n".join(
    f"WHEN len(list_filter([{', '.join(chr(39) + w + chr(39) for w in words)}], lambda w: contains(low, w))) > 0 THEN list_filter([{', '.join(chr(39) + w + chr(39) for w in words)}], lambda w: contains(low, w))" for words in doctype.KEYWORDS.values()
)
_KINDS = "\n".join(f"WHEN len(list_filter([{', '.join(chr(39) + w + chr(39) for w in words)}], lambda w: contains(low, w))) > 0 THEN '{name}'" for name, words in doctype.KEYWORDS.items())
_SAMPLE = """
lines AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS x, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) AS i FROM documents),
sums AS (SELECT *, coalesce(sum(length(trim(x))) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lines),
samples AS (SELECT document_id, string_agg(trim(x), chr(10) ORDER BY i) FILTER (before < 12000) AS sample FROM sums GROUP BY 1)"""


@query(f"""WITH {_SAMPLE}, d AS (SELECT document_id, lower(sample) AS low FROM samples), s AS (SELECT document_id, CASE {_KINDS} ELSE 'generic_structured' END AS document_type, CASE {_RULES} END AS hits FROM d)
SELECT document_id, document_type, CAST(round(100 * CASE WHEN hits IS NULL THEN 0.3 ELSE least(0.9, 0.55 + 0.1 * len(hits)) END) AS INTEGER) AS percent, coalesce(array_to_string(hits, ','), 'fallback') AS signals FROM s""")
def doc_type_detection(spark: SparkSession, sf: str) -> DataFrame:
    return doctype.detect(text_blocks(_docs(spark, sf))).select("document_id", "document_type", F.round(F.col("confidence") * 100).cast("int").alias("percent"), F.array_join("signals", ",").alias("signals"))


@query(f"""WITH {_SAMPLE} SELECT document_id, length(sample) AS n, sha256(sample) AS digest FROM samples""")
def sample_12000(spark: SparkSession, sf: str) -> DataFrame:
    return doctype.samples(text_blocks(_docs(spark, sf))).select("document_id", F.length("sample").cast("long").alias("n"), F.sha2("sample", 256).alias("digest"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents, turns as pages."""
    return spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").cast("string").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "role", "text")


def _page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    box = lambda y: F.struct(F.lit(0.0).alias("x0"), F.lit(y).alias("y0"), F.lit(500.0).alias("x1"), F.lit(y + 20.0).alias("y1"))
    parts = F.array(
        F.struct(F.lit("Report CONFIDENTIAL").alias("text"), box(10.0).alias("bbox")), F.struct(F.col("text"), box(300.0).alias("bbox")), F.struct(F.concat(F.lit("See you on page "), F.col("page_number").cast("string"), F.lit(" ....... 7")).alias("text"), box(400.0).alias("bbox")),
        F.struct(F.col("page_number").cast("string").alias("text"), box(800.0).alias("bbox")),
    )
    return _pages(spark, sf).select("document_id", "page_number", F.posexplode(parts).alias("reading_order", "x")).select("document_id", "page_number", "reading_order", F.lit("paragraph").alias("block_type"), "x.text", "x.bbox")


@query("""WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, count(DISTINCT turn) AS pages, count(*) AS n FROM conversations GROUP BY 1)
SELECT document_id, 'page_number' AS noise_reason, n FROM p UNION ALL SELECT document_id, 'toc_dot_leader', n FROM p UNION ALL SELECT document_id, 'repeated_page_edge', n FROM p WHERE pages >= 2 UNION ALL SELECT document_id, 'content', CASE WHEN pages >= 2 THEN n ELSE 2 * n END FROM p""")
def noise_reasons(spark: SparkSession, sf: str) -> DataFrame:
    marked = noise.mark_noise(_page_blocks(spark, sf))
    return marked.groupBy("document_id", F.coalesce("noise_reason", F.lit("content")).alias("noise_reason")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, coalesce(text, '') AS x FROM conversations),
l AS (SELECT document_id, ['Weekly report #', 'first ' || md5(x), 'second ' || md5(x || 'a')] AS header, ['second ' || md5(x || 'a'), 'third ' || md5(x || 'b'), '- # -'] AS footer FROM p),
z AS (SELECT document_id, 'header' AS zone, unnest(header) AS line FROM l UNION ALL SELECT document_id, 'footer', unnest(footer) FROM l), n AS (SELECT document_id, count(*) AS pages FROM l GROUP BY 1)
SELECT document_id, zone, regexp_replace(line, '[0-9]+', '#', 'g') AS norm FROM z JOIN n USING (document_id) WHERE pages >= 3 GROUP BY ALL HAVING count(*) >= max(pages) // 2""")
def header_footer(spark: SparkSession, sf: str) -> DataFrame:
    page = F.concat(F.lit("Weekly  report "), F.col("page_number").cast("string"), F.lit("\nfirst "), F.md5("text"), F.lit("\nsecond "), F.md5(F.concat("text", F.lit("a"))), F.lit("\nthird "), F.md5(F.concat("text", F.lit("b"))), F.lit("\n- "), F.col("page_number").cast("string"), F.lit(" -"))
    pages = _pages(spark, sf).withColumn("text", F.coalesce("text", F.lit("")))
    return noise.header_footer_lines(pages.select("document_id", "page_number", page.alias("text")))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(trim(text, chr(10) || ' '), '[0-9]+', '#', 'g'), '\s+', ' ', 'g') AS norm FROM documents""")
def normalized_lines(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", t.normalized_line(F.col("text")).alias("norm"))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents""")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """Page markers that are put in come out again."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spoiled = F.concat(F.lit("Page 3 of 9\n20240\n"), F.col("text"), F.lit("\n第 4 页 共 9 页\n\n\n\n12345678"))
    return docs.select("doc_id", F.trim(F.regexp_replace(t.clean_chunk_text(spoiled), r"\s+", " ")).alias("flat"))


@query(r"""WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn + 1 AS INTEGER) AS page_number, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM conversations),
g AS (SELECT *, CASE WHEN body <> '' AND last_value(CASE WHEN body <> '' THEN regexp_matches(body, '[。！？；.!?;）)」』"]$') END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 2 ELSE 0 END AS gap FROM p),
e AS (SELECT *, sum(gap + length(body)) OVER (PARTITION BY document_id ORDER BY page_number) AS stop FROM g)
SELECT document_id, page_number, CAST(stop - length(body) AS BIGINT) AS "start", CAST(stop AS BIGINT) AS "end" FROM e""")
def page_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return legacy.page_offsets(_pages(spark, sf))


@query("""SELECT 'supplier' AS document_id, CAST(s_suppkey - 1 AS INTEGER) AS reading_order, 'Sheet: supplier' || chr(10) || 'Row: ' || (s_suppkey + 1) || chr(10) || 's_suppkey: ' || s_suppkey || chr(10) || 's_name: ' || trim(s_name) || chr(10) || 's_nationkey: ' || s_nationkey AS text FROM supplier""")
def table_row_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/supplier.parquet").withColumn("at", F.col("s_suppkey") - 1)
    return table.sheet_blocks(rows, "supplier", "at", ["s_suppkey", "s_name", "s_nationkey"]).select("document_id", "reading_order", "text")


@query("""SELECT p_partkey, coalesce(nullif(trim(p_brand), ''), 'column_1') || '|column_2|' || trim(p_brand) || '_3|' || trim(p_type) AS headers FROM part""")
def table_headers(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.array_join(table.headers(F.array("p_brand", F.lit(" "), F.concat(F.lit(" "), "p_brand"), "p_type")), "|").alias("headers"))


_PACKED = f"""WITH RECURSIVE {_PARTS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id, heading ORDER BY i) AS rn FROM blocks),
fold AS (
  SELECT document_id, heading, i, rn, 0 AS child_no, latin AS total, text, block_type FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.document_id, n.heading, n.i, n.rn, CASE WHEN (f.total + n.latin) * 13 // 10 > 60 THEN f.child_no + 1 ELSE f.child_no END, CASE WHEN (f.total + n.latin) * 13 // 10 > 60 THEN n.latin ELSE f.total + n.latin END, n.text, n.block_type
  FROM fold f JOIN numbered n ON n.document_id = f.document_id AND n.heading = f.heading AND n.rn = f.rn + 1),
children AS (
  SELECT document_id, heading, child_no, string_agg(text, chr(10) || chr(10) ORDER BY rn) AS body, count(*) AS n_blocks, bool_and(block_type = 'list_item') AS lists FROM fold GROUP BY ALL),
texts AS (SELECT *, CASE WHEN starts_with(body, heading) THEN body ELSE heading || chr(10) || chr(10) || body END AS text FROM children)"""


@query(_PACKED + """ SELECT document_id, heading, CAST(child_no AS INTEGER) AS child_index, CASE WHEN lists THEN 'list' ELSE 'text' END AS chunk_type, n_blocks, text, CAST(len(regexp_extract_all(text, '[a-zA-Z0-9]+(?:[-''][a-zA-Z0-9]+)*')) * 13 // 10 AS BIGINT) AS token_count FROM texts""")
def generic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    children = templates.chunk(text_blocks(_decorated(spark, sf, _book_line)), "generic_structured", ChunkConfig(child_max_tokens=60))[1]
    return children.select("document_id", t.heading_joined(F.col("heading_path")).alias("heading"), "child_index", "chunk_type", F.size("source_block_ids").cast("long").alias("n_blocks"), "text", "token_count")


@query(f"""WITH {_PARTS} SELECT document_id, heading AS title, left(sha256('parent:' || document_id || ':' || left(sha256('section:' || document_id || ':' || heading), 32)), 32) AS parent_id, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text FROM blocks GROUP BY document_id, heading""")
def generic_parents(spark: SparkSession, sf: str) -> DataFrame:
    return templates.chunk(text_blocks(_decorated(spark, sf, _book_line)), "generic_structured")[0].select("document_id", "title", "parent_id", "text")


@query(_PACKED + """, m AS (SELECT *, len(regexp_extract_all(text, '[a-zA-Z0-9]+(?:[-''][a-zA-Z0-9]+)*')) * 13 // 10 AS tokens FROM texts)
SELECT document_id, count(DISTINCT heading) AS parent_count, count(*) AS child_count, CAST(0 AS BIGINT) AS orphan_child_count, count(*) FILTER (tokens > 60) AS over_max_token_child_count, CAST(max(tokens) AS BIGINT) AS max_tokens, CAST(min(tokens) AS BIGINT) AS min_tokens, CAST(sum(tokens) / count(*) AS DOUBLE) AS avg_tokens FROM m GROUP BY 1""")
def quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    config = ChunkConfig(child_max_tokens=60)
    found = quality.metrics(*templates.chunk(text_blocks(_decorated(spark, sf, _book_line)), "generic_structured", config), config)
    return found.select("document_id", "parent_count", "child_count", "orphan_child_count", "over_max_token_child_count", F.col("max_tokens_per_child").alias("max_tokens"), F.col("min_tokens_per_child").alias("min_tokens"), F.col("avg_tokens_per_child").alias("avg_tokens"))


@query(_PACKED + """ SELECT 'block_type' AS what, block_type AS value, count(*) AS n FROM blocks GROUP BY 2 UNION ALL SELECT 'chunk_type', CASE WHEN lists THEN 'list' ELSE 'text' END, count(*) FROM children GROUP BY 2""")
def distributions(spark: SparkSession, sf: str) -> DataFrame:
    blocks = text_blocks(_decorated(spark, sf, _book_line))
    return quality.distributions(blocks, templates.chunk(blocks, "generic_structured", ChunkConfig(child_max_tokens=60))[1])


@query(_PACKED + """ SELECT document_id, heading, CAST(child_no AS INTEGER) AS child_index FROM texts WHERE contains(lower(text), 'chapter 2')""")
def chunk_search(spark: SparkSession, sf: str) -> DataFrame:
    children = templates.chunk(text_blocks(_decorated(spark, sf, _book_line)), "generic_structured", ChunkConfig(child_max_tokens=60))[1]
    return quality.search(children, "Chapter 2").select("document_id", t.heading_joined(F.col("heading_path")).alias("heading"), "child_index")


@query(r"""WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, regexp_extract_all(text, '\S+') AS w FROM documents), n AS (SELECT *, CASE WHEN len(w) <= 100 THEN 1 ELSE CAST(ceil((len(w) - 100) / 80.0) AS INTEGER) + 1 END AS n FROM w WHERE len(w) > 0),
e AS (SELECT document_id, w, unnest(range(n)) AS k FROM n) SELECT document_id, CAST(k AS INTEGER) AS chunk_index, array_to_string(w[k * 80 + 1 : k * 80 + 100], ' ') AS text FROM e""")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return legacy.sliding_windows(_docs(spark, sf), 100, 20)


@query(f"""WITH RECURSIVE {_PARTS}, u AS (SELECT document_id, i, latin * 13 // 10 AS tokens FROM blocks), fold AS (
  SELECT document_id, i, CAST(0 AS BIGINT) AS n, tokens AS total, tokens FROM u WHERE i = 0 UNION ALL
  SELECT u.document_id, u.i, CASE WHEN f.total + u.tokens > 400 THEN f.n + 1 ELSE f.n END, CASE WHEN f.total + u.tokens > 400 THEN u.tokens ELSE f.total + u.tokens END, u.tokens FROM fold f JOIN u ON u.document_id = f.document_id AND u.i = f.i + 1)
SELECT document_id, CAST(n AS INTEGER) AS chunk_index, count(*) AS n_blocks, CAST(sum(tokens) AS BIGINT) AS tokens FROM fold GROUP BY ALL""")
def paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return legacy.paragraph_chunks(text_blocks(_decorated(spark, sf, _book_line)))


_DOMAIN_HITS = ", ".join(f"CASE WHEN {' OR '.join(f'contains(low, {chr(39)}{w.replace(chr(39), chr(39) * 2)}{chr(39)})' for w in words)} THEN '{name}' END" for name, words in t.DOMAIN_WORDS.items())


@query(f"""WITH d AS (SELECT doc_id, lower(text || CASE doc_id % 5 WHEN 0 THEN ' Check the COOLANT' WHEN 1 THEN ' generator fault' WHEN 2 THEN ' 给付' WHEN 3 THEN ' rectifier, engine' ELSE '' END) AS low FROM documents), h AS (SELECT doc_id, list_filter([{_DOMAIN_HITS}], lambda x: x IS NOT NULL) AS hits FROM d)
SELECT doc_id, CASE WHEN len(hits) > 1 AND list_contains(hits, 'Troubleshooting') THEN 'Troubleshooting' ELSE hits[1] END AS hint FROM h""")
def domain_hint(spark: SparkSession, sf: str) -> DataFrame:
    more = F.create_map(*[F.lit(x) for pair in {0: " Check the COOLANT", 1: " generator fault", 2: " 给付", 3: " rectifier, engine", 4: ""}.items() for x in pair])
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("x", F.concat("text", more[(F.col("doc_id") % 5).cast("int")]))
    return docs.select("doc_id", t.domain_hint(F.col("x")).alias("hint"))


@query("""SELECT s_suppkey, '| Name | Key &' || chr(10) AS a, '| Name | Key & co |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || trim(s_name) || ' é | ' || s_suppkey || '\\| x |' || chr(10) || '| only |  |' AS md FROM supplier""".replace("'| Name | Key &' || chr(10) AS a, ", ""))
def html_table_md(spark: SparkSession, sf: str) -> DataFrame:
    html = F.concat(F.lit("<p>x</p><TABLE><tr><th>Name</th><th> Key &amp;\n co</th></tr><tr></tr><tr><td>"), "s_name", F.lit(" &eacute;</td><td><b>"), F.col("s_suppkey").cast("string"), F.lit("</b>| x</td></tr><tr><td>only</td></tr></TABLE>"))
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", t.html_table_markdown(html).alias("md"))


_LATIN_OF = "CAST(len(regexp_extract_all({0}, '[a-zA-Z0-9]+(?:[-''][a-zA-Z0-9]+)*')) AS BIGINT)"


def _lines_sql(rule: str) -> str:
    """Lines of the documents, each made what the rule says of its text x and its number i, with the type that plain text gives it."""
    return rf"""raw AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(list_filter(string_split(text, chr(10)), lambda y: trim(y) <> '')) AS y, generate_subscripts(list_filter(string_split(text, chr(10)), lambda y: trim(y) <> ''), 1) - 1 AS i FROM documents),
lines AS (SELECT document_id, i, {rule} AS text FROM (SELECT document_id, i, trim(y) AS x FROM raw)),
typed AS (SELECT *, lower(text) AS low, CASE WHEN length(text) <= 80 AND (lower(text) IN ('abstract', 'references', 'contents', 'faq') OR regexp_matches(lower(text), '^(chapter |section |part |appendix )')) THEN 'heading'
  WHEN regexp_matches(text, '^\s*([-*+]\s+|\d+[.)]\s+|[①-⑩])') THEN 'list_item' ELSE 'paragraph' END AS block_type FROM lines)"""


def _packed_sql(source: str, opens: str, title: str, breaks: str, free: str, solo: str, kind: str, article: str, body: str, budget: int, carry: bool = False, follow: str = "NULL", default: str = "Document") -> str:
    """Children by template: a recursive packing of ``typed(document_id, i, text, low, block_type)`` in each parent."""
    words = _LATIN_OF.format("text")
    label = "last_value(article IGNORE NULLS) OVER (PARTITION BY document_id, parent ORDER BY child_no ROWS UNBOUNDED PRECEDING)" if carry else "article"
    return f"""WITH RECURSIVE {source},
opened AS (SELECT *, {words} AS latin, coalesce(last_value(CASE WHEN {opens} THEN {title} END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY i ROWS UNBOUNDED PRECEDING), {follow}, '{default}') AS parent FROM typed),
unit AS (SELECT *, CAST({breaks} AS BOOLEAN) AS brk, CAST({free} AS BOOLEAN) AS free, CAST({solo} AS BOOLEAN) AS solo, {kind} AS kind, {article} AS article, CAST({body} AS BOOLEAN) AS has_body, row_number() OVER (PARTITION BY document_id, parent ORDER BY i) AS rn FROM opened),
fold AS (
  SELECT document_id, parent, rn, 0 AS child_no, CASE WHEN solo THEN 1 ELSE 0 END AS next_no, latin AS total, NOT solo AS open FROM unit WHERE rn = 1
  UNION ALL
  SELECT u.document_id, u.parent, u.rn, CASE WHEN f.open AND (u.solo OR u.brk OR ((f.total + u.latin) * 13 // 10 > {budget} AND NOT u.free)) THEN f.next_no + 1 ELSE f.next_no END,
    CASE WHEN f.open AND (u.solo OR u.brk OR ((f.total + u.latin) * 13 // 10 > {budget} AND NOT u.free)) THEN f.next_no + 1 ELSE f.next_no END + CASE WHEN u.solo THEN 1 ELSE 0 END,
    CASE WHEN NOT f.open OR u.solo OR u.brk OR ((f.total + u.latin) * 13 // 10 > {budget} AND NOT u.free) THEN u.latin ELSE f.total + u.latin END, NOT u.solo
  FROM fold f JOIN unit u ON u.document_id = f.document_id AND u.parent = f.parent AND u.rn = f.rn + 1),
members AS (SELECT u.*, f.child_no FROM unit u JOIN fold f USING (document_id, parent, rn)),
grouped AS (
  SELECT document_id, parent, child_no, string_agg(text, chr(10) || chr(10) ORDER BY rn) AS joined, count(*) AS n_blocks, arg_min(kind, rn) AS kind, arg_max(article, rn) FILTER (article IS NOT NULL) AS article, bool_or(has_body) AS has_body FROM members GROUP BY ALL),
labelled AS (SELECT *, {label} AS label, max(child_no) OVER (PARTITION BY document_id, parent) AS last_no FROM grouped),
kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id, parent ORDER BY child_no) - 1 AS INTEGER) AS child_index, CASE WHEN label IS NOT NULL AND label <> parent THEN parent || ' > ' || label ELSE parent END AS heading, CASE WHEN label IS NOT NULL AND label <> parent THEN label ELSE parent END AS deepest, CASE WHEN label IS NOT NULL AND label <> parent THEN parent ELSE '' END AS above FROM labelled WHERE has_body),
texts AS (SELECT *, CASE WHEN starts_with(joined, deepest) THEN CASE WHEN above <> '' THEN above || chr(10) || chr(10) || trim(joined) ELSE trim(joined) END WHEN starts_with(joined, heading) THEN trim(joined) ELSE heading || chr(10) || chr(10) || trim(joined) END AS text FROM kept)
SELECT document_id, child_index, {{type}} AS chunk_type, heading, CAST(n_blocks AS INTEGER) AS n_blocks, CAST({_LATIN_OF.format("text")} * 13 // 10 AS BIGINT) AS token_count, label AS article, text FROM texts"""


_LAW_RULE = "CASE WHEN i % 6 = 0 THEN 'Chapter ' || (i // 6 + 1) WHEN i % 6 = 1 THEN 'Article ' || i WHEN i % 6 = 3 THEN '(a) ' || x ELSE x END"
_BOOK_RULE = "CASE WHEN i % 5 = 0 THEN 'Chapter ' || (i // 5 + 1) WHEN i % 5 = 3 THEN '- ' || x ELSE x END"
_MANUAL_RULE = "CASE WHEN i % 6 = 0 THEN 'Section ' || (i // 6 + 1) WHEN i % 6 = 2 THEN 'Step ' || i || ' ' || x WHEN i % 6 = 4 THEN 'WARNING ' || x ELSE x END"
_PAPER_RULE = "CASE WHEN i = 0 THEN 'Abstract' WHEN i = 2 THEN '1 Introduction' WHEN i % 6 = 5 THEN 'References' ELSE x END"
_ARTICLE_SQL = "regexp_matches(low, '^\\s*article\\s+\\d+')"
_CLAUSE_SQL = "(block_type = 'list_item' OR regexp_matches(text, '^\\s*([（(][一二三四五六七八九十百千万零〇两0-9a-zA-Z]+[）)]|[①-⑩]|\\d+[.)、])'))"
_STEP_SQL = "(block_type = 'list_item' OR regexp_matches(low, '^\\s*(step\\s+\\d+|\\d+[.)]\\s+)'))"
_CALL_SQL = "regexp_matches(low, '^\\s*(warning|caution|note|danger|important)([^0-9a-z_à-ɏ]|$)')"
_CONTRACT_SQL = _packed_sql(_lines_sql(_LAW_RULE), f"block_type = 'heading' AND length(text) <= 30 AND NOT {_ARTICLE_SQL}", "text", _ARTICLE_SQL, _CLAUSE_SQL, "false", "'contract_clause'", f"CASE WHEN {_ARTICLE_SQL} THEN text END", "block_type <> 'heading'", 0, carry=True)
_SECTION_SQL = "(block_type = 'heading' OR regexp_matches(low, '^\\s*(\\d+(\\.\\d+)*\\s+)?(abstract|introduction|background|methods?|methodology|results?|discussion|conclusion|references|appendix)([^0-9a-z_à-ɏ]|$)'))"


def _budget(sql: str, old: int, new: int) -> str:
    return sql.replace(f"* 13 // 10 > {old} AND", f"* 13 // 10 > {new} AND")


_TEMPLATE_SQL = {
    "contract_chunks": _budget(_CONTRACT_SQL, 0, 120).replace("{type}", "kind"),
    "laws_chunks": _packed_sql(_lines_sql(_LAW_RULE), "regexp_matches(low, '^\\s*(chapter\\s+\\d+|section\\s+\\d+)')", "text", _ARTICLE_SQL, _CLAUSE_SQL, "false", "'legal_article'", f"CASE WHEN {_ARTICLE_SQL} THEN text END", "true", 120).replace("{type}", "kind"),
    "book_chunks": _packed_sql(_lines_sql(_BOOK_RULE), "(regexp_matches(low, '^\\s*(chapter\\s+\\d+|book\\s+\\d+|part\\s+\\d+)') OR (block_type = 'heading' AND regexp_matches(low, '^(preface|appendix|chapter|part )')))", "text", "block_type = 'heading'", "false", "false", "'book_section'", "CAST(NULL AS VARCHAR)", "true", 120).replace("{type}", "kind"),
    "paper_chunks": _packed_sql(_lines_sql(_PAPER_RULE), _SECTION_SQL, "text", "false", "(contains(lower(parent), 'abstract') OR contains(lower(parent), 'references'))", "false", "'paper_text'", "CAST(NULL AS VARCHAR)", "true", 120).replace(
        "{type}", "CASE WHEN child_no = last_no AND contains(lower(parent), 'abstract') THEN 'paper_abstract' WHEN child_no = last_no AND contains(lower(parent), 'references') THEN 'paper_references' ELSE kind END"
    ),
    "manual_chunks": _packed_sql(
        _lines_sql(_MANUAL_RULE), "block_type = 'heading'", "text", f"coalesce(({_STEP_SQL} AND NOT {_CALL_SQL} OR {_STEP_SQL}) <> lag({_STEP_SQL}) OVER (PARTITION BY document_id ORDER BY i), false)", f"{_STEP_SQL} AND NOT {_CALL_SQL}", _CALL_SQL, f"CASE WHEN {_CALL_SQL} THEN 'manual_callout' WHEN {_STEP_SQL} THEN 'manual_procedure' ELSE 'manual_text' END", "CAST(NULL AS VARCHAR)", "true", 120,
    ).replace("{type}", "kind"),
    "qa_chunks": _packed_sql(
        "typed AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn AS i, CASE WHEN role = 'user' THEN 'Q: ' ELSE 'A: ' END || text AS text, lower(CASE WHEN role = 'user' THEN 'Q: ' ELSE 'A: ' END || text) AS low, 'paragraph' AS block_type FROM conversations WHERE text IS NOT NULL)",
        "false", "text", "regexp_matches(low, '^\\s*q(uestion)?\\s*[:：]')", "true", "false", "'qa_pair'", "CAST(NULL AS VARCHAR)", "true", 120, default="QA",
    ).replace("{type}", "kind"),
    "picture_chunks": _packed_sql(
        "typed AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn AS i, CASE WHEN role = 'user' THEN 'Q: ' ELSE 'A: ' END || text AS text, '' AS low, 'paragraph' AS block_type FROM conversations WHERE text IS NOT NULL)",
        "true", "'Page ' || (i + 1)", "false", "false", "false", "'ocr_text'", "CAST(NULL AS VARCHAR)", "true", 120,
    ).replace("{type}", "kind"),
    "table_row_groups": _packed_sql(
        "typed AS (SELECT 'supplier' AS document_id, s_suppkey - 1 AS i, 'Sheet: supplier' || chr(10) || 'Row: ' || (s_suppkey + 1) || chr(10) || 's_suppkey: ' || s_suppkey || chr(10) || 's_name: ' || trim(s_name) || chr(10) || 's_nationkey: ' || s_nationkey AS text, '' AS low, 'table' AS block_type FROM supplier)",
        "true", "'supplier'", "false", "false", "false", "'table_row_group'", "CAST(NULL AS VARCHAR)", "true", 120,
    ).replace("{type}", "kind"),
}
_ARTICLE_PARTS_SQL = f"""WITH c AS ({_budget(_CONTRACT_SQL, 0, 60).replace("{type}", "kind").replace("SELECT document_id, child_index,", "SELECT document_id, left(sha256('parent:' || document_id || ':' || left(sha256('template-section:' || document_id || ':' || parent), 32)), 32) AS parent_id, child_index,")}), n AS (SELECT *, count(*) OVER (PARTITION BY document_id, parent_id, article) AS many FROM c)
SELECT document_id, parent_id, child_index, article, CASE WHEN article IS NOT NULL AND many > 1 THEN CAST(row_number() OVER (PARTITION BY document_id, parent_id, article ORDER BY child_index) AS INTEGER) END AS part_index, CASE WHEN article IS NOT NULL AND many > 1 THEN CAST(many AS INTEGER) END AS part_count FROM n"""


def _template_query(name: str, blocks: Callable[[SparkSession, str], DataFrame], template: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        children = templates.chunk(blocks(spark, sf), template, ChunkConfig(child_max_tokens=120))[1]
        return children.select("document_id", "child_index", "chunk_type", t.heading_joined(F.col("heading_path")).alias("heading"), F.size("source_block_ids").alias("n_blocks"), "token_count", "article", "text")

    run.__name__ = name
    query(_TEMPLATE_SQL.get(name))(run)


def _qa_blocks(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.concat(F.when(F.col("role") == "user", "Q: ").otherwise("A: "), F.col("text"))
    pages = _pages(spark, sf).select("document_id", "page_number", F.lit(0).alias("reading_order"), F.lit("paragraph").alias("block_type"), marked.alias("text"), F.array().cast("array<string>").alias("heading_path"))
    return pages.withColumn("block_id", ids.block_id(F.col("document_id"), F.col("page_number"), F.col("reading_order"), F.col("block_type")))


def _sheet(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/supplier.parquet").withColumn("at", F.col("s_suppkey") - 1)
    return table.sheet_blocks(rows, "supplier", "at", ["s_suppkey", "s_name", "s_nationkey"])


_template_query("contract_chunks", lambda s, d: text_blocks(_decorated(s, d, _law_line)), "contract_terms")
_template_query("laws_chunks", lambda s, d: text_blocks(_decorated(s, d, _law_line)), "laws")
_template_query("book_chunks", lambda s, d: text_blocks(_decorated(s, d, _book_line)), "book")
_template_query("paper_chunks", lambda s, d: text_blocks(_decorated(s, d, _paper_line)), "paper")
_template_query("manual_chunks", lambda s, d: text_blocks(_decorated(s, d, _manual_line)), "manual")
_template_query("qa_chunks", _qa_blocks, "qa")
_template_query("picture_chunks", _qa_blocks, "picture_pdf")
_template_query("table_row_groups", _sheet, "table_data")


@query(_ARTICLE_PARTS_SQL)
def article_parts(spark: SparkSession, sf: str) -> DataFrame:
    children = templates.chunk(text_blocks(_decorated(spark, sf, _law_line)), "contract_terms", ChunkConfig(child_max_tokens=60))[1]
    return templates.article_parts(children).select("document_id", "parent_id", "child_index", "article", F.col("article_part_index").alias("part_index"), F.col("article_part_count").cast("int").alias("part_count"))


@query(f"""WITH {_PARTS}, k AS (SELECT *, CASE WHEN i % 7 = 4 THEN 'table' WHEN i % 7 = 5 THEN 'caption' ELSE block_type END AS kind, left(sha256('block:' || document_id || ':1:' || i || ':' || block_type), 32) AS block_id FROM blocks),
u AS (SELECT document_id, heading, i, text, kind FROM k WHERE kind <> 'table'), m AS (SELECT * FROM k WHERE kind IN ('table', 'caption')),
c AS (SELECT m.*, lag(kind) OVER w AS was, lead(kind) OVER w AS will, lag(text) OVER w AS was_text, lead(text) OVER w AS will_text FROM k m WINDOW w AS (PARTITION BY document_id ORDER BY i)),
b AS (SELECT m.document_id, m.i, list(u.text ORDER BY u.i DESC)[1:2] AS before FROM m JOIN u ON u.document_id = m.document_id AND u.heading = m.heading AND u.i < m.i GROUP BY ALL), a AS (SELECT m.document_id, m.i, list(u.text ORDER BY u.i)[1:2] AS after FROM m JOIN u ON u.document_id = m.document_id AND u.heading = m.heading AND u.i > m.i GROUP BY ALL),
f AS (SELECT c.document_id, c.i, list_concat(CASE WHEN was = 'caption' THEN [was_text] ELSE [] END, CASE WHEN will = 'caption' THEN [will_text] ELSE [] END) AS captions, coalesce(list_reverse(before), []) AS before, coalesce(after, []) AS after FROM c LEFT JOIN b USING (document_id, i) LEFT JOIN a USING (document_id, i) WHERE kind IN ('table', 'caption'))
SELECT document_id, CAST(i AS INTEGER) AS reading_order, nullif(array_to_string(list_concat(captions, before), chr(10) || chr(10)), '') AS context_before, nullif(array_to_string(after, chr(10) || chr(10)), '') AS context_after, CASE WHEN len(captions) > 0 THEN 'caption_and_same_section_neighbors' ELSE 'same_section_neighbors' END AS context_strategy FROM f""")
def media_context(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("reading_order") % 7 == 4, "table").when(F.col("reading_order") % 7 == 5, "caption").otherwise(F.col("block_type"))
    blocks = sections.heading_paths(text_blocks(_decorated(spark, sf, _book_line))).withColumn("block_type", kind)
    found = post.with_context(blocks).filter("context is not null")
    return found.select("document_id", "reading_order", "context.context_before", "context.context_after", "context.context_strategy")


@query()
def chunk_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Children of whole packages, each document by the template of its type, after all passes."""
    children = chunking.chunk_blocks(text_blocks(_decorated(spark, sf, _book_line)))[1]
    return children.select("document_id", "chunk_id", "chunk_type", "template", "text", "token_count", "part_index", "part_count")


@query(rf"""WITH h AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn + 1 AS INTEGER) AS page, coalesce(text, '') AS x, length(coalesce(text, '')) // 2 AS half FROM conversations),
b AS (SELECT document_id, page, left(x, half) || 'xx' || substr(x, half + 1) AS body FROM h),
t AS (SELECT *, regexp_replace(body, '\s+$', '') AS ends, regexp_replace(body, '^\s+', '') AS starts FROM b),
f AS (SELECT *, '^\s*([-*•·]|\d+[.)。]|[①-⑩]|[（(]\d+[）)])\s+' AS item, list_filter(list_transform(string_split(ends, chr(10)), lambda y: regexp_extract(trim(y), '^(\d+)[.)、]\s+', 1)), lambda y: y <> '') AS numbers, regexp_extract(starts, '^(\d+)[.)、]\s+', 1) AS number FROM t),
w AS (SELECT *, lag(ends) OVER p AS was, lag(numbers) OVER p AS had FROM f WINDOW p AS (PARTITION BY document_id ORDER BY page)),
j AS (SELECT *, was IS NOT NULL AND ((regexp_matches(was, '-$') AND regexp_matches(starts, '^\p{{Ll}}')) OR (NOT regexp_matches(was, '[.!?"»」』。！？…—]$') AND (regexp_matches(starts, '^\p{{Ll}}') OR (regexp_matches(starts, '^[一-鿿]') AND NOT regexp_matches(starts, item)) OR regexp_matches(was, '[,，、;；:：]$')))
  OR (regexp_matches(starts, item) AND (regexp_matches(trim(string_split(was, chr(10))[-1]), item) OR (number <> '' AND len(had) > 0 AND TRY_CAST(number AS BIGINT) = TRY_CAST(had[-1] AS BIGINT) + 1)))) AS joins FROM w),
g AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY page) AS grp FROM j),
m AS (SELECT *, lead(joins) OVER p AS goes_on, lead(starts) OVER p AS will FROM g WINDOW p AS (PARTITION BY document_id ORDER BY page)),
k AS (SELECT *, CASE WHEN joins THEN starts ELSE body END AS piece, CASE WHEN NOT coalesce(goes_on, false) THEN '' WHEN regexp_matches(ends, '[\x00-\x7f]$') AND NOT regexp_matches(ends, '[.!?]$') AND NOT (regexp_matches(ends, '-$') AND regexp_matches(will, '^\p{{Ll}}')) THEN ' ' ELSE '' END AS gap FROM m),
l AS (SELECT *, CASE WHEN coalesce(goes_on, false) THEN CASE WHEN regexp_matches(ends, '-$') AND regexp_matches(will, '^\p{{Ll}}') THEN regexp_replace(piece, '\s*-\s*$', '') ELSE regexp_replace(piece, '\s+$', '') END ELSE piece END AS part FROM k),
a AS (SELECT document_id, grp, min(page) AS first, max(page) AS last, count(*) AS n, string_agg(part || gap, '' ORDER BY page) AS text FROM l GROUP BY ALL)
SELECT document_id, document_id || ':' || first || ':0' AS chunk_id, text, CAST(2 * first AS INTEGER) AS page_start, CAST(2 * last + 1 AS INTEGER) AS page_end, CAST({_LATIN_OF.format("text")} * 13 // 10 AS BIGINT) AS token_count, CAST(2 * n - 1 AS INTEGER) AS repairs FROM a""")
def boundary_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as pages, cut in two by a hyphen, and joined again.  An empty or null turn is a page of the two marks alone."""
    half = F.floor(F.length("text") / 2).cast("int")
    pages = _pages(spark, sf).withColumn("text", F.coalesce("text", F.lit(""))).select(
        "document_id", F.posexplode(F.array(F.concat(F.substring("text", F.lit(1), half), F.lit("x-")), F.concat(F.lit("x"), F.substring(F.col("text"), half + 1, F.length("text"))))).alias("k", "text"), "page_number"
    )
    children = pages.select("document_id", F.col("document_id").alias("parent_id"), F.concat_ws(":", "document_id", "page_number", "k").alias("chunk_id"), (F.col("page_number") * 2 + F.col("k")).cast("int").alias("child_index"), F.lit("text").alias("chunk_type"), "text", (F.col("page_number") * 2 + F.col("k")).cast("int").alias("page_start"), (F.col("page_number") * 2 + F.col("k")).cast("int").alias("page_end"), F.array(F.concat_ws(":", "document_id", "page_number", "k")).alias("source_block_ids"), t.estimate_tokens(F.col("text")).alias("token_count"), F.lit(0).alias("parent_order"), F.array().cast("array<struct<block_id:string,page_number:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>").alias("bbox_refs"))
    return post.repair_boundaries(children).select("document_id", "chunk_id", "text", "page_start", "page_end", "token_count", "repairs")


@query(_PACKED + """, c AS (SELECT document_id, heading, child_no, count(*) OVER (PARTITION BY document_id, heading) AS n FROM children)
SELECT 'missing_child' AS code, count(*) AS n FROM c WHERE child_no = 1 HAVING count(*) > 0 UNION ALL SELECT 'missing_parent', count(*) FROM c WHERE child_no = 2 HAVING count(*) > 0""")
def package_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Faults that are put into packages: children without a parent, and children that a parent lists but that aren't there."""
    blocks = text_blocks(_decorated(spark, sf, _book_line))
    parents, children = (chunking.kept_table(x) for x in templates.chunk(blocks, "generic_structured", ChunkConfig(child_max_tokens=60)))
    lists = children.groupBy("parent_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("child_chunk_ids"))
    kept = children.filter("child_index <> 1").withColumn("parent_id", F.when(F.col("child_index") == 2, F.concat("parent_id", F.lit("?"))).otherwise(F.col("parent_id")))
    return quality.validate(parents.join(lists, "parent_id"), kept, blocks).groupBy("code").agg(F.count("*").alias("n"))


@query(_PACKED + """, m AS (SELECT t.*, CAST(len(regexp_extract_all(text, '[a-zA-Z0-9]+(?:[-''][a-zA-Z0-9]+)*')) * 13 // 10 AS BIGINT) AS token_count, CAST(regexp_extract(heading, '[0-9]+') AS INTEGER) AS nr, text = '' OR contains(',.;:!?，。；：！？、', left(text, 1)) AS marked FROM texts t),
r AS (SELECT *, CASE WHEN token_count = 0 THEN ['empty_tokens'] ELSE [] END || CASE WHEN marked THEN ['starts_with_punctuation'] ELSE [] END AS reasons FROM m),
k AS (SELECT *, len(reasons) > 0 AS risky, row_number() OVER (PARTITION BY document_id ORDER BY len(reasons) > 0 DESC, nr, child_no) AS risk_rank, row_number() OVER (PARTITION BY document_id ORDER BY token_count DESC, nr, child_no) AS size_rank, count(*) FILTER (len(reasons) > 0) OVER (PARTITION BY document_id) AS risks FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY risky DESC, CASE WHEN risky THEN risk_rank ELSE size_rank END) AS place FROM k WHERE (risky AND risk_rank <= 5) OR (NOT risky AND size_rank <= 3 AND risks < 5))
SELECT document_id, CAST(place AS INTEGER) AS place, token_count, CASE WHEN risky THEN array_to_string(reasons, ',') ELSE 'largest_chunk' END AS reasons FROM p WHERE place <= 5""")
def risk_samples(spark: SparkSession, sf: str) -> DataFrame:
    children = templates.chunk(text_blocks(_decorated(spark, sf, _book_line)), "generic_structured", ChunkConfig(child_max_tokens=60))[1]
    return quality.risk_samples(children).select("document_id", "place", "token_count", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH w AS (SELECT row_number() OVER (ORDER BY doc_id) AS pos, lang AS code, 'document ' || doc_id AS message FROM documents) SELECT code, count(*) AS n, min(pos) AS first_pos, array_to_string(list_slice(list(message ORDER BY pos), 1, 3), ',') AS examples FROM w GROUP BY code""")
def warning_groups(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    warnings = docs.select((F.col("doc_id") + 1).alias("pos"), F.col("lang").alias("code"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("message"))
    return quality.warning_groups(warnings).select("code", "n", "first_pos", F.array_join("examples", ",").alias("examples"))


@query()
def stream_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The documents file as a stream, all that is available now."""
    from docloom.streaming.stream import chunk_stream

    top = f"{chunking.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    chunk_stream(spark, f"{sf}/documents.parque*", f"{top}/out", f"{top}/state").awaitTermination()
    return spark.read.parquet(f"{top}/out").select("document_id", "chunk_type", "text", "token_count")


@query(r"""WITH d AS (SELECT doc_id, doc_id % 9 + 1 AS k, text FROM documents) SELECT doc_id, k || '-2' AS chapter, CAST(k AS VARCHAR) AS section, 'Oil and more' AS section_title FROM d""")
def page_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that begin with a chapter and a section."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    k = (F.col("doc_id") % 9 + 1).cast("string")
    page = F.concat(F.lit("CHAPTER "), k, F.lit("-2 of it\nSection "), k, F.lit(". Oil and more\n"), "text")
    return docs.select("doc_id", t.page_metadata(page).alias("m")).select("doc_id", "m.chapter", "m.section", "m.section_title")


_TURN_LINES = """p AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn + 1 AS INTEGER) AS page_number, coalesce(text, '') AS x FROM conversations),
l AS (SELECT document_id, page_number, ['Weekly  report ' || page_number, 'first ' || md5(x), 'second ' || md5(x || 'a'), 'third ' || md5(x || 'b'), '- ' || page_number || ' -'] AS lines FROM p),
n AS (SELECT *, list_transform(lines, lambda y: regexp_replace(regexp_replace(y, '[0-9]+', '#', 'g'), ' +', ' ', 'g')) AS norms FROM l), sizes AS (SELECT document_id, count(*) AS pages FROM l GROUP BY 1),
z AS (SELECT document_id, unnest(list_distinct(norms[1:3])) AS norm, 'h' AS zone FROM n UNION ALL SELECT document_id, unnest(list_distinct(norms[3:5])), 'f' FROM n),
gone AS (SELECT document_id, list(DISTINCT norm) AS gone FROM (SELECT document_id, zone, norm FROM z JOIN sizes USING (document_id) WHERE pages >= 3 GROUP BY ALL HAVING count(*) >= max(pages) // 2) GROUP BY 1)"""


@query(f"""WITH {_TURN_LINES} SELECT document_id, page_number, CASE WHEN gone IS NULL THEN array_to_string(lines, chr(10)) ELSE array_to_string(list_filter(lines, lambda y, i: NOT list_contains(gone, norms[i])), chr(10)) END AS text FROM n LEFT JOIN gone USING (document_id)""")
def headers_stripped(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as pages with a running head and a foot, without the lines that repeat."""
    page = F.concat(F.lit("Weekly  report "), F.col("page_number").cast("string"), F.lit("\nfirst "), F.md5("text"), F.lit("\nsecond "), F.md5(F.concat("text", F.lit("a"))), F.lit("\nthird "), F.md5(F.concat("text", F.lit("b"))), F.lit("\n- "), F.col("page_number").cast("string"), F.lit(" -"))
    pages_ = _pages(spark, sf).withColumn("text", F.coalesce("text", F.lit("")))
    return noise.strip_headers(pages_.select("document_id", "page_number", page.alias("text")))


@query("""SELECT p_partkey, CAST(least(k, 2 * k - 7) AS INTEGER) AS x0, CAST(k AS INTEGER) AS y0, CAST(greatest(k, 2 * k - 7) AS INTEGER) AS x1, CAST(k + 3 AS INTEGER) AS y1 FROM (SELECT p_partkey, p_partkey % 50 AS k FROM part) WHERE p_partkey % 6 <> 5 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 6 = 5""")
def boxes_of(spark: SparkSession, sf: str) -> DataFrame:
    """A box in each of the shapes that exports give it, and one that is none."""
    k = F.col("p_partkey") % 50
    a, b, x, y = (c.cast("string") for c in (k, 2 * k - 7, k, k + 3))
    shapes = [
        F.concat_ws("", F.lit("["), a, F.lit(","), x, F.lit(',"'), b, F.lit('",'), y, F.lit("]")), F.concat_ws("", F.lit('{"x0":'), b, F.lit(',"y0":'), x, F.lit(',"x1":'), a, F.lit(',"y1":'), y, F.lit("}")),
        F.concat_ws("", F.lit('{"t":'), y, F.lit(',"l":'), a, F.lit(',"b":'), x, F.lit(',"r":'), b, F.lit("}")), F.concat_ws("", F.lit("[["), a, F.lit(","), x, F.lit("],["), b, F.lit(","), x, F.lit("],["), b, F.lit(","), y, F.lit("]]")),
        F.concat_ws("", F.lit('{"type":"text","poly":[{"x":'), a, F.lit(',"y":'), y, F.lit('},{"x":'), b, F.lit(',"y":'), x, F.lit("}]}")), F.concat_ws("", F.lit('{"bbox":['), a, F.lit("]}")),
    ]
    json = F.coalesce(*[F.when(F.col("p_partkey") % 6 == i, shape) for i, shape in enumerate(shapes)])
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", boxes.box(json).alias("b")).select("p_partkey", *[F.col(f"b.{n}").cast("int").alias(n) for n in ("x0", "y0", "x1", "y1")])


def _content_lists(spark: SparkSession, sf: str) -> DataFrame:
    """A content list for each nation: its name as a title, then its suppliers as texts, captioned tables and figures in turn."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").withColumn("k", (F.col("s_suppkey") % 4).cast("int"))
    none = F.lit(None).cast("string")
    item = F.struct(
        F.when(F.col("k") == 1, "table").when(F.col("k") == 2, "image").when(F.col("k") == 3, "section_header").otherwise("text").alias("type"), F.when(F.col("k").isin(0, 3), F.col("s_name")).otherwise(none).alias("text"), F.when(F.col("k") == 3, 2).alias("text_level"),
        F.when(F.col("k") == 1, F.concat(F.lit("<table><tr><td>key</td></tr><tr><td>"), F.col("s_suppkey").cast("string"), F.lit("</td></tr></table>"))).alias("table_body"), F.when(F.col("k") == 1, F.array(F.lit("Table"), F.col("s_name"))).alias("table_caption"), F.when(F.col("k") == 2, F.concat(F.lit("Fig "), "s_name")).alias("img_caption"),
        F.col("k").alias("page_idx"),
    )
    lists = s.groupBy("s_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", item.alias("x")))), lambda y: y["x"]).alias("items"))
    title = F.concat(F.lit('[{"type":"title","text":"Nation '), F.col("s_nationkey").cast("string"), F.lit('","text_level":1,"page_idx":0},'))
    return lists.select(F.col("s_nationkey").cast("string").alias("document_id"), F.concat(title, F.substring(F.to_json("items"), F.lit(2), F.length(F.to_json("items")))).cast("binary").alias("content"))


@query("""WITH s AS (SELECT CAST(s_nationkey AS VARCHAR) AS document_id, CAST(s_suppkey % 4 AS INTEGER) AS k, s_suppkey, trim(s_name) AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier),
b AS (SELECT document_id, CAST(i AS INTEGER) AS reading_order, k + 1 AS page_number, CASE k WHEN 1 THEN 'table' WHEN 2 THEN 'figure' WHEN 3 THEN 'heading' ELSE 'paragraph' END AS block_type, CASE k WHEN 1 THEN 'Table ' || name || chr(10) || chr(10) || '| key |' || chr(10) || '| --- |' || chr(10) || '| ' || s_suppkey || ' |' WHEN 2 THEN 'Fig ' || name ELSE name END AS text, CASE WHEN k = 3 THEN name END AS head FROM s
  UNION ALL SELECT DISTINCT CAST(s_nationkey AS VARCHAR), 0, 1, 'heading', 'Nation ' || s_nationkey, NULL FROM supplier)
SELECT document_id, reading_order, page_number, block_type, text, 'Nation ' || document_id || coalesce(' > ' || last_value(head IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY reading_order ROWS UNBOUNDED PRECEDING), '') AS heading FROM b""")
def content_list_blocks(spark: SparkSession, sf: str) -> DataFrame:
    found = layout.item_blocks(layout.content_list(_content_lists(spark, sf)), "mineru")
    return found.select("document_id", "reading_order", "page_number", "block_type", "text", t.heading_joined(F.col("heading_path")).alias("heading"))


@query("""WITH s AS (SELECT CAST(s_nationkey AS VARCHAR) AS document_id, s_suppkey, trim(s_name) AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier)
SELECT document_id, CAST(i AS INTEGER) AS reading_order, CAST(s_suppkey % 3 + 1 AS INTEGER) AS page_number, CASE WHEN s_suppkey % 2 = 0 THEN 'heading' ELSE 'paragraph' END AS block_type, name AS text, coalesce(last_value(CASE WHEN s_suppkey % 2 = 0 THEN name END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY i ROWS UNBOUNDED PRECEDING), '') AS heading, CAST(s_suppkey % 3 AS INTEGER) AS x0 FROM s""")
def exported_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """An exported document for each nation, its suppliers as headings and texts."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    page = (F.col("s_suppkey") % 3 + 1).cast("int")
    box = F.struct((page - 1).alias("l"), F.lit(5).alias("t"), F.lit(50).alias("r"), F.lit(1).alias("b"))
    item = F.struct(F.when(F.col("s_suppkey") % 2 == 0, "section_header").otherwise("text").alias("label"), F.col("s_name").alias("text"), F.lit(1).alias("level"), F.array(F.struct(page.alias("page_no"), box.alias("bbox"))).alias("prov"))
    docs = s.groupBy("s_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", item.alias("x")))), lambda y: y["x"]).alias("texts"))
    files = docs.select(F.col("s_nationkey").cast("string").alias("document_id"), F.to_json(F.struct("texts")).cast("binary").alias("content"))
    found = layout.item_blocks(layout.exported(files), "docling")
    return found.select("document_id", "reading_order", "page_number", "block_type", "text", t.heading_joined(F.col("heading_path")).alias("heading"), F.col("bbox.x0").cast("int").alias("x0"))


@query(f"""WITH RECURSIVE u AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, {_LATIN_OF.format("text")} * 13 // 10 AS tokens FROM conversations),
f AS (SELECT document_id, rn, CAST(1 AS BIGINT) AS g, tokens AS total FROM u WHERE rn = 1 UNION ALL SELECT u.document_id, u.rn, CASE WHEN f.total < 30 THEN f.g ELSE f.g + 1 END, CASE WHEN f.total < 30 THEN f.total + u.tokens ELSE u.tokens END FROM f JOIN u ON u.document_id = f.document_id AND u.rn = f.rn + 1),
s AS (SELECT document_id, g, min(rn) AS first, count(*) AS n, sum(u.tokens) AS tokens FROM f JOIN u USING (document_id, rn) GROUP BY ALL), l AS (SELECT *, max(g) OVER (PARTITION BY document_id) AS last FROM s),
b AS (SELECT *, CASE WHEN g = last AND g > 1 AND tokens < 30 THEN g - 1 ELSE g END AS h FROM l)
SELECT document_id, CAST(min(first) - 1 AS INTEGER) AS child_index, CAST(sum(tokens) AS BIGINT) AS token_count, CAST(sum(n) - 1 AS INTEGER) AS merges FROM b GROUP BY document_id, h""")
def small_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as children of their conversation, small ones merged."""
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number")) - 1
    refs = F.array().cast("array<struct<block_id:string,page_number:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>")
    turns = _pages(spark, sf).select("document_id", F.col("document_id").alias("parent_id"), F.lit(0).alias("parent_order"), order.cast("int").alias("child_index"), F.concat_ws(":", "document_id", "page_number").alias("chunk_id"), F.lit("text").alias("chunk_type"), F.coalesce("text", F.lit("")).alias("text"), F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), F.array(F.col("page_number").cast("string")).alias("source_block_ids"), refs.alias("bbox_refs"), F.coalesce(t.estimate_tokens(F.col("text")), F.lit(0)).alias("token_count"))
    return post.merge_small(turns, ChunkConfig(child_min_tokens=60)).select("document_id", "child_index", "token_count", "merges")


@query("""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(range(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))) AS i FROM documents), n AS (SELECT document_id, count(*) AS n FROM l GROUP BY 1)
SELECT 'invalid_page' AS code, count(*) AS n FROM l WHERE i % 7 = 2 UNION ALL SELECT 'empty_box', count(*) FROM l WHERE i % 5 = 1 UNION ALL SELECT 'box_outside_page', count(*) FROM l WHERE i % 7 <> 2 AND i % 3 = 0 UNION ALL SELECT 'missing_page', count(*) FROM l WHERE i % 7 = 2 UNION ALL SELECT 'duplicate_block', count(*) FROM n""")
def block_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Faults that are put into blocks: pages that aren't there, boxes without area or beyond their page, and a first block that comes twice."""
    i = F.col("reading_order")
    b = text_blocks(_decorated(spark, sf, _book_line)).withColumn("page_number", F.when(i % 7 == 2, 0).otherwise(1)).withColumn("block_pos", i.cast("double"))
    wide = F.when(i % 3 == 0, 900.0).otherwise(50.0)
    b = b.withColumn("bbox", F.struct(F.lit(0.0).alias("x0"), F.lit(5.0).alias("y0"), wide.alias("x1"), F.when(i % 5 == 1, 5.0).otherwise(9.0).alias("y1")))
    pages_ = quality.page_table(b.filter("page_number = 1")).withColumn("width", F.lit(100.0)).withColumn("height", F.lit(100.0))
    twice = b.unionByName(b.filter("reading_order = 0").withColumn("block_pos", F.lit(0.5)).withColumn("bbox", F.lit(None).cast(boxes.BOX)))
    return quality.validate_blocks(twice, pages_).groupBy("code").agg(F.count("*").alias("n"))


@query(_PACKED + """, w AS (SELECT *, len(regexp_extract_all(text, '[a-zA-Z0-9]+(?:[-''][a-zA-Z0-9]+)*')) * 13 // 10 > 60 AS over FROM texts), m AS (SELECT document_id, count(*) FILTER (over) AS over FROM w GROUP BY 1), c AS (SELECT document_id, count(*) AS blocks, count(DISTINCT heading) AS heads FROM blocks GROUP BY 1)
SELECT document_id, CAST(blocks AS BIGINT) AS block_count, CAST(heads AS BIGINT) AS section_count, CASE WHEN over = 0 THEN 'ok' ELSE 'warning' END AS tokens FROM c JOIN m USING (document_id)""")
def health(spark: SparkSession, sf: str) -> DataFrame:
    """What the monitor says of packages before any pass: counts, and whether children keep to the budget."""
    config = ChunkConfig(template="generic_structured", child_max_tokens=60)
    blocks = sections.heading_paths(text_blocks(_decorated(spark, sf, _book_line)))
    blocks = chunking.kept_table(blocks)
    parents, children = (chunking.kept_table(x) for x in templates.chunk(blocks, "generic_structured", config))
    found = quality.metrics(parents, children, config, blocks).join(quality.block_counts(blocks), "document_id").join(sections.section_table(blocks).groupBy("document_id").agg(F.count("*").alias("section_count")), "document_id")
    checks = quality.health_checks(found.withColumn("parser_used", F.lit("text_file"))).filter("name = 'tokens'").select("document_id", F.col("status").alias("tokens"))
    return found.select("document_id", "block_count", "section_count").join(checks, "document_id")


@query()
def flat_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Children as flat chunks, after all passes over these."""
    children = templates.chunk(text_blocks(_decorated(spark, sf, _law_line)), "laws", ChunkConfig(child_max_tokens=60))[1]
    return flat.flat_chunks(flat.from_children(children, "pdf"), 120, 50).select("document_id", "chunk_index", "chunk_id", "page_number", "section", "text")


@query()
def page_text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as page texts, hard-wrapped: headers removed, lines put together."""
    wrapped = F.regexp_replace("text", r"(\\S+ \\S+ \\S+) ", "$1\n")
    return pages.page_blocks(_pages(spark, sf).select("document_id", "page_number", wrapped.alias("text"))).select("document_id", "page_number", "reading_order", "block_type", "text")


@query()
def overlong_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Children over the budget, cut."""
    config = ChunkConfig(child_max_tokens=50)
    children = templates.chunk(text_blocks(_docs(spark, sf)), "generic_structured", config)[1]
    return post.split_overlong(children, config).select("document_id", "original_chunk_id", "part_index", "part_count", "token_count", "text")


@query()
def package_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Whole packages, without ids."""
    package = chunking.chunk_package(text_blocks(_decorated(spark, sf, _manual_line))).materialize()
    return output.snapshot(package).select("document_id", F.to_json("snapshot").alias("snapshot"))


_OFFSETS_SQL = r"""p AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn + 1 AS INTEGER) AS page_number, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS body FROM conversations),
g AS (SELECT *, CASE WHEN body <> '' AND last_value(CASE WHEN body <> '' THEN regexp_matches(body, '[。！？；.!?;）)」』"]$') END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 2 ELSE 0 END AS gap FROM p),
e AS (SELECT *, sum(gap + length(body)) OVER (PARTITION BY document_id ORDER BY page_number) AS stop FROM g)"""


@query(f"WITH {_OFFSETS_SQL} SELECT document_id, sha256(string_agg(repeat(chr(10), gap) || body, '' ORDER BY page_number)) AS digest FROM g GROUP BY 1")
def joined_pages(spark: SparkSession, sf: str) -> DataFrame:
    return legacy.joined_pages(_pages(spark, sf)).select("document_id", F.sha2("text", 256).alias("digest"))


@query(f"""WITH {_OFFSETS_SQL}, d AS (SELECT document_id, max(stop) AS size, max(page_number) AS last FROM e GROUP BY 1), x AS (SELECT document_id, last, unnest(range(0, CAST(size AS BIGINT) + 60, 30)) AS at FROM d)
SELECT x.document_id, x.at, coalesce(min(e.page_number), any_value(x.last)) AS page_number FROM x LEFT JOIN e ON e.document_id = x.document_id AND x.at >= e.stop - length(e.body) AND x.at < e.stop GROUP BY x.document_id, x.at""")
def page_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The page of every thirtieth character, and of some beyond the end."""
    offsets = legacy.page_offsets(_pages(spark, sf))
    points = offsets.groupBy("document_id").agg(F.max("end").alias("size")).select("document_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") + 59) / 30) * 30, F.lit(30).cast("long"))).alias("at"))
    return legacy.page_of(points, offsets).select("document_id", "at", "page_number")


@query()
def paged_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as pages, their paragraphs packed."""
    return legacy.paged_chunks(_pages(spark, sf), 100)


@query("""WITH n AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn, count(*) OVER (PARTITION BY conv_id) AS pages FROM conversations), b AS (SELECT document_id, turn + 1 AS page, pages, unnest([0, 2, 3]) AS i FROM n),
k AS (SELECT document_id, page, i, CASE i WHEN 0 THEN 'Report CONFIDENTIAL' WHEN 2 THEN 'See you on page ' || page || ' ....... 7' ELSE CAST(page AS VARCHAR) END AS text FROM b WHERE i > 0 OR pages >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, i) AS rn FROM k)
SELECT document_id, count(*) AS removed, string_agg(text, ',' ORDER BY rn) FILTER (rn <= 5) AS examples FROM r GROUP BY 1""")
def noise_examples(spark: SparkSession, sf: str) -> DataFrame:
    return noise.removed(noise.mark_noise(_page_blocks(spark, sf))).select("document_id", "removed", F.array_join("examples", ",").alias("examples"))


@query("""WITH l AS (SELECT doc_id, unnest(range(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))) AS i FROM documents), r AS (SELECT doc_id, count(*) FILTER (i % 3 <> 1) / count(*) AS ratio FROM l GROUP BY 1)
SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 2 = 0 THEN 'table_data' ELSE 'picture_pdf' END AS document_type, CAST(floor(least(0.95, ratio) * 1000) AS INTEGER) AS permille FROM r""")
def types_by_share(spark: SparkSession, sf: str) -> DataFrame:
    """Documents most of whose blocks are tables, or figures."""
    kind = F.when(F.col("document_id").cast("long") % 2 == 0, "table").otherwise("figure")
    blocks = text_blocks(_docs(spark, sf)).withColumn("block_type", F.when(F.col("reading_order") % 3 != 1, kind).otherwise("paragraph"))
    return doctype.detect(blocks).select("document_id", "document_type", F.floor(F.col("confidence") * 1000).cast("int").alias("permille"))


_HEADING_DOMAINS = " ".join(f"WHEN {' OR '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in t.HEADING_DOMAINS)


@query(f"""WITH d AS (SELECT doc_id, lower(CASE doc_id % 4 WHEN 0 THEN 'Removal' WHEN 1 THEN 'Wiring plan' WHEN 2 THEN '免责' ELSE '' END || ' Part ' || left(text, 1200)) AS low FROM documents) SELECT doc_id, CASE {_HEADING_DOMAINS} END AS domain FROM d""")
def heading_domain(spark: SparkSession, sf: str) -> DataFrame:
    first = F.create_map(*[F.lit(x) for pair in {0: "Removal", 1: "Wiring plan", 2: "免责", 3: ""}.items() for x in pair])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", t.heading_domain(F.array(first[(F.col("doc_id") % 4).cast("int")], F.lit("Part")), F.col("text")).alias("domain"))


@query(_PACKED + """ SELECT left(sha256('parent:' || document_id || ':' || left(sha256('section:' || document_id || ':' || heading), 32)), 32) AS parent_id, count(*) AS children FROM children GROUP BY document_id, heading""")
def parent_edges(spark: SparkSession, sf: str) -> DataFrame:
    """How many children each parent lists."""
    parents, children = templates.chunk(text_blocks(_decorated(spark, sf, _book_line)), "generic_structured", ChunkConfig(child_max_tokens=60))
    return output.edges(chunking.with_children(parents, children)).groupBy("parent_id").agg(F.count("*").alias("children"))
