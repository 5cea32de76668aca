"""Which template suits a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.config import TEMPLATES

# Words that tell a document's type, in order of precedence.
KEYWORDS = {
    "contract_terms": ["保险", "合同", "责任免除", "释义", "条款", "policy", "insured", "premium", "exclusion"],
    "paper": ["abstract", "references", "introduction", "methodology", "doi", "keywords"],
    "book": ["chapter ", "contents", "table of contents", "preface", "appendix", "目录"],
    "laws": ["中华人民共和国", "第一条", "第二条", "条例", "办法", "regulation", "article 1", "article 2"],
    "manual": ["troubleshooting", "maintenance", "installation", "warning", "caution", "procedure"],
    "qa": ["question:", "answer:", "q:", "a:", "faq", "问：", "答："],
}
SAMPLE_CHARS = 12_000


def samples(blocks: DataFrame) -> DataFrame:
    """(document_id, sample, table_ratio, figure_ratio): the first blocks' texts until 12,000 characters are there."""
    order = Window.partitionBy("document_id").orderBy("page_number", "reading_order")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = blocks.withColumn("before", before)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("before") < SAMPLE_CHARS, F.struct("page_number", "reading_order", "text")))), lambda x: x["text"]), "\n")
    ratio = lambda kind: F.avg(F.when(F.col("block_type") == kind, 1.0).otherwise(0.0))
    declared = [F.first("declared_type", True).alias("declared_type")] if "declared_type" in blocks.columns else []
    return part.groupBy("document_id").agg(text.alias("sample"), ratio("table").alias("table_ratio"), ratio("figure").alias("figure_ratio"), *declared)


#: Every keyword has a bit.
_BITS = {(name, word): 1 << i for i, (name, word) in enumerate((name, word) for name, words in KEYWORDS.items() for word in words)}


def _marks(blocks: DataFrame) -> DataFrame:
    """Blocks with the bits of the keywords that they have, if they are in the sample.  No keyword has a line end, so none spans two blocks."""
    order = Window.partitionBy("document_id").orderBy("page_number", "reading_order")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low = F.col("_low")  # a column of its own: in lower case once, not for each keyword
    bits = F.lit(0).cast("long")
    for (_, word), bit in _BITS.items():
        bits = bits.bitwiseOR(F.when(low.contains(word), F.lit(bit)).otherwise(F.lit(0)).cast("long"))
    early = blocks.withColumn("_before", before).withColumn("_low", F.when(F.col("_before") < SAMPLE_CHARS, F.lower("text")))
    return early.withColumn("_bits", F.when(F.col("_before") < SAMPLE_CHARS, bits).otherwise(F.lit(0).cast("long"))).drop("_before", "_low")


def _measures(blocks: DataFrame) -> dict[str, Column]:
    ratio = lambda kind: F.avg(F.when(F.col("block_type") == kind, 1.0).otherwise(0.0))
    found = {"_mask": F.bit_or("_bits"), "table_ratio": ratio("table"), "figure_ratio": ratio("figure")}
    return found | ({"_declared": F.max("declared_type")} if "declared_type" in blocks.columns else {})


def _decided(found: DataFrame, requested: str) -> dict[str, Column]:
    if requested != "auto":
        kind, sure, why = (requested, 1.0, "requested") if requested in TEMPLATES else ("generic_structured", 0.2, "unsupported_request")
        return {"document_type": F.lit(kind), "confidence": F.lit(sure), "signals": F.array(F.lit(f"{why}={requested}")), "requested": F.lit(requested)}
    hits = {name: F.array_compact(F.array(*[F.when(F.col("_mask").bitwiseAND(_BITS[name, word]) != 0, F.lit(word)) for word in words])) for name, words in KEYWORDS.items()}
    share = lambda kind: F.concat(F.lit(f"{kind}_ratio="), F.format_string("%.2f", f"{kind}_ratio"))
    rules = [(F.col("_declared").isin(*TEMPLATES), F.col("_declared"), F.lit(0.95), F.array(F.lit("document.document_type")))] if "_declared" in found.columns else []
    rules += [(F.col(f"{kind}_ratio") > 0.35, F.lit(name), F.least(F.lit(0.95), f"{kind}_ratio"), F.array(share(kind))) for kind, name in (("table", "table_data"), ("figure", "picture_pdf"))]
    rules += [(F.size(x) > 0, F.lit(name), F.least(F.lit(0.9), F.lit(0.55) + F.lit(0.1) * F.size(x)), x) for name, x in hits.items()]
    choose = lambda i, rest: F.coalesce(*[F.when(rule[0], rule[i]) for rule in rules], rest)
    return {"document_type": choose(1, F.lit("generic_structured")), "confidence": choose(2, F.lit(0.3)), "signals": choose(3, F.array(F.lit("fallback"))), "requested": F.lit(requested)}


def detect(blocks: DataFrame, requested: str = "auto") -> DataFrame:
    """(document_id, document_type, confidence, signals, requested).

    A type that is asked for wins (one that doesn't exist gives the generic one), then one that the parser declared, then the share of
    tables or figures, then words in the first blocks.
    """
    found = _marks(blocks).groupBy("document_id").agg(*[x.alias(n) for n, x in _measures(blocks).items()])
    return found.select("document_id", *[x.alias(n) for n, x in _decided(found, requested).items()])


def typed(blocks: DataFrame, requested: str = "auto") -> DataFrame:
    """blocks with the document_type that detect() gives; over the same partitions as the blocks, without a join."""
    found = _marks(blocks).withColumns({n: x.over(Window.partitionBy("document_id")) for n, x in _measures(blocks).items()})
    return found.withColumn("document_type", _decided(found, requested)["document_type"]).select(*blocks.columns, "document_type")
