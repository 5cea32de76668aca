"""SimHash document fingerprints, and search by permuted block tables.  DataFrame operations only.

Fingerprint.  Terms are pairs of following words (and the last word alone); each term's 64-bit hash votes on 64 signed bits with
the term's count as its weight, and a bit is 1 if its votes are positive.  The votes are ordinary sums: two 32-bit counters share
one long, so 32 sums make 64 counts in a hash aggregate; no array is built for a word.

Search.  The bits are cut into radius + 3 blocks.  Two fingerprints within ``radius`` agree in at least three whole blocks, so for
each choice of three blocks there is a table with these blocks in front as the key; equal keys meet, and a pair is taken in
the first table whose key it shares, once, if its bits differ in at most ``radius`` places.  Distinct fingerprints are
searched, so copies don't multiply, and keys of 32 of 64 bits (at radius 3) stay selective.

Edited texts need each document's successor.  Documents go to groups of about GROUP following keys: quantiles of the keys cut them into
ranges of about RANGE documents, and each range is cut evenly, so an outlier among the keys makes the groups of its own range
larger at most.  The successor is the next row in the group, and a group's last document gets the next group's head by a join on
the group, whose rows are already together, so texts are shuffled once.

Defined cases: null text is empty; a text without words has fingerprint 0 and its edited text is what the rule gives; one document is
its own successor; rows with a repeated or null doc_id are documents of their own in order of doc_id (nulls last) and text; an
empty table gives no rows; a very long text is one row like others, its votes are sums; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docloom.llm import common as c

RADIUS = 3
#: Documents in a group of followers, about; documents of a range of keys, and ranges at most (their bounds are literals of the plan).
GROUP, RANGE, MOST_RANGES = 64, 4096, 20_000
_PAIR = 0x0000000100000001


def terms(text: Column) -> Column:
    """Hashes of a text's terms, repeats included."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def _votes(h: Column) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_PAIR))).alias(f"v{j}") for j in range(32)]


def _fingerprint(n: Column) -> Column:
    """From the columns of _votes() and the number of terms."""
    bits = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"v{j}"), 32)
        for count, bit in ((low, j), (high, j + 32)):
            bits = bits.bitwiseOR(F.when(2 * count > n, F.lit((1 << bit) - (1 << 64 if bit == 63 else 0))).otherwise(F.lit(0).cast("long")))
    return bits


def fingerprint_of(exploded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fingerprint) of exploded(keys, h), where h is a term's hash or null."""
    return exploded.groupBy(*keys).agg(F.count("h").alias("n_terms"), *_votes(F.col("h"))).select(*keys, F.coalesce(_fingerprint(F.col("n_terms")), F.lit(0).cast("long")).alias("fingerprint"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_key, doc_id, fingerprint) of docs(doc_id, text)."""
    rows = c.documents(docs)
    return fingerprint_of(rows.select("doc_key", "doc_id", F.explode_outer(terms(F.col("text"))).alias("h")), ["doc_key", "doc_id"])


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def within(queries: DataFrame, found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, fingerprint): distinct fingerprints of ``found`` within ``radius`` bits of each distinct one of ``queries``."""
    n = radius + 3
    bounds = [64 * k // n for k in range(n + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(bounds, bounds[1:], strict=False)]
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    tables = [sum(masks[k] for k in chosen) for chosen in combinations(range(n), n - radius)]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        own = df.select(F.col("fingerprint").alias(name)).distinct()
        return own.select(name, F.posexplode(F.array(*[F.col(name).bitwiseAND(signed(m)) for m in tables])).alias(f"{name}_table", f"{name}_key"))

    # both sides grow with the input, and Spark's estimate of the keyed queries misses that each is there once for each table
    q, t = keyed(queries, "query"), keyed(found, "fingerprint").hint("merge")
    differ = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(signed(m)) == 0, F.lit(i)) for i, m in enumerate(tables)])
    joined = q.join(t, (q["query_table"] == t["fingerprint_table"]) & (q["query_key"] == t["fingerprint_key"]) & (F.bit_count(differ) <= radius) & (first == q["query_table"]))
    return joined.select("query", "fingerprint")


#: Groups of a range are numbered from its number times this.
_WIDE = 1 << 24


def _groups(keys: DataFrame) -> Column:
    """Number of a doc_key's group; numbers rise with keys."""
    n = keys.count()
    if not n:
        return F.lit(0).cast("long")
    ranges = min(MOST_RANGES, -(-n // RANGE))
    cuts = keys.agg(F.percentile_approx("doc_key", [i / ranges for i in range(ranges + 1)], max(10_000, 10 * ranges))).first()[0]
    bounds = sorted(set(cuts))
    if len(bounds) == 1:
        bounds.append(bounds[0] + 1)
    at = c.last_not_above(bounds[:-1], F.col("doc_key"))
    table, widths = (F.expr(f"array({', '.join(f'{x}L' for x in xs)})") for xs in (bounds[:-1], [max(1, (b - a) * GROUP // RANGE) for a, b in zip(bounds, bounds[1:], strict=False)]))
    inside = F.floor(F.greatest(F.lit(0), F.col("doc_key") - F.get(table, at)) / F.get(widths, at))
    return at.cast("long") * _WIDE + F.least(inside.cast("long"), F.lit(_WIDE - 1))


def _successors(groups: DataFrame) -> DataFrame:
    """(grp, next_grp) of groups(grp); of the last, the first.  Two levels, so one task orders few rows."""
    spread = groups.withColumn("span", F.floor(F.col("grp") / _WIDE))
    inner = spread.withColumn("after", F.lead("grp").over(Window.partitionBy("span").orderBy("grp")))
    heads = spread.groupBy("span").agg(F.min("grp").alias("head"))
    order = Window.orderBy("span")
    heads = heads.select("span", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("next_head"))
    return inner.join(heads, "span").select("grp", F.coalesce("after", "next_head").alias("next_grp"))


def edits(rows: DataFrame) -> DataFrame:
    """(grp, doc_key, doc_id, n_chars, text, edited, head) of identified rows; head: the successor's text, where it is in another group."""
    marked = rows.select("doc_key", "doc_id", "text", _groups(rows.select("doc_key")).alias("grp"))
    base = marked.repartition(c.buckets(rows), "grp")
    # all columns of base, so that this reads the exchange that the window reads
    heads = base.groupBy("grp").agg(F.min_by(F.struct("text", "doc_id"), "doc_key").alias("first")).select("grp", F.col("first.text").alias("head"))
    after = _successors(marked.select("grp").distinct())
    nexts = after.join(heads.withColumnRenamed("grp", "head_grp"), F.col("next_grp") == F.col("head_grp")).select(F.col("grp").alias("of"), "head")
    led = base.withColumn("lead", F.lead("text").over(Window.partitionBy("grp").orderBy("doc_key")))
    joined = led.join(nexts.hint("merge"), led["grp"] == nexts["of"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("lead", "head"), F.lit(1), half))
    return joined.select("grp", "doc_key", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"), F.when(F.col("lead").isNull(), F.col("head")).alias("head"))


def compare(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of texts and edited texts, their likeness, and how many others' fingerprints are near.

    n_near: for documents whose id is divisible by 20, the number of distinct other fingerprints of the table within ``radius``
    bits; null for the rest.
    """
    rows = c.documents(docs)
    keys = ["grp", "doc_key", "doc_id", "n_chars", "edited_sha256"]
    each = edits(rows).select(*keys[:-1], F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited", "head")).alias("which", "part")).filter("part is not null")
    marked = fingerprint_of(each.select(*keys, "which", F.explode_outer(terms(F.col("part"))).alias("h")), [*keys, "which"])
    pick = lambda i: F.max(F.when(F.col("which") == i, F.col("fingerprint")))
    three = marked.groupBy(*keys).agg(pick(0).alias("own"), pick(1).alias("edited"), pick(2).alias("head"))
    after = F.coalesce("head", F.lead("own").over(Window.partitionBy("grp").orderBy("doc_key")))
    full = c.checkpointed(three.withColumn("after", after).drop("grp"))
    queries = full.filter("doc_id % 20 = 0").select(F.col("own").alias("fingerprint"))
    near = within(queries, full.select(F.col("own").alias("fingerprint")), radius).filter("query <> fingerprint").groupBy("query").agg(F.count("*").alias("n"))
    joined = full.join(near, full["own"] == near["query"], "left")
    text = lambda col: F.lower(F.lpad(F.hex(col), 16, "0"))
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("edited").alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"), F.when(F.col("doc_id") % 20 == 0, F.coalesce("n", F.lit(0).cast("long"))).alias("n_near"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint the whole documents table and its edited texts."""
    return compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_edits(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """(doc_id, n_chars, edited_sha256, edited) in plain Python (for tests)."""
    texts = sorted((d, t or "") for d, t in rows)
    out = []
    for i, (d, t) in enumerate(texts):
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[(i + 1) % len(texts)][1][:half]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), edited))
    return out
