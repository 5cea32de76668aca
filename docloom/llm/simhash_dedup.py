"""Near-duplicate groups by SimHash and a self-join of the binary trie of fingerprints.

Fingerprint: every shingle (``shingle`` words of the text with A-Z in lower case, repeats included) votes with the 64 bits of its
XXH64 (seed 42); a bit is 1 if more than half of the votes have it.

Self-join: the distinct fingerprints, sorted, are a binary trie whose nodes are ranges.  Pairs of nodes go down together, level by
level; each pair carries how many bits have differed so far and is dropped once that exceeds ``radius``.  To share
the work, the trie is dealt out by fixed bits: two fingerprints within ``radius`` agree in at least one of radius + 1 blocks of bits,
so each fingerprint goes once for each block to the bucket of the block's value, and a task joins the trie of its bucket's
fingerprints with itself.  A task answers with links to the smallest member of what hangs together there, at most one for
each fingerprint and block, never with all pairs; within ``radius`` of a fingerprint there are at most 43,744 others (radius
3), however many documents.

Equal fingerprints are one node, so copies cost nothing.  Groups are connected components of the links.

Defined cases: null or blank text has fingerprint 0 and is linked like any other; fewer words than a shingle: the words are one
shingle; rows with a repeated or null doc_id are documents of their own, and of a component of null ids the id is null; ties: the
smallest doc_key stands for a group; an empty table gives no rows; a very long text is hashed whole, some shingles at a time; other columns are
ignored (``keep_one`` returns them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm import common as c
from docloom.llm.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints, of each block, that a task of the self-join has on average.
ROWS = 1 << 18
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _fingerprint_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch["text"].cast(pa.large_binary()).to_pylist()):
                words = text.translate(_LOWER).split()
                if not words:
                    continue
                line = b" ".join(words)
                size = np.fromiter(map(len, words), np.int64, len(words)) + 1
                ends = np.cumsum(size) - 1
                n = min(shingle, len(words))
                stops = ends[n - 1 :].tolist()
                starts = (ends - size + 1)[: len(stops)].tolist()
                ones = np.zeros(64, np.int64)
                for at in range(0, len(stops), 1 << 16):
                    h = np.array([digest(line[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], "<u8")
                    ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                out[i] = np.packbits(2 * ones > len(stops), bitorder="little").view("<u8")[0]
            yield pa.RecordBatch.from_arrays([batch["doc_key"], pa.array(out.view(np.int64))], ["doc_key", "fingerprint"])

    return run


def _nodes(sorted_keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """For ranges of equal higher bits: where those with a 1 at ``bit`` begin."""
    prefix = sorted_keys[lo] >> np.uint64(bit + 1) << np.uint64(bit + 1) | np.uint64(1) << np.uint64(bit)
    return np.clip(np.searchsorted(sorted_keys, prefix), lo, hi)


def trie_links(keys: np.ndarray, radius: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) index pairs, i < j, of sorted distinct uint64 keys that differ in at most ``radius`` bits, some at a time."""
    if len(keys) < 2:
        return
    # (bit to look at next, lo, hi of node a, lo, hi of node b, bits that differ); a == b: a node with itself
    one = np.zeros(1, np.int64)
    todo = [(63, one, one + len(keys), one, one + len(keys), one)]
    while todo:
        bit, alo, ahi, blo, bhi, d = todo.pop()
        if bit < 0:
            yield alo, blo
            continue
        if len(alo) > most:  # depth first beyond this many pairs, so memory is bounded
            half = len(alo) // 2
            todo += [(bit, *(x[half:] for x in (alo, ahi, blo, bhi, d))), (bit, *(x[:half] for x in (alo, ahi, blo, bhi, d)))]
            continue
        amid, bmid = _nodes(keys, alo, ahi, bit), _nodes(keys, blo, bhi, bit)
        same = alo == blo
        parts = []
        for x0, x1, y0, y1, cost, only in ((alo, amid, blo, bmid, 0, None), (amid, ahi, bmid, bhi, 0, None), (alo, amid, bmid, bhi, 1, None), (amid, ahi, blo, bmid, 1, ~same)):
            ok = (x0 < x1) & (y0 < y1) & (d + cost <= radius) & ((x0 != y0) | (x1 - x0 > 1))
            if only is not None:
                ok &= only
            parts.append([x[ok] for x in (x0, x1, y0, y1, d + cost)])
        merged = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(merged[0]):
            todo.append((bit - 1, *merged))


def _flatten(root: np.ndarray) -> np.ndarray:
    while True:
        nxt = root[root]
        if (nxt == root).all():
            return root
        root = nxt


def _join_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [pa.Table.from_batches([b]) for b in batches]
        if not rows:
            return
        table = pa.concat_tables(rows)
        block, key, node = (table[n].to_numpy() for n in ("block", "fingerprint", "node"))
        for k in np.unique(block):
            pick = np.flatnonzero(block == k)
            keys = key[pick].view(np.uint64) if key.flags["C_CONTIGUOUS"] else np.ascontiguousarray(key[pick]).view(np.uint64)
            order = np.argsort(keys)
            keys, nodes = keys[order], node[pick][order]
            lo, hi = c_block(k, radius)
            # the block's bits go first, so equal ones are one node and others are never met
            turned = np.sort(_turn(keys, hi % 64))
            back = np.argsort(_turn(keys, hi % 64))
            root = np.arange(len(keys))
            for i, j in trie_links(turned, radius):
                while len(i):  # hook larger roots onto smaller ones until both ends of every link agree
                    a, b = root[i], root[j]
                    far = a != b
                    i, j, a, b = i[far], j[far], a[far], b[far]
                    np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                    root = _flatten(root)
            nodes = nodes[back]
            small = np.full(len(keys), np.iinfo(np.int64).max)
            np.minimum.at(small, root, nodes)
            other = small[root]
            linked = nodes != other
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(other[linked])], ["a", "b"])

    return run


def c_block(k: int, radius: int) -> tuple[int, int]:
    """Lowest and highest-plus-one bit of block k."""
    n = radius + 1
    return 64 * int(k) // n, 64 * (int(k) + 1) // n


def _turn(keys: np.ndarray, by: int) -> np.ndarray:
    return keys if not by else keys >> np.uint64(by) | keys << np.uint64(64 - by)


def fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_key, fingerprint long) of identified rows."""
    return rows.select("doc_key", "text").mapInArrow(c.lean(_fingerprint_rows(shingle)), "doc_key long, fingerprint long")


def near_groups(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_key, fingerprint, component): marked(doc_key, fingerprint) with the smallest doc_key of what it is linked to."""
    nodes = marked.groupBy("fingerprint").agg(F.min("doc_key").alias("node"))
    blocks = [
        F.struct(F.lit(k).alias("block"), F.col("fingerprint").bitwiseAND(F.lit((((1 << (hi - lo)) - 1) << lo) - (1 << 64 if hi == 64 else 0))).alias("value"))
        for k in range(radius + 1)
        for lo, hi in [c_block(k, radius)]
    ]
    dealt = nodes.select("fingerprint", "node", F.explode(F.array(*blocks)).alias("x")).select("fingerprint", "node", "x.block", "x.value")
    n = max(int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-marked.count() // ROWS))
    links = dealt.repartition(n, "block", "value").select("block", "fingerprint", "node").mapInArrow(c.lean(_join_links(radius)), "a long, b long")
    found = components(links)
    named = nodes.join(found, nodes["node"] == found["node"], "left").select(F.col("fingerprint").alias("f"), F.coalesce("component", nodes["node"]).alias("component"))
    return marked.join(named, marked["fingerprint"] == named["f"]).select("doc_key", "fingerprint", "component")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text)."""
    rows, numbered = c.identified(docs)
    found = near_groups(c.checkpointed(fingerprints(rows, shingle)), radius)
    if numbered:
        names = rows.select("doc_key", "doc_id")
        found = found.join(names, "doc_key").join(names.select(F.col("doc_key").alias("component"), F.col("doc_id").alias("component_id")), "component")
    else:
        found = found.select(F.col("doc_key").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stand for their group (smallest doc_key), with their columns.

    Null and blank texts are one group with fingerprint 0; columns may have any names; rows with a repeated or null doc_id are documents of
    their own; an empty table stays empty.
    """
    rows = c.documents(docs, c.whole_row(docs))
    found = near_groups(c.checkpointed(fingerprints(rows, shingle)), radius)
    firsts = found.filter("doc_key = component").select("doc_key")
    return c.unpacked(rows.join(firsts, "doc_key", "left_semi"), docs.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of the whole documents table."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute(rows: list[tuple[int, str | None]], shingle: int = SHINGLE, radius: int = RADIUS) -> list[tuple]:
    """What op7 must return, from all pairs of fingerprints (for tests)."""
    prints = {}
    for d, text in rows:
        words = (text or "").encode().translate(_LOWER).split()
        votes = [0] * 64
        grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        for g in grams:
            h = xxhash.xxh64_intdigest(g, SEED)
            for b in range(64):
                votes[b] += h >> b & 1
        prints[d] = sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))
    root = {d: d for d in prints}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, f"{prints[d]:016x}", find(d)) for d in ids]
