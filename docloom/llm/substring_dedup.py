"""Substring dedup by fixed-block anchors.

Every document is a sequence of words.  A repeat is a run of at least ``window`` words that also occurs in a document
that comes earlier (by doc_key); every word of a repeat goes.

* Index: the non-overlapping blocks of ``block = (window + 1) // 2`` words at places 0, block, 2 * block ...  Any
  ``window`` words contain one whole block, so a repeat always holds an indexed block of its earlier copy.
* Probe: every rolling window of ``block`` words of every document meets the index in the bucket of its hash.  A probe is
  a hit if an earlier document has that block; only the smallest key of a block's holders is needed to tell, so no pairs
  are made, however many documents share a block.
* Extend: around hits (and the blocks that they hit) all full windows are named by 128 bits and meet again; a window
  whose name an earlier document also has is a repeat, and the union of such windows is the set of maximal exact repeats.

A probe's 32 bits (plus its bucket) only choose candidates; the full window's name decides.

Hot passages.  What a map task has gathered is settled there as far as it goes.  Probes: a block that several documents of the
flush have makes all of them candidates, and only its first indexed holder and its last holder go to the bucket.  Windows:
all but the smallest document's are repeats already, and only that document's go on.  So a passage of a third of all documents
sends a few facts for each flush.

Defined cases: null or blank text has no words and keeps the empty string; fewer than ``window`` words: nothing goes;
rows with a repeated or null doc_id count as documents of their own, in order of doc_id (nulls last) and text; an empty
table gives no rows; a very long text is handled alone in its piece and its facts are sent like others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm import common as c

WINDOW = 13


_WORD32 = np.uint64(0xFFFFFFFF)


def _blocks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, place, hash) of all rolling windows of a block's length."""
    block = (window + 1) // 2
    for batch in batches:
        for a, b in c.pieces(batch["text"]):
            part = batch.slice(a, b - a)
            data, offsets = c.text_bytes(part["text"])
            starts, ends, counts = c.word_spans(data, offsets)
            h = c.grams(c.word_hashes(data, starts, ends), block, 1)
            doc = np.repeat(np.arange(len(counts)), counts)[: len(h)]
            place = np.arange(len(h)) - (np.cumsum(counts) - counts)[doc]
            ok = (place + block <= counts[doc]) & (counts[doc] >= window)
            yield part["doc_key"].to_numpy()[doc[ok]], place[ok], h[ok]


def _probes(window: int, n: int, slots: np.ndarray):
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, places, h in c.gathered(_blocks(batches, window)):
            order, new = c.groups(h & _WORD32)  # keys ascend in each group
            ends = np.r_[new[1:], len(order)]
            first, last = order[new], order[ends - 1]
            several = keys[first] != keys[last]
            where = np.where(places[order] % block == 0, np.arange(len(order)), len(order))
            index = np.minimum.reduceat(where, new)
            known = np.zeros(len(keys), bool)
            known[order[np.repeat(several, ends - new)]] = True
            asked = ~known
            asked[last[several]] = True
            asked[order[index[several & (index < ends)]]] = True
            yield from c.send(c.bucket_of(h[asked], n), n, slots, keys[asked], places[asked], h[asked] & _WORD32)
            yield from c.send(c.by_key(keys[known], n), n, slots, keys[known], places[known])

    return run


def _hits(window: int, n: int, slots: np.ndarray):
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, places, (h,)), (known_keys, known_places, _) = c.receive(batches, 1, 0)
        if len(keys):
            order, new = c.groups(h)
            sizes = np.diff(np.r_[new, len(h)])
            keys, places = keys[order], places[order]
            indexed = places % block == 0
            first = np.minimum.reduceat(np.where(indexed, keys, np.iinfo(np.int64).max), new)
            hit = keys > np.repeat(first, sizes)
            met = np.repeat(np.logical_or.reduceat(hit, new), sizes)
            kept = hit | (indexed & met)
            keys, places = keys[kept], places[kept]
        yield from c.give_back(n, slots, np.r_[keys, known_keys], np.r_[places, known_places])

    return run


def _candidates(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, place, two hashes) of the full windows around hits."""
    block = (window + 1) // 2
    for batch in batches:
        for a, b in c.pieces(batch["text"]):
            part = batch.slice(a, b - a)
            data, offsets = c.text_bytes(part["text"])
            starts, ends, counts = c.word_spans(data, offsets)
            words = c.word_hashes(data, starts, ends)
            near = np.zeros(len(starts) + 1, np.int64)
            first_word = np.cumsum(counts) - counts
            for i, found in enumerate(part["places"].to_pylist()):
                at = c.places_of(found)
                np.add.at(near, first_word[i] + np.maximum(at + block - window, 0), 1)
                np.add.at(near, first_word[i] + np.maximum(np.minimum(at, counts[i] - window), -1) + 1, -1)
            doc = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(doc)) - first_word[doc]
            pick = np.flatnonzero((np.cumsum(near)[: len(doc)] > 0) & (place + window <= counts[doc]))
            yield part["doc_key"].to_numpy()[doc[pick]], place[pick], c.grams(words, window, 2)[pick], c.grams(words, window, 4)[pick]


def _windows(window: int, n: int, slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, places, h, g in c.gathered(_candidates(batches, window)):
            order, new = c.classes(h, g)  # keys ascend in each class
            again = np.zeros(len(keys), bool)
            again[order] = keys[order] > np.repeat(keys[order[new]], np.diff(np.r_[new, len(order)]))
            asked = ~again
            yield from c.send(c.bucket_of(h[asked], n), n, slots, keys[asked], places[asked], h[asked], g[asked])
            yield from c.send(c.by_key(keys[again], n), n, slots, keys[again], places[again])

    return run


def _repeats(n: int, slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, places, names), (known_keys, known_places, _) = c.receive(batches, 2, 0)
        if len(keys):
            order, new = c.classes(*names)
            keys, places = keys[order], places[order]
            again = keys > np.repeat(np.minimum.reduceat(keys, new), np.diff(np.r_[new, len(keys)]))
            keys, places = keys[again], places[again]
        yield from c.give_back(n, slots, np.r_[keys, known_keys], np.r_[places, known_places])

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept_text = [], [], []
            for text, found in zip(batch["text"].to_pylist(), batch["places"].to_pylist(), strict=True):
                words = text.encode("utf-8", "replace").split()
                total.append(len(words))
                if found:
                    cover = np.zeros(len(words) + 1, np.int64)
                    at = c.places_of(found)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                    keep = np.cumsum(cover)[:-1] == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                gone.append(total[-1] - len(words))
                kept_text.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept_text, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row of docs(doc_id, text): see the module's docstring."""
    rows = c.documents(docs)
    n = c.buckets(rows)
    slots = c.even_keys(n)
    facts = rows.mapInArrow(c.lean(_probes(window, n, slots)), c.FACTS)
    hits = c.by_document(c.in_buckets(facts, n, _hits(window, n, slots), c.FACTS), n)
    texts = rows.select("doc_key", "doc_id", "text")
    facts = texts.join(hits, "doc_key", "left").filter("places is not null").mapInArrow(c.lean(_windows(window, n, slots)), c.FACTS)
    repeats = c.by_document(c.in_buckets(facts, n, _repeats(n, slots), c.FACTS), n)
    return texts.join(repeats, "doc_key", "left").mapInArrow(c.lean(_remove(window)), "doc_id long, n_words long, n_removed long, kept_text string")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of dedup_substrings over the whole documents table."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
k AS (SELECT i.doc_id, i.i, array_to_string(w[i.i : i.i + 12], ' ') AS k FROM i JOIN d ON d.doc_id = i.doc_id),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM k JOIN f USING (k) WHERE doc_id > first),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def brute(rows: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """What op1 must return, from all windows in plain Python (for tests)."""
    first: dict[tuple, int] = {}
    texts = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(texts):
        w = texts[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = []
    for d, w in texts.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)
