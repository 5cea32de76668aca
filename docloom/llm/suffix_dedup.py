"""Exact repeated-substring removal in corpus order, by prefix-free parsing.

Texts are UTF-8 bytes.  Every byte covered by a ``span``-byte string that starts at two or more places of the corpus (the
same document included) goes.  A place is repeated if a neighbour in the order of all suffixes shares its first ``span`` bytes.

Order of suffixes (``corpus_order``).  Rolling-hash triggers cut texts into phrases that overlap by a trigger, so no phrase
suffix longer than a trigger is a prefix of another.  The dictionary (distinct phrases) gets a suffix array, the parse (texts
as phrase numbers) gets one, and a suffix of the texts is placed by the rank of its phrase's rest in the first and, where that is
equal, by the rank of the parse after it in the second.

The corpus in parts.  One array of a whole corpus has no place on any machine, so the parse is made twice, coarse and fine:

* Coarse parse, of everything.  The trigger of a ``span``-byte string is the smallest of the ``span // 2 + 1`` rolling hashes inside
  it (the last of equals).  It depends on the string's own bytes alone, so equal strings have equal triggers at equal
  distances, and there is always one.  Following places with one trigger form a phrase: the bytes from its first place to the
  end of its last place's string.  Phrases meet by trigger and are named by 128 bits.  Equal phrases settle all their places at
  once, which is nearly all of highly repetitive text; a trigger that nothing else has settles its phrase as unique.
* Fine parse, of what is left: phrases that share their trigger with others, at the edges of repeats.  Each map task puts what it
  holds of them into corpus order as above; equal neighbours (compared byte by byte) are repeated, and one place of each class goes on,
  named by 128 bits, to meet those of other tasks.  Naming merges the tasks' orders at the depth that the result needs.

Hot content.  A map task settles what it has gathered: equal phrases and equal strings are repeated, and one of each goes on; a trigger
with several phrases sends one mark.  So a passage that a third of all documents share, and a trigger in as many contexts,
send one fact for each flush.

Defined cases: null text is empty; a text under ``span`` bytes loses nothing; rows with a repeated or null doc_id are
documents of their own; an empty table gives no rows; other columns are ignored (``clean_texts`` returns them, whatever their names);
a very long text is hashed in parts.  What remains may cut a code point in two, so the kept text is binary.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from docloom.llm import common as c

SPAN = 200
#: Places that are hashed together; a longer text goes in parts that share their ends.
PART = 1 << 22
_PLACE_BITS = np.uint64(24)
_BASE = np.uint64(0xB5AD4ECEDA1CE2A9)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _rolling(data: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every n following bytes, by doubling."""
    done, out, have = None, c.BYTE_CODE[data], 1
    size, rest = 0, n
    while rest:
        if rest & 1:
            done = out.copy() if done is None else out[: len(data) - size - have + 1] * _power(size) + done[have : have + len(data) - size - have + 1]
            size += have
        rest >>= 1
        if rest:
            m = len(data) - 2 * have + 1
            out = out[:m] * _power(have) + out[have : have + m]
            have *= 2
    return done


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Smallest of every n following values."""
    have = 1
    while 2 * have <= n:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (n - have)], h[n - have :]) if n > have else h


def _names128(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two numbers for each stretch of bytes."""
    blob, digest = data.tobytes(), xxhash.xxh128_digest
    return np.frombuffer(b"".join([digest(blob[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), "<u8").reshape(-1, 2)


def _phrases(data: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(first place, places, trigger hash, name) of every phrase; ends: for each byte, where its text ends."""
    none = np.zeros(0, np.int64)
    nothing = none, none, none.astype(np.uint64), np.zeros((0, 2), np.uint64)
    if len(data) < span:
        return nothing
    half = span // 2
    h = c.mix(_rolling(data, half))
    at = np.arange(len(h), dtype=np.uint64)
    mask = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    trigger = (mask - (_least((h & ~mask) | (mask - at), span - half + 1) & mask)).astype(np.int64)
    ok = np.arange(len(trigger)) + span <= ends[: len(trigger)]
    new = ok.copy()
    new[1:] &= (trigger[1:] != trigger[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return nothing
    # a phrase ends where the next begins or where its text has no more whole strings
    last_ok = ends[first] - span
    last = np.minimum(np.r_[first[1:], len(trigger)] - 1, last_ok)
    return first, last - first + 1, h[trigger[first]], _names128(data, first, last + span)


def _parts(offsets: np.ndarray, span: int) -> Iterator[tuple[int, int, int]]:
    """(from byte, to byte, first place that is new) for hashing; texts stay together unless longer than PART."""
    total = int(offsets[-1])
    at = 0
    while at < total:
        to = min(total, at + PART)
        cut = offsets[np.searchsorted(offsets, to, "right") - 1]
        if to < total and cut > at:
            to = int(cut)
        yield at, min(total, to + span - 1), to
        at = to


#: What a flush knows of a phrase: all its places are settled; its trigger has several phrases, all settled.
_SETTLED, _SEVERAL = 1, 2
#: What becomes of a phrase's places: all are repeated; they go to the fine parse.
_REPEATED, _FINE = 1, 2


def _coarse(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, place, trigger, name, places) of all phrases."""
    for batch in batches:
        for a, b in c.pieces(batch["text"]):
            part = batch.slice(a, b - a)
            data, offsets = c.text_bytes(part["text"])
            ids = part["doc_key"].to_numpy()
            for lo, hi, to in _parts(offsets, span):
                texts = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left")
                bounds = np.clip(offsets[texts[0] : texts[1] + 1], lo, hi) - lo
                ends = np.repeat(bounds[1:], np.diff(bounds))
                first, size, trigger, name = _phrases(data[lo:hi], ends, span)
                own = first + lo < to
                # a phrase that goes on beyond its part is two: what is named is what lies in the part
                cut = own & (first + lo + size > to)
                size = np.where(cut, to - first - lo, size)
                name = np.array(name)
                name[cut] = _names128(data[lo:hi], first[cut], first[cut] + size[cut] + span - 1)
                first, size, trigger, name = first[own] + lo, size[own], trigger[own], name[own]
                doc = np.searchsorted(offsets, first, "right") - 1
                # the smallest of many hashes isn't spread evenly; mixed again it is
                yield ids[doc], first - offsets[doc], c.mix(trigger), name[:, 0], name[:, 1], size.astype(np.uint64)


def _per(group: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """How many of a group are in the mask."""
    return np.bincount(group, mask, group[-1] + 1 if len(group) else 0).astype(np.int64)


def _parse(span: int, n: int, slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, places, trigger, n1, n2, size in c.gathered(_coarse(batches, span), c.FLUSH // 2):
            order, new = c.classes(trigger, n1, n2)
            entry = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(order)]))
            triggers = trigger[order[new]]
            group_of_entry = np.cumsum(np.r_[True, triggers[1:] != triggers[:-1]]) - 1
            often = np.bincount(entry) > 1
            several = np.bincount(group_of_entry)[group_of_entry] > 1
            what = np.zeros(len(keys), np.uint64)
            what[order] = np.where(often[entry], _REPEATED, 0)
            what[order[new]] |= np.where(several, _FINE, 0).astype(np.uint64)
            told = what > 0
            yield from c.send(c.by_key(keys[told], n), n, slots, keys[told], places[told], size[told], what[told])
            lead = np.r_[True, group_of_entry[1:] != group_of_entry[:-1]] if len(new) else np.zeros(0, bool)
            asked = np.zeros(len(keys), bool)
            asked[order[new[lead]]] = True  # one for each trigger
            state = np.zeros(len(keys), np.uint64)
            state[order[new]] = np.where(several, _SEVERAL, np.where(often, _SETTLED, 0)).astype(np.uint64)
            yield from c.send(c.bucket_of(trigger[asked], n), n, slots, keys[asked], places[asked], trigger[asked] & np.uint64(0xFFFFFFFFFFFF), n1[asked], n2[asked], size[asked], state[asked])

    return run


def _dictionary(n: int, slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, places, (trigger, n1, n2, size, state)), (told_keys, told_places, (told_size, told_what)) = c.receive(batches, 5, 2)
        if len(keys):
            several = state == _SEVERAL
            n1, n2 = np.where(several, 0, n1), np.where(several, 0, n2)
            order, new = c.classes(trigger, several, n1, n2)
            entry = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(order)]))
            keys, places, trigger, size, state, several = (x[order] for x in (keys, places, trigger, size, state, several))
            group = np.cumsum(np.r_[True, trigger[1:] != trigger[:-1]]) - 1
            first = np.zeros(len(keys), bool)
            first[new] = True
            often = ((np.bincount(entry) > 1) | (_per(entry, state == _SETTLED) > 0))[entry] & ~several
            open_ = _per(group, several | ~often) > 0
            fine = first & ~several & ((_per(group, first) > 1) & open_)[group]
            what = np.where(often & (state != _SETTLED), _REPEATED, 0) | np.where(fine, _FINE, 0)
            told = what > 0
            told_keys, told_places, told_size, told_what = np.r_[told_keys, keys[told]], np.r_[told_places, places[told]], np.r_[told_size, size[told]], np.r_[told_what, what[told].astype(np.uint64)]
        yield from c.give_back(n, slots, told_keys, told_places, told_size, told_what)

    return run


# ------------------------------------------------------------------------------------------ dictionary and parse


#: Bytes of a trigger of the fine parse, and every how many places there is one.
TRIGGER, EVERY = 12, 48


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank, from 1, of each symbol's suffix, which ends where its string does (ends); equal suffixes have equal ranks.

    Ranks by the first symbol, then by twice as many each time, until nothing is told apart any more.
    """
    values, rank = np.unique(symbols, return_inverse=True)
    rank, found, at, step = rank.astype(np.uint64) + np.uint64(1), len(values), np.arange(len(symbols)), 1
    while True:
        there = at + step < ends
        after = np.where(there, rank[np.minimum(at + step, len(rank) - 1)], 0) if len(rank) else rank
        values, rank = np.unique(rank << np.uint64(32) | after, return_inverse=True)
        rank = rank.astype(np.uint64) + np.uint64(1)
        if len(values) == found:
            return rank
        found, step = len(values), 2 * step


def corpus_order(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of texts (data, after one another; ends: for each byte, where its text ends) in the order of their suffixes.

    Equal suffixes are in the order of their places.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    start_of_text = np.r_[True, ends[1:] != ends[:-1]]
    cut = start_of_text.copy()
    if len(data) >= TRIGGER:
        roll = c.mix(_rolling(data, TRIGGER))
        inside = np.arange(len(roll)) + TRIGGER <= ends[: len(roll)]
        cut[: len(roll)] |= inside & (roll % np.uint64(EVERY) == 0)
    first = np.flatnonzero(cut)
    phrase_of = np.cumsum(cut) - 1
    # a phrase goes on to the end of the trigger that begins the next one, or to its text's end
    stop = np.minimum(np.r_[first[1:], len(data)] + np.where(np.r_[start_of_text[first[1:]], True], 0, TRIGGER), ends[first])
    blob = data.tobytes()
    number: dict[bytes, int] = {}
    parse = np.fromiter((number.setdefault(blob[a:b], len(number)) for a, b in zip(first.tolist(), stop.tolist(), strict=True)), np.int64, len(first))
    words = np.frombuffer(b"".join(number), np.uint8)
    size = np.fromiter(map(len, number), np.int64, len(number))
    starts = np.cumsum(size) - size
    in_dictionary = suffix_ranks(words, np.repeat(starts + size, size))
    last_phrase = np.flatnonzero(np.r_[start_of_text[first[1:]], True])
    in_parse = suffix_ranks(in_dictionary[starts[parse]], np.repeat(last_phrase + 1, np.diff(np.r_[0, last_phrase + 1])))
    then = np.where(np.r_[start_of_text[first[1:]], True], 0, np.r_[in_parse[1:], 0]).astype(np.uint64)
    rest = in_dictionary[starts[parse[phrase_of]] + np.arange(len(data)) - first[phrase_of]]
    return np.argsort(rest << np.uint64(32) | then[phrase_of], kind="stable")


def repeated_places(data: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(places whose ``span`` bytes lie in their text, number of the class of equal ones), from neighbours in corpus order."""
    order = corpus_order(data, ends)
    order = order[order + span <= ends[order]]
    if not len(order):
        return order, order
    eight = np.ndarray((max(0, len(data) - 7),), "<u8", data.tobytes(), 0, (1,))
    same = np.arange(len(order) - 1)
    for at in [*range(0, span - 7, 8), *([span - 8] if span % 8 else [])] if span >= 8 else []:
        same = same[eight[order[same] + at] == eight[order[same + 1] + at]]
    if span < 8:
        for at in range(span):
            same = same[data[order[same] + at] == data[order[same + 1] + at]]
    new = np.ones(len(order), bool)
    new[same + 1] = False
    return order, np.cumsum(new) - 1


def _left(batches: Iterator[pa.RecordBatch], span: int, settled: list) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, place, whether the next one follows in its text, bytes) of stretches of places that go to the fine parse; the others go to ``settled``."""
    for batch in batches:
        texts = batch["text"].cast(pa.large_binary())
        for i, (key, found, more) in enumerate(zip(batch["doc_key"].to_pylist(), batch["places"].to_pylist(), batch["more"].to_pylist(), strict=True)):
            at, (size, what) = c.places_of(found), (c.large(x).astype(np.int64) for x in more)
            done = what & _REPEATED > 0
            if done.any():
                settled.append((np.full(done.sum(), key), at[done], size[done].astype(np.uint64)))
            fine = what & _FINE > 0
            at, size = at[fine], size[fine]
            if not len(at):
                continue
            text = np.frombuffer(texts[i].as_buffer(), np.uint8)
            cover = np.zeros(len(text) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
            edges = np.flatnonzero(np.diff(np.r_[0, np.cumsum(cover) > 0, 0]))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                for lo in range(a, b, PART):
                    yield key, lo, text[lo : min(b, lo + PART) + span - 1].copy()


def _names(span: int, n: int, slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled: list = []
        held: list = []

        def passed_on() -> Iterator[pa.RecordBatch]:
            for keys, places, size in c.gathered(iter(settled)):
                order = np.lexsort((places, keys))
                keys, places, size = keys[order], places[order], size[order]
                yield from c.send(c.by_key(keys, n), n, slots, keys, places, size)
            settled.clear()

        def ordered() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[:2])
            size = np.array([len(x[2]) for x in held])
            data, stops = np.concatenate([x[2] for x in held]), np.cumsum(size)
            order, kind = repeated_places(data, np.repeat(stops, size), span)
            which = np.searchsorted(stops, order, "right")
            key, place = np.array([x[0] for x in held])[which], np.array([x[1] for x in held])[which] + order - (stops - size)[which]
            often = (np.bincount(kind) > 1)[kind]
            lead = np.r_[True, kind[1:] != kind[:-1]] if len(kind) else np.zeros(0, bool)
            settled.append((key[often], place[often], np.ones(often.sum(), np.uint64)))
            pick = np.flatnonzero(lead)
            pick = pick[np.lexsort((place[pick], key[pick]))]
            name = _names128(data, order[pick], order[pick] + span)
            yield from c.send(c.bucket_of(name[:, 0], n), n, slots, key[pick], place[pick], name[:, 0], name[:, 1], often[pick].astype(np.uint64))
            held.clear()

        total = 0
        for stretch in _left(batches, span, settled):
            held.append(stretch)
            total += len(stretch[2])
            if total > PART:
                yield from ordered()
                total = 0
            if len(settled) > 100_000:
                yield from passed_on()
        if held:
            yield from ordered()
        yield from passed_on()

    return run


def _ranked(n: int, slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, places, (n1, n2, known)), (told_keys, told_places, (told_size,)) = c.receive(batches, 3, 1)
        if len(keys):
            order, new = c.classes(n1, n2)
            often = np.diff(np.r_[new, len(order)]) > 1
            again = order[np.repeat(often, np.diff(np.r_[new, len(order)]))]
            again = again[known[again] == 0]
            told_keys, told_places, told_size = np.r_[told_keys, keys[again]], np.r_[told_places, places[again]], np.r_[told_size, np.ones(len(again), np.uint64)]
        yield from c.give_back(n, slots, told_keys, told_places, told_size)

    return run


def _remove(span: int, clean: bool):
    """clean: whole rows with a text without its repeats, instead of the measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, spans, kept = [], [], [], []
            for text, found, more in zip(batch["text"].cast(pa.large_binary()).to_pylist(), batch["places"].to_pylist(), batch["more"].to_pylist(), strict=True):
                total.append(len(text))
                runs = 0
                if found:
                    cover = np.zeros(len(text) + 1, np.int64)
                    at = c.places_of(found)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + c.large(more[0]).astype(np.int64) + span - 1, -1)
                    out = np.cumsum(cover)[:-1] > 0
                    runs = int((out & ~np.r_[False, out[:-1]]).sum())
                    text = np.frombuffer(text, np.uint8)[~out].tobytes()
                gone.append(total[-1] - len(text))
                spans.append(runs)
                kept.append(text)
            if clean:
                yield pa.RecordBatch.from_arrays([batch["whole_row"], pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())], ["whole_row", "clean"])
                continue
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.int64()) for x in (total, gone, spans)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _found(rows: DataFrame, span: int) -> DataFrame:
    """(doc_key, places, more): the repeated places of documents that have some, and how many follow each."""
    rows = rows.select("doc_key", "doc_id", "text")
    n = c.buckets(rows)
    slots = c.even_keys(n)
    phrases = rows.mapInArrow(c.lean(_parse(span, n, slots)), c.FACTS)
    entries = c.by_document(c.in_buckets(phrases, n, _dictionary(n, slots), c.FACTS), n, 2)
    names = rows.join(entries, "doc_key", "left").filter("places is not null").mapInArrow(c.lean(_names(span, n, slots)), c.FACTS)
    return c.by_document(c.in_buckets(names, n, _ranked(n, slots), c.FACTS), n, 1)


def dedup_suffixes(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row of docs(doc_id, text)."""
    rows = c.documents(docs).select("doc_key", "doc_id", "text")
    return rows.join(_found(rows, span), "doc_key", "left").mapInArrow(c.lean(_remove(span, False)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def clean_texts(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs, with their columns, without repeats: text (less what a cut leaves of a code point) and n_chars, if there, are new.

    A null text becomes empty; columns may have any names; rows with a repeated or null doc_id are documents of their own; an empty table stays empty.
    """
    rows = c.documents(docs, c.whole_row(docs))
    kept = rows.select("doc_key", "text", "whole_row").join(_found(rows, span), "doc_key", "left").select("whole_row", "text", "places", "more")
    schema = T.StructType([T.StructField("whole_row", rows.schema["whole_row"].dataType), T.StructField("clean", T.StringType())])
    return c.unpacked(kept.mapInArrow(c.lean(_remove(span, True)), schema), docs.columns, text=F.col("clean"), n_chars=F.length("clean").cast("long"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of dedup_suffixes over the whole documents table."""
    out = dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
i AS (SELECT doc_id, unnest(range(1, CAST(octet_length(b) AS BIGINT) - 198)) AS i FROM d WHERE octet_length(b) >= 200),
k AS (SELECT i.doc_id, i.i, b[i.i : i.i + 199] AS s FROM i JOIN d ON d.doc_id = i.doc_id),
often AS (SELECT s FROM k GROUP BY s HAVING count(*) > 1),
again AS (SELECT doc_id, i FROM k JOIN often USING (s)),
edges AS (SELECT *, CASE WHEN i - lag(i) OVER w <= 200 THEN 0 ELSE 1 END AS new FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges) GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER w, 0) + 1 AS a, runs.a - 1 AS z FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY runs.a)
  UNION ALL SELECT d.doc_id, coalesce(max(z), 0) + 1, CAST(octet_length(any_value(b)) AS BIGINT) FROM d LEFT JOIN runs ON runs.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (SELECT gaps.doc_id, string_agg(hex(b[gaps.a : gaps.z]), '' ORDER BY gaps.a) AS h FROM gaps JOIN d ON d.doc_id = gaps.doc_id WHERE gaps.a <= gaps.z GROUP BY gaps.doc_id),
gone AS (SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS n, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(gone.n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256 FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def brute(rows: list[tuple[int, str | None]], span: int = SPAN) -> list[tuple]:
    """What op3 must return, from all strings in plain Python (for tests)."""
    texts = {d: (t or "").encode() for d, t in rows}
    count = Counter(hash(t[i : i + span]) for t in texts.values() for i in range(len(t) - span + 1))
    out = []
    for d, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if count[hash(t[i : i + span])] > 1:
                gone[i : i + span] = b"\x01" * span
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)
