"""Scores from a hierarchical Pitman-Yor language model.

Tokens of a text are its words with A-Z in lower case, then one end.  The model has three levels of restaurants:

* one for every two words before a token.  Its dishes are words: c customers (training occurrences) at t tables each;
* its parent, one for the nearer of the two words, which all contexts that end in it share.  Customers are the children's tables;
* the root, which all of these share.  Its base is uniform over the training vocabulary and one unknown word.

Contexts are the words themselves (64 bits of hash), however many there are; a text's start is a word like others, and what stands before
it is one of STARTS marks by document, not by partition.

Seating is sampled by blocked Gibbs sweeps.  Given the parent's predictive probabilities, the tables of every dish of every
restaurant of two words are sampled anew by the Chinese-restaurant rule, then those of their parents.  Before the root is known, all words
are taken to be equally likely (ROOT).  After WARM sweeps the root gets the parents' tables as customers and is seated; given this
root there are BURN_IN + SAMPLES sweeps from a fresh start, and the predictive probabilities of the last SAMPLES are averaged.  A text's score is the sum of the log10 of its tokens' averages.  Customers sit down one by
one up to 64, then in steps of a 16th of those seated, with the expected number of new tables rounded at random.  Random numbers
are hashes of (dish, restaurant, sweep, seat), so they don't depend on where or in which order the work is done.  Discounts and
strengths are parameters.

Distribution.  A token goes to the bucket of the nearer word, so both lower levels of restaurants are local to a bucket.  Words' totals
(training count, tables of the parents) meet in buckets of their own and come back to the buckets that asked; each answer holds
its sender's share of the corpus totals.  All passes read one exchange.  Sums for a document come back as whole numbers of 1 / UNIT.

The tokens after a word with more than PART estimated tokens (a millionth of all, if that is more) go to several buckets, by classes of the word
before it (rooms).  That is a matter of place alone: it is one restaurant, with the same seats.  A room sends its distinct triples, packed, to
the word's head, which unpacks a room at a time, seats the restaurant whole and sends each room the parents' tables after every sweep.

Defined cases: null text is empty and has its end alone; a null doc_id is trained on; rows with a repeated or null doc_id are
documents of their own; without training tokens every token has probability 1; an empty table gives no rows; a very long text sends
its tokens like any other; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm import common as c

FOLDS = 10
WARM, BURN_IN, SAMPLES = 4, 2, 4
#: Of the root, the parents, and the restaurants of two words.
DISCOUNT, STRENGTH = (0.6, 0.7, 0.8), (1.0, 1.0, 1.0)
SEED = 17
#: Every word's probability before the root is known.
ROOT = 2.0**-20
#: Parts of 1 in which a bucket's share of a score is sent.
UNIT = 10**7
#: Tokens after a word that go to one bucket; marks that stand before a text's start; one document of so many is read to find words with more.
PART, STARTS, SAMPLED = 1 << 18, 1024, 64
#: Words of that sample that all tasks know, the most frequent ones: they are sent by number, others by hash.
COMMON = 1 << 16
#: Bytes of text that a bucket stands for, and tokens that a map task gathers before it sends them.
BUCKET_BYTES, FLUSH = 16 << 20, 800_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
END, START = np.uint64(0x123456789ABCDEF1), np.uint64(0x0FEDCBA987654321)
_NONE = np.zeros(0, np.uint64)
_TIMES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, place of each word among the distinct ones, hashes of the distinct ones)."""
    data, offsets = c.text_bytes(texts)
    data = _LOWER[data]
    starts, ends, counts = c.word_spans(data, offsets)
    size = ends - starts
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] = 1
    np.subtract.at(edges, ends, 1)
    inside = data[np.cumsum(edges[:-1], dtype=np.int8) > 0]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(size)]), pa.py_buffer(inside)]).dictionary_encode()
    data, offsets = c.text_bytes(found.dictionary)
    return counts, found.indices.to_numpy().astype(np.int64), c.word_hashes(data, offsets[:-1], offsets[1:])


def start_mark(keys: np.ndarray) -> np.ndarray:
    return c.mix(START + np.uint64(1) + c.mix(keys.astype(np.uint64)) % np.uint64(STARTS))


def room(near: np.ndarray, far: np.ndarray, many: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Name under which a word after another is sent; many: sorted words that have several rooms, parts: how many."""
    if not len(many):
        return near
    at = np.minimum(np.searchsorted(many, near), len(many) - 1)
    return np.where(many[at] == near, c.mix(near ^ c.mix(c.mix(far) % parts[at] + np.uint64(1))), near)


def rooms_of(many: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names of all rooms in order, the word of each)."""
    heads, n = np.repeat(many, parts.astype(np.int64)), parts.astype(np.int64)
    own = np.arange(len(heads)) - np.repeat(np.cumsum(n) - n, n)
    names = c.mix(heads ^ c.mix(own.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(names)
    return names[order], heads[order]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(key and held out of each text, words of each text, places among the distinct words, hashes of these)."""
    for batch in batches:
        for a, b in c.pieces(batch["text"]):
            part = batch.slice(a, b - a)
            yield part["doc_key"].to_numpy(), part["held_out"].to_numpy(zero_copy_only=False), *_tokens(part["text"])


def _triples(held: list[tuple[np.ndarray, ...]], many: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hashes, text of each token, and far word, near word or its room, and word as places among the hashes)."""
    keys, counts = (np.concatenate([x[i] for x in held]) for i in (0, 2))
    marks = start_mark(keys)
    hashes = np.unique(np.concatenate([*(x[4] for x in held), np.unique(marks), [END, START]]))
    place = lambda x: np.searchsorted(hashes, x)
    n = counts + 1
    doc = np.repeat(np.arange(len(n)), n)
    last = np.cumsum(n) - 1
    first = last - n + 1
    word = np.full(n.sum(), place(END))
    inner = np.ones(len(word), bool)
    inner[last] = False
    word[inner] = np.concatenate([place(x[4])[x[3]] for x in held])
    near, far = np.empty_like(word), np.empty_like(word)
    near[1:], far[2:] = word[:-1], word[:-2]
    near[first] = place(START)
    far[first[n > 1] + 1] = place(START)
    far[first] = place(marks)
    if len(many):
        pick = np.flatnonzero(np.isin(hashes, many)[near])
        rooms = room(hashes[near[pick]], hashes[far[pick]], many, parts)
        old, hashes = hashes, np.unique(np.r_[hashes, rooms])
        moved = place(old)
        far, near, word = moved[far], moved[near], moved[word]
        near[pick] = place(rooms)
    return hashes, doc, far, near, word


def _gaps(values: np.ndarray) -> bytes:
    return c.small(np.r_[values[:1], values[1:] - values[:-1]])


def _sent(words: np.ndarray, common: np.ndarray) -> list[bytes]:
    """Words in order of hash: hashes of those that aren't common, numbers of those that are."""
    place = np.searchsorted(common, words)
    known = common[np.minimum(place, len(common) - 1)] == words if len(common) else np.zeros(len(words), bool)
    return [_gaps(words[~known]), _gaps(place[known])]


def _received(others: bytes, numbers: bytes, common: np.ndarray) -> np.ndarray:
    words, place = (np.cumsum(c.large(x), dtype=np.uint64) for x in (others, numbers))
    return np.sort(np.concatenate([words, common[place.astype(np.int64)]]), kind="stable") if len(place) else words


def _send(many: np.ndarray, parts: np.ndarray, n: int, slots: np.ndarray, common: np.ndarray):
    """A row for each bucket: its words once, and triples as places among them."""

    def flushed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        hashes, doc, far, near, word = _triples(held, many, parts)
        keys, out = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        to = c.bucket_of(c.mix(hashes), n)[near]
        if n <= 1 << 18 and len(keys) <= 1 << 22 and len(hashes) <= 1 << 24:
            order = np.argsort(to << 46 | doc << 24 | near)
        else:
            order = np.lexsort((near, doc, to))
        doc, far, near, word, to = (x[order] for x in (doc, far, near, word, to))
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        there, local = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        rows = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(to)], strict=True):
            for x in (far, near, word):
                there[x[lo:hi]] = True
            own = np.flatnonzero(there)
            there[own] = False
            local[own] = np.arange(len(own))
            facts = c._rises(keys[doc[lo:hi]], 2 * local[near[lo:hi]] + out[doc[lo:hi]])
            rows.append((int(slots[to[lo]]), *facts, [*(c.small(local[x[lo:hi]]) for x in (far, word)), *_sent(hashes[own], common)]))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), c._FACTS, strict=True)], schema=c._FACTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for piece in _pieces(batches):
            held.append(piece)
            total += len(piece[3])
            if total >= FLUSH:
                yield flushed(held)
                held, total = [], 0
        if held:
            yield flushed(held)

    return run


def uniform(dish: np.ndarray, sweep: int, seat: int) -> np.ndarray:
    """A number from 0 to 1 for each dish of a restaurant."""
    at = (SEED * 1_000_003 + sweep) * 0x9E3779B97F4A7C15 + seat * 0xD6E8FEB86659FD93
    return (c.mix(dish ^ np.uint64(at & (2**64 - 1))) >> np.uint64(11)) * 2.0**-53


def seat(customers: np.ndarray, mass: np.ndarray, discount: float, dish: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish: customers sit down one after another; mass: (strength + discount * tables) * the parent's probability."""
    tables = np.minimum(customers, 1)
    at, seated = np.flatnonzero(customers > 1), 1
    while len(at):
        step = 1 if seated < 64 else seated // 16
        new = mass[at] / (seated - discount * tables[at] + mass[at])
        tables[at] += np.floor(np.minimum(step, customers[at] - seated) * new + uniform(dish[at], sweep, seated)).astype(tables.dtype)
        seated += step
        at = at[customers[at] > seated]
    return tables


def _one_row_at_a_time(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


class _Bucket:
    """A bucket's triples, pairs and words, each once; rooms: all rooms' names in order and their words."""

    def __init__(self, rows: Iterator[dict], rooms: tuple[np.ndarray, np.ndarray] = (_NONE, _NONE), common: np.ndarray = _NONE):
        keys, places, columns, own = [], [], [[], []], []
        for row in rows:
            self.name = row["bucket"]
            k, p = c._unrises(row["keys"], row["runs"], row["places"])
            far, word = (c.large(x) for x in row["more"][:2])
            others, numbers = (*row["more"][2:], c.small(_NONE))[:2]
            own.append(_received(others, numbers, common))
            keys.append(k)
            places.append(p.astype(np.int32))
            for out, x in zip(columns, (far, word), strict=True):
                out.append(x.astype(np.int32))
        hashes = np.unique(np.concatenate(own))
        maps = [np.searchsorted(hashes, x).astype(np.int32) for x in own]
        del own
        self.keys, self.doc = np.unique(np.concatenate(keys), return_inverse=True)
        self.doc = self.doc.astype(np.int32)
        del keys
        train = np.concatenate([(p & 1) == 0 for p in places])
        near = np.concatenate([m[p >> 1] for m, p in zip(maps, places, strict=True)])
        del places
        far, word = (np.concatenate([m[x] for m, x in zip(maps, xs, strict=True)]) for xs in columns)
        del columns, maps
        # by (near, word, far): the triples of a pair follow one another
        if len(hashes) > 1 << 21:
            order = np.lexsort((far, word, near)).astype(np.int32)
        else:
            packed = near.astype(np.int64)
            for x in (word, far):
                packed <<= 21
                packed |= x
            order = np.argsort(packed).astype(np.int32)
            del packed
        near, word, far = near[order], word[order], far[order]
        pair = np.r_[True, (near[1:] != near[:-1]) | (word[1:] != word[:-1])][: len(near)]
        new = pair | np.r_[True, far[1:] != far[:-1]][: len(near)]
        self.triple_of = np.empty(len(order), np.int32)
        self.triple_of[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        self.seen = np.bincount(self.triple_of, train).astype(np.int32)
        self.pair_of = (np.cumsum(pair, dtype=np.int32) - 1)[new]
        pair_near, pair_word = near[pair], word[pair]
        near, far, word = near[new], far[new], word[new]
        del pair, new, train
        _, context = np.unique(near.astype(np.int64) << 32 | far, return_inverse=True)
        self.context = context.astype(np.int32)
        del context
        self.near_of = np.cumsum(np.r_[False, pair_near[1:] != pair_near[:-1]][: len(pair_near)], dtype=np.int32)
        there = np.zeros(len(hashes), bool)
        there[pair_word] = True
        words, self.word_of = np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[pair_word]
        self.words = hashes[words]
        # of the rooms here: first pair and the one after the last, place among the nearer words, name, word
        first = np.flatnonzero(np.r_[True, pair_near[1:] != pair_near[:-1]][: len(pair_near)])
        names = hashes[pair_near[first]]
        at = np.flatnonzero(np.isin(names, rooms[0]))
        heads = rooms[1][np.searchsorted(rooms[0], names[at])]
        self.rooms = list(zip(first[at].tolist(), np.r_[first, len(pair_near)][at + 1].tolist(), at.tolist(), names[at].tolist(), heads.tolist(), strict=True))
        hashes[pair_near[first[at]]] = heads  # a room is no word, so it stands nowhere else
        spans = [np.searchsorted(self.pair_of, x[:2]) for x in self.rooms]
        self.room_fars = [hashes[far[a:z]] for a, z in spans]
        self.many = np.flatnonzero(self.seen > 1)  # who alone has something to draw
        far, near, word = (x[self.many] for x in (far, near, word))
        self.triple = c.mix(hashes[far] * _TIMES[0] + hashes[near] * _TIMES[1] + hashes[word] * _TIMES[2])
        self.pair = c.mix(hashes[pair_near] * _TIMES[1] + hashes[pair_word] * _TIMES[2])
        self.customers = np.bincount(self.context, self.seen)  # of each restaurant of two words
        # without seating, each dish has one table
        self.tables = np.minimum(self.seen, 1)
        self.pair_customers = self._by_pair(self.tables)
        self.pair_tables = np.minimum(self.pair_customers, 1)
        self.given = []

    def leave_rooms(self) -> None:
        """Without the rooms' customers."""
        out = np.zeros(len(self.pair), bool)
        for lo, hi, *_ in self.rooms:
            out[lo:hi] = True
        for x in (self.seen, self.tables):
            x[out[self.pair_of]] = 0
        left = self.seen[self.many] > 1
        self.many, self.triple = self.many[left], self.triple[left]
        for x in (self.pair_customers, self.pair_tables):
            x[out] = 0

    def seat_rooms(self, given: dict[int, tuple[np.ndarray, ...]], number: int) -> None:
        """The rooms' parents as their heads have seated them; given: for each name, customers and tables of its pairs, and of all, by sweep."""
        self.given = []
        for lo, hi, at, name, _ in self.rooms:
            customers, tables, totals = given[name]
            self.pair_customers[lo:hi], self.pair_tables[lo:hi] = customers[number], tables[number]
            self.given.append((at, *totals[number]))

    def _totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each nearer word."""
        customers, tables = np.bincount(self.near_of, self.pair_customers), np.bincount(self.near_of, self.pair_tables)
        for at, of_all, tables_of_all in self.given:
            customers[at], tables[at] = of_all, tables_of_all
        return customers, tables

    def _by_pair(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.pair_of, values, len(self.pair)).astype(np.int32)

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word_of, values, len(self.words)).astype(np.int64)

    def of_parent(self, root: np.ndarray, totals: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Probability of each pair's word after the nearer word; root: of each word."""
        customers, tables = totals or self._totals()
        back = STRENGTH[1] + DISCOUNT[1] * tables[self.near_of]
        return (self.pair_customers - DISCOUNT[1] * self.pair_tables + back * root[self.word_of]) / (STRENGTH[1] + customers[self.near_of])

    def _back(self) -> np.ndarray:
        """Of each restaurant of two words."""
        return STRENGTH[2] + DISCOUNT[2] * np.bincount(self.context, self.tables)

    def probability(self, root: np.ndarray) -> np.ndarray:
        return (self.seen - DISCOUNT[2] * self.tables + self._back()[self.context] * self.of_parent(root)[self.pair_of]) / (STRENGTH[2] + self.customers[self.context])

    def sweep(self, root: np.ndarray, number: int) -> None:
        totals = self._totals()
        mass = self._back()[self.context[self.many]] * self.of_parent(root, totals)[self.pair_of[self.many]]
        self.tables = np.minimum(self.seen, 1)
        self.tables[self.many] = seat(self.seen[self.many], mass, DISCOUNT[2], self.triple, number)
        back = STRENGTH[1] + DISCOUNT[1] * totals[1]
        self.pair_customers = self._by_pair(self.tables)
        self.pair_tables = seat(self.pair_customers, back[self.near_of] * root[self.word_of], DISCOUNT[1], self.pair, number)


class _Head:
    """The whole restaurant of a word that has rooms; rows: packed triples of each."""

    def __init__(self, rows: list[dict], common: np.ndarray):
        self.rows, self.common = rows, common
        self.near = np.array([rows[0]["near"]], np.int64).view(np.uint64)
        own = [_received(*r["packed"][2:4], common) for r in rows]
        self.words = np.unique(np.concatenate(own))
        self.at = [np.searchsorted(self.words, x).astype(np.int32) for x in own]
        self.pair = c.mix(self.near * _TIMES[1] + self.words * _TIMES[2])
        self.context_tables = [np.zeros(0)] * len(rows)
        self.customers = self._seated()
        self.tables = np.minimum(self.customers, 1)

    def _seated(self, parent: np.ndarray | None = None, number: int = 0) -> np.ndarray:
        """Tables of each word in all rooms, which are the parent's customers; without a parent each dish has one."""
        total = np.zeros(len(self.words), np.int32)
        for i, (row, at) in enumerate(zip(self.rows, self.at, strict=True)):
            fars = _received(*row["packed"][:2], self.common)
            context, runs, seen = (c.large(x) for x in row["packed"][4:])
            context, seen = context.astype(np.int32), seen.astype(np.int32)
            pair = np.repeat(np.arange(len(runs), dtype=np.int32), runs.astype(np.int64))
            tables = np.minimum(seen, 1)
            if parent is not None:
                many = np.flatnonzero(seen > 1)
                word, of = at[pair[many]], context[many]
                triple = c.mix(fars[of] * _TIMES[0] + self.near * _TIMES[1] + self.words[word] * _TIMES[2])
                back = STRENGTH[2] + DISCOUNT[2] * self.context_tables[i][of]
                tables[many] = seat(seen[many], back * parent[word], DISCOUNT[2], triple, number)
            self.context_tables[i] = np.bincount(context, tables, len(fars)).astype(np.int32)
            total[at] += np.bincount(pair, tables, len(runs)).astype(np.int32)
        return total

    def sweep(self, root: np.ndarray, number: int) -> None:
        back = STRENGTH[1] + DISCOUNT[1] * self.tables.sum()
        parent = (self.customers - DISCOUNT[1] * self.tables + back * root) / (STRENGTH[1] + self.customers.sum())
        self.customers = self._seated(parent, number)
        self.tables = seat(self.customers, back * root, DISCOUNT[1], self.pair, number)


_BOTH = "bucket int, asker int, words binary, counts binary, tables binary, room long, near long, packed array<binary>"


def _packed(b: _Bucket, n: int, slots: np.ndarray, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each room: what its head needs of the triples that were trained on."""
    heads = np.array([x[4] for x in b.rooms], np.uint64)
    for (lo, hi, _, name, head), far, to in zip(b.rooms, b.room_fars, _home(heads, n).tolist(), strict=True):
        a, z = np.searchsorted(b.pair_of, (lo, hi))
        trained = np.flatnonzero(b.seen[a:z])
        pick = a + trained
        fars, context = np.unique(far[trained], return_inverse=True)
        runs = np.bincount(b.pair_of[pick] - lo, minlength=hi - lo)
        packed = [*_sent(fars, common), *_sent(b.words[b.word_of[lo:hi]], common), *(c.small(x) for x in (context, runs, b.seen[pick]))]
        ids = np.array([name, head], np.uint64).view(np.int64)
        row = int(slots[to]), b.name, None, None, None, *ids.tolist(), packed
        yield from _batch([row], _BOTH, pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.int64(), pa.int64(), pa.list_(pa.binary())).to_batches()


def _home(words: np.ndarray, n: int) -> np.ndarray:
    """Buckets of words' heads."""
    return c.bucket_of(c.mix(words ^ _TIMES[0]), n)


def _heads(packed: pa.Table, common: np.ndarray) -> Iterator[_Head]:
    """One after another."""
    near = packed["near"].to_numpy()
    for x in np.unique(near).tolist():
        yield _Head([packed.slice(i, 1).to_pylist()[0] for i in np.flatnonzero(near == x).tolist()], common)


def _head_words(packed: pa.Table, common: np.ndarray) -> np.ndarray:
    """Words of all heads of a bucket."""
    found = np.zeros(0, np.uint64)
    for blobs in packed["packed"]:
        found = np.union1d(found, _received(blobs[2].as_py(), blobs[3].as_py(), common))
    return found


_ASK = "bucket int, asker int, words binary, counts binary, tables binary"
_TELL = "bucket int, teller int, counts binary, customers binary, tables binary, totals array<long>"


def _batch(rows: list[tuple], names: str, *kinds: pa.DataType) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], [x.split()[0] for x in names.split(", ")])


#: No rows of _BOTH.
_NO_ROOMS = _batch([], _BOTH, pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.int64(), pa.int64(), pa.list_(pa.binary()))


def _parted(both: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(what is asked, packed rooms).  Here, not by a filter before: Spark would move that ahead of the exchange and make all rows twice."""
    asked = pc.is_null(both["packed"])
    return both.filter(asked).select([x.split()[0] for x in _ASK.split(", ")]), both.filter(pc.invert(asked))


def _shares(words: np.ndarray, n: int) -> list[np.ndarray]:
    to = c.bucket_of(c.mix(words ^ _TIMES[3]), n)
    order = np.argsort(to, kind="stable")
    return np.split(order, np.searchsorted(to[order], np.arange(1, n)))


def _asking(name: int, words: np.ndarray, counts: np.ndarray, tables: np.ndarray, n: int, slots: np.ndarray) -> pa.Table:
    """A row for each bucket of words, with none of them too: the answers hold shares of the totals."""
    rows = []
    for j, pick in enumerate(_shares(words, n)):
        own = words[pick]
        rows.append((int(slots[j]), name, _gaps(own), c.small(counts[pick]), c.small(tables[pick])))
    return _batch(rows, _ASK, pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())


def _root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to all that ask a bucket of words."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    asked = [np.cumsum(c.large(r["words"]), dtype=np.uint64) for r in rows]
    words = np.unique(np.concatenate(asked))
    at = [np.searchsorted(words, x) for x in asked]
    counts, customers = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for a, r in zip(at, rows, strict=True):
        counts[a] += c.large(r["counts"]).astype(np.int64)
        customers[a] += c.large(r["tables"]).astype(np.int64)
    # (strength + discount * tables) / (vocabulary + 1), which a large vocabulary brings to the discount
    tables = seat(customers, np.full(len(words), DISCOUNT[0]), DISCOUNT[0], words, 0)
    totals = [int(x) for x in (counts.sum(), (counts > 0).sum(), customers.sum(), tables.sum())]
    for lo in range(0, len(rows), 200):
        some = [(r["asker"], r["bucket"], *(c.small(x[a]) for x in (counts, customers, tables)), totals) for a, r in zip(at[lo : lo + 200], rows[lo : lo + 200], strict=True)]
        yield from _batch(some, _TELL, pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())).to_batches()


def _told(words: np.ndarray, answers: pa.Table, n: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(training count and root probability of each word, training tokens, vocabulary)."""
    by = {r["teller"]: r for r in answers.to_pylist()}
    counts, customers, tables = (np.zeros(len(words), np.int64) for _ in range(3))
    totals = np.zeros(4, np.int64)
    for j, pick in enumerate(_shares(words, n)):
        row = by[int(slots[j])]
        totals += row["totals"]
        for out, name in ((counts, "counts"), (customers, "customers"), (tables, "tables")):
            out[pick] = c.large(row[name]).astype(np.int64)
    base = (STRENGTH[0] + DISCOUNT[0] * totals[3]) / (totals[1] + 1)
    return counts, (customers - DISCOUNT[0] * tables + base) / (STRENGTH[0] + totals[2]), int(totals[0]), int(totals[1])


def _of_heads(answers: pa.Table) -> dict[int, tuple[np.ndarray, ...]]:
    """For each room, by sweep: customers and tables of its pairs, and of all of its word's."""
    out = {}
    for r in answers.filter(pc.less(answers["teller"], 0)).to_pylist():
        totals = np.array(r["totals"]).reshape(-1, 2)
        customers, tables = (c.large(r[x]).reshape(len(totals), -1).astype(np.int32) for x in ("customers", "tables"))
        out[int(c.large(r["counts"])[0])] = customers, tables, totals
    return out


_SUMS = "doc_key long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's shares added up: whole numbers, so in any order."""
    ((keys, _, (*more, tokens)),) = c.receive(batches, 5)
    keys, doc = np.unique(keys, return_inverse=True)
    sums = [np.zeros(len(keys), np.int64) for _ in more]
    for out, x in zip(sums, more, strict=True):
        np.add.at(out, doc, x.astype(np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums[0]), pa.array(sums[1]), pa.array(np.full(len(keys), tokens[0] if len(tokens) else 0, np.int64)), pa.array(-sums[2] / UNIT), pa.array(-sums[3] / UNIT)], [x.split()[0] for x in _SUMS.split(", ")])


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, text)."""
    rows, numbered = c.identified(docs)
    rows = rows.withColumn("held_out", _held_out())
    n = c.buckets(rows, BUCKET_BYTES)
    wide = max(1, n // 4)
    slots, word_slots = c.even_keys(n), c.even_keys(wide)
    sampled = _sampled(rows)
    (many, parts), common = _frequent(rows, sampled), _common(sampled)
    rooms = rooms_of(many, parts)
    facts = rows.select("doc_key", "text", "held_out").mapInArrow(c.lean(_send(many, parts, n, slots, common)), c.FACTS).repartition(min(n, c.MOST_TASKS), "bucket")

    def warm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _one_row_at_a_time(batches)
        for first in rows:  # none, if there is no bucket here
            b = _Bucket(chain([first], rows), rooms, common)
            counts = b.by_word(b._by_pair(b.seen))
            yield from _packed(b, n, slots, common)
            b.leave_rooms()
            for s in range(WARM):
                b.sweep(np.full(len(b.words), ROOT), s + 1)
            asks = _asking(b.name, b.words, counts, b.by_word(b.pair_tables), wide, word_slots)
            if len(many):
                asks = pa.concat_tables([asks, _NO_ROOMS], promote_options="default")
            yield from asks.to_batches()

    def warm_heads(both: pa.Table) -> pa.Table:
        """What was asked, and what heads ask: they do it under names below 0."""
        c.give_memory_back()
        asked, packed = _parted(both)
        if not packed.num_rows:
            return asked
        words = _head_words(packed, common)
        tables = np.zeros(len(words), np.int64)
        for head in _heads(packed, common):
            for s in range(WARM):
                head.sweep(np.full(len(head.words), ROOT), s + 1)
            tables[np.searchsorted(words, head.words)] += head.tables
        asks = _asking(-1 - packed["bucket"][0].as_py(), words, np.zeros(len(words), np.int64), tables, wide, word_slots)
        return pa.concat_tables([asked, asks])

    def seat_heads(both: pa.Table, answers: pa.Table) -> pa.Table:
        """What _of_heads() reads: the room's name as counts, and all sweeps after one another."""
        c.give_memory_back()
        rows, (_, packed) = [], _parted(both)
        if packed.num_rows:
            words = _head_words(packed, common)
            _, root, _, _ = _told(words, answers, wide, word_slots)
            for head in _heads(packed, common):
                own, states = root[np.searchsorted(words, head.words)], [(head.customers, head.tables)]
                for s in range(BURN_IN + SAMPLES):
                    head.sweep(own, WARM + s + 1)
                    states.append((head.customers, head.tables))
                totals = [int(x.sum()) for state in states for x in state]
                for row, at in zip(head.rows, head.at, strict=True):
                    name = np.array([row["room"]], np.int64).view(np.uint64)
                    rows.append((row["asker"], -1, c.small(name), *(c.small(np.concatenate([state[i][at] for state in states])) for i in (0, 1)), totals))
        return _batch(rows, _TELL, pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))

    def predict(left: pa.Table, right: pa.Table) -> pa.Table:
        c.give_memory_back()  # what the bucket before this one took
        b = _Bucket(_one_row_at_a_time(left.to_batches()), rooms, common)
        counts, root, tokens, vocabulary = _told(b.words, right, wide, word_slots)
        given = _of_heads(right)
        b.seat_rooms(given, 0)
        mean = np.zeros(len(b.seen))
        for s in range(BURN_IN + SAMPLES):
            b.sweep(root, WARM + s + 1)
            b.seat_rooms(given, s + 1)
            if s >= BURN_IN:
                mean += b.probability(root) / SAMPLES
        word = b.word_of[b.pair_of]
        known, base = counts[word] > 0, np.log10((counts[word] + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
        keys = b.keys
        sums = lambda v: np.bincount(b.doc, v[b.triple_of], len(keys))
        parts = lambda v: np.maximum(0, np.rint(-UNIT * sums(v))).astype(np.uint64)
        shares = np.bincount(b.doc, minlength=len(keys)).astype(np.uint64), sums(known).astype(np.uint64), parts(base), parts(np.log10(mean)), np.full(len(keys), tokens, np.uint64)
        return pa.Table.from_batches(list(c.give_back(n, slots, keys, np.zeros(len(keys), np.int64), *shares)))

    def by_bucket(work, schema: str) -> DataFrame:
        if n > c.MOST_TASKS:
            return facts.sortWithinPartitions("bucket").mapInArrow(c.lean(c._one_by_one(work)), schema)
        return facts.mapInArrow(c.lean(work), schema)

    if len(many):
        both = by_bucket(warm, _BOTH).repartition(min(n, c.MOST_TASKS), "bucket")
        asking = both.groupBy("bucket").applyInArrow(warm_heads, _ASK)
    else:
        asking = by_bucket(warm, _ASK)
    told = c.in_buckets(asking, wide, _root, _TELL)
    if len(many):
        of_heads = told.filter("bucket < 0").withColumn("bucket", -1 - F.col("bucket"))
        told = told.filter("bucket >= 0").unionAll(both.groupBy("bucket").cogroup(of_heads.groupBy("bucket")).applyInArrow(seat_heads, _TELL))
    shares = facts.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(predict, c.FACTS)
    sums = c.in_buckets(shares, n, _added, _SUMS)
    out = c.named(sums, rows.select("doc_key", "doc_id") if numbered else None)
    return out.select("doc_id", _held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _sampled(rows: DataFrame) -> DataFrame:
    """(word, often) in about one document of SAMPLED, chosen by hash of their key; checkpointed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in c.pieces(batch["text"]):
                counts, place, word = _tokens(batch["text"].slice(a, b - a))
                word, often = np.r_[word, START], np.r_[np.bincount(place, minlength=len(word)), len(counts)]
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(often)], ["word", "often"])

    some = rows.filter(F.pmod(F.xxhash64("doc_key"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(c.lean(count), "word long, often long")
    return c.checkpointed(some.groupBy("word").agg(F.sum("often").alias("often")))


def _frequent(rows: DataFrame, sampled: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(words, rooms) with more than one: those that the sample has over PART / SAMPLED times.

    PART is a 2**20th of all tokens, if that is more, so there are at most 2**20 such words (16 MB).
    """
    counts = _sampled(rows) if sampled is None else sampled
    part = max(PART, ((counts.agg(F.sum("often")).first()[0] or 0) * SAMPLED) >> 20)
    found = counts.filter(F.col("often") > part // SAMPLED).collect()
    words = np.array([r["word"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([-(-r["often"] * SAMPLED // part) for r in found], np.uint64)[order]


def _common(sampled: DataFrame) -> np.ndarray:
    """The sample's most frequent words, COMMON at most (512 KB), in order of hash."""
    often = F.least("often", F.lit(COMMON))
    least, total = 0, 0
    for row in sampled.groupBy(often.alias("often")).count().orderBy(F.desc("often")).collect():  # COMMON numbers at most
        total += row["count"]
        if total > COMMON:
            break
        least = row["often"]
    found = sampled.filter(often >= least).select("word").collect() if least else []
    return np.sort(np.array([r["word"] for r in found], np.int64).view(np.uint64))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the whole documents table."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_base(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) in plain Python (for tests)."""
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    tokens = {d: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower)), None] for d, t in rows}
    out = {d: zlib.crc32(str(d).encode()) % FOLDS == 0 for d in tokens}
    count = Counter(w for d, ws in tokens.items() if not out[d] for w in ws)
    n, v = sum(count.values()), len(count)
    return [(d, out[d], len(ws), sum(w in count for w in ws), n, sum(log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, ws in sorted(tokens.items())]
