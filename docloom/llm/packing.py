"""Packing documents into sequences by length patterns fitted with non-negative least squares.

Every document becomes its ids and an end id; a longer one is cut into pieces of ``size`` ids, of which the first is the
remainder, so all others fill a sequence alone.  What is packed is the histogram of the other pieces' lengths (at most
``size`` numbers, however large the corpus):

* Patterns: multisets of up to MOST lengths with a sum of exactly ``size``: all pairs; a length and the PAIRS best pairs of lengths
  (those whose scarcer member is commonest) that complete it; and so on from the best triples.
* Fit: repeat counts x >= 0 that minimise |A x - histogram| (A has a column for each pattern, with how many pieces of each
  length it takes), by accelerated projected gradient steps.  Pieces longer than half a sequence need one each, so patterns that
  such a piece opens are fitted first, then those of shorter pieces on what is left of the histogram; and each time patterns of few
  pieces before those of more, so that short pieces are kept for the gaps that only they fill.
* Rounding: counts are rounded and taken, the largest first, as far as pieces are there.
* Residual, after each of the two: from the longest piece down, best fit: the longest that goes into the room that is left, and again.  A pattern is used as often as its pieces allow at once, so the work depends on the number of lengths, not of pieces.
* Repair: all sequences with room left are taken apart together with a seeded choice of full ones, and their pieces packed like a
  residual; what comes out stays if it needs fewer sequences, or as many and leaves more room in the emptiest.  REPAIRS times.

The plan is a short table: a pattern, how often, and which ranks of each length go where.  Pieces of a length are ranked in
two steps (a count for each length and hash slice, then a rank in the slice), so a length that a third of all pieces share is
ranked by many tasks.

Defined cases: null text is empty and packs its end id alone; rows with a repeated or null doc_id are documents of their own; an
empty table gives no rows; a very long text is many pieces; ties go by doc_id, row and piece; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docloom.llm import common as c
from docloom.llm.tokens import default_vocabulary, encoder

SIZE = 1024
END = 2
#: Hash slices, at least, in which pieces of one length are ranked.
SLICES = 64
#: Best pairs (triples ...) of lengths for each sum, and the most lengths of a pattern: with a long piece, and without.
PAIRS, MOST = 8, (3, 6)
#: Gradient steps of a fit.
STEPS = 500
#: Attempts to pack sequences with room anew, and their seed.
REPAIRS, SEED = 200, 3


def _cut(path: str, end: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, special=True)
        for batch in batches:
            for a, b in c.pieces(batch["text"]):
                part = batch.slice(a, b - a)
                rows = []
                for key, doc, got in zip(part["doc_key"].to_pylist(), part["doc_id"].to_pylist(), enc(part["text"]), strict=True):
                    ids = np.r_[got.astype("<u4"), np.array([end], "<u4")]
                    bounds = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                    rows += [(key, doc, i, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())) for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False))]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_key", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


_PIECE = "doc_key long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str, end: int = END, size: int = SIZE) -> DataFrame:
    """(doc_key, doc_id, piece, start, length, ids_crc32); doc_key numbers the rows."""
    rows = docs.select(F.monotonically_increasing_id().alias("doc_key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(c.lean(_cut(vocabulary, end, size)), _PIECE)


def patterns(have: np.ndarray, size: int, pieces: int) -> list[tuple[int, ...]]:
    """Patterns of so many lengths that fill a sequence wholly."""
    lengths = np.flatnonzero(have)
    if pieces == 1:
        return [(size,)] if have[size] else []
    # the best multisets of pieces - 1 lengths for every sum, made from those of one less and one length more
    best: list[list[tuple[int, ...]]] = [[(x,)] if have[x] else [] for x in range(size + 1)]
    common = lengths[np.argsort(-have[lengths], kind="stable")]
    for _ in range(pieces - 2):
        longer: list[list[tuple[int, ...]]] = [[] for _ in range(size + 1)]
        for total in range(2, size + 1):
            found: dict[tuple[int, ...], None] = {}
            for x in common[common < total].tolist():
                for p in best[total - x]:
                    found[tuple(sorted((x, *p), reverse=True))] = None
                if len(found) >= PAIRS:
                    break
            longer[total] = list(found)[:PAIRS]
        best = longer
    found = {tuple(sorted((x, *p), reverse=True)) for x in lengths[lengths < size].tolist() for p in best[size - x]}
    return sorted((p for p in found if all(have[x] >= p.count(x) for x in p)), reverse=True)


def fit(have: np.ndarray, chosen: list[tuple[int, ...]], steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts that bring the patterns' use of each length closest to the histogram."""
    at = np.array([x for p in chosen for x in p])
    of = np.repeat(np.arange(len(chosen)), [len(p) for p in chosen])
    use = lambda x: np.bincount(at, x[of], len(have))
    back = lambda r: np.bincount(of, r[at], len(chosen))
    v = np.ones(len(chosen))
    for _ in range(20):  # the largest curvature, by power iteration
        v = back(use(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(chosen))
    pace = 1.0
    for _ in range(steps):
        new = np.maximum(0, y + back(have - use(y)) / (1.05 * top))
        nxt = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        y, x, pace = new + (pace - 1) / nxt * (new - x), new, nxt
    return x


def _filled(left: np.ndarray, room: int) -> list[int]:
    """What goes into ``room``: the longest length that fits, then into the rest, and so on."""
    out: list[int] = []
    left = left.copy()
    while room > 0 and len(fits := np.flatnonzero(left[: room + 1])):
        out.append(int(fits[-1]))
        left[out[-1]] -= 1
        room -= out[-1]
    return out


def _take(left: np.ndarray, out: Counter, p: tuple[int, ...], most: int | None = None) -> None:
    times = min(int(left[x]) // p.count(x) for x in p)
    times = times if most is None else min(times, most)
    if times > 0:
        out[p] += times
        for x in p:
            left[x] -= times


def _residual(left: np.ndarray, out: Counter, size: int, least: int = 0) -> None:
    """Packs what is left of lengths above ``least``, with shorter ones, into ``out``."""
    for x in np.flatnonzero(left)[::-1].tolist():
        while x > least and left[x]:
            left[x] -= 1
            more = _filled(left, size - x)
            left[x] += 1
            _take(left, out, tuple(sorted((x, *more), reverse=True)))


def _repaired(planned: Counter, size: int, rng: np.random.Generator) -> Counter:
    """Some sequences packed anew, if that is better."""
    full = [p for p in planned if sum(p) == size and len(p) > 1]
    open_ = [p for p in planned if sum(p) < size]
    wanted = sum(planned[p] for p in open_)
    if not wanted:
        return planned
    chosen = Counter({p: planned[p] for p in open_})
    spare = int(wanted * rng.uniform(0.5, 8)) + 1
    for j in rng.permutation(len(full)).tolist():
        chosen[full[j]] = min(planned[full[j]], spare)
        spare -= chosen[full[j]]
        if spare <= 0:
            break
    left = np.zeros(size + 1, np.int64)
    for p, times in chosen.items():
        for x in p:
            left[x] += times
    new: Counter = Counter()
    _residual(left, new, size)
    worth = lambda c: (-sum(c.values()), sum(t * (size - sum(p)) ** 2 for p, t in c.items()))
    return planned - chosen + new if worth(new) > worth(chosen) else planned


def plan(have: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, times) that use up the histogram (index: length) exactly, in as few sequences as it can."""
    left, out = have.copy(), Counter()
    for least, most in zip((size // 2, 0), MOST, strict=True):  # a pattern's longest piece is longer than ``least``
        for pieces in range(1, most + 1):
            chosen = [p for p in patterns(left, size, pieces) if p[0] > least]
            counts = np.rint(fit(left, chosen)) if chosen else np.zeros(0)
            for j in np.argsort(-counts, kind="stable").tolist():
                _take(left, out, chosen[j], int(counts[j]))
        _residual(left, out, size, least)
    rng = np.random.default_rng(SEED)
    for _ in range(REPAIRS):
        out = _repaired(out, size, rng)
    return list(out.items())


def slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, ranks in a sequence, first offset): where pieces of a length go."""
    taken, out, sequence = Counter(), [], 0
    for pattern, times in planned:
        offset = 0
        for x, n in sorted(Counter(pattern).items(), reverse=True):
            out.append((x, taken[x], n * times, sequence, n, offset))
            taken[x] += n * times
            offset += n * x
        sequence += times
    return out


def _place(table: list[tuple[int, int, int, int, int, int]]):
    by_length: dict[int, np.ndarray] = {}
    for x in sorted({r[0] for r in table}):
        by_length[x] = np.array([r[1:] for r in table if r[0] == x], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[x].to_numpy() for x in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at, t = np.flatnonzero(length == x), by_length[int(x)]
                row = t[np.searchsorted(t[:, 0], rank[at], "right") - 1]
                inside = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + inside // row[:, 3]
                offset[at] = row[:, 4] + inside % row[:, 3] * x
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, end: int = END, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of docs(doc_id, text)."""
    cut = c.checkpointed(cut_pieces(docs, vocabulary or default_vocabulary(), end, size).withColumn("slice", F.pmod(F.xxhash64("doc_key", "piece"), F.lit(max(SLICES, c.buckets(docs))))))
    counts = cut.groupBy("length", "slice").count()
    have = np.zeros(size + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most ``size`` rows
        have[row["length"]] = row["n"]
    before = counts.select("length", "slice", (F.sum("count").over(Window.partitionBy("length").orderBy("slice")) - F.col("count")).alias("before"))
    ranked = cut.join(before, ["length", "slice"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "doc_key", "piece")) - 1)
    return ranked.mapInArrow(c.lean(_place(slots(plan(have, size)))), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack the whole documents table."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
