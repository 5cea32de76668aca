"""Shared pieces of the training-data operators.

Document identity
    Operators work on ``(doc_key, text)``.  ``doc_key`` is the doc_id itself when ids are unique and not
    null.  Otherwise (repeated or null ids) every row is a document of its own: rows are ordered by doc_id
    (nulls last), text and the other columns asked for, and numbered from 0 in that order, so ties have a defined,
    repeatable order and a row's number doesn't depend on how Spark cut the order into partitions.

Packed exchange
    Sequence operators shuffle very many small facts (a hash, a document, a position).  One SQL row for each
    would cost more in row overhead than in content, so a map task gathers facts (``gathered``: up to FLUSH at a time, over
    as many texts as it takes) and sends one row for each target bucket, with its facts in columns of minimal width.
    Buckets are chosen by hash of the content, stand for BUCKET_BYTES of text each, and are as many as the texts need; beyond
    MOST_TASKS of them a task works on several, one after another.

Hot content
    Equal content meets in one bucket, so operators settle among themselves what a map task has gathered and send one
    representative for what it found equal.  However many documents share a passage, its bucket gets at most a few facts from each
    flush, which is some 20 MB of text.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that one bucket of a packed exchange stands for.
BUCKET_BYTES = 16 << 20
#: Buckets beyond which a task has several.
MOST_TASKS = 1 << 15
#: Bytes of text that a batch function looks at together.
PIECE_BYTES = 4 << 20
#: Facts that a map task gathers before it sends them.
FLUSH = 1_000_000

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FAR_CODE = np.uint64(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# ---------------------------------------------------------------------------------------------- Spark side


def setting(spark: SparkSession, name: str) -> str | None:
    return spark.conf.get(name, None) or spark.sparkContext.getConf().get(name, None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints.  Without one, a temporary folder, if all executors are in this process."""
    named = setting(spark, "spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="docloom-")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the folder the session names."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def volume(rows: DataFrame) -> int:
    """Bytes of all texts, counted."""
    return rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def buckets(rows: DataFrame, size: int | None = None) -> int:
    """Buckets of a packed exchange of rows(text): the session's shuffle partitions, more for more text."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-volume(rows) // (size or BUCKET_BYTES)))


def give_memory_back() -> None:
    """What Python workers have freed goes back to the system: they live on after a task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to call
        pass


def lean(work):
    """A map function over batches that leaves no freed memory behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_memory_back()

    return run


def sampled_texts(docs: DataFrame, rows: int, most_bytes: int) -> list[str]:
    """Texts of at most ``rows`` rows of docs(text) and ``most_bytes`` bytes: those with the least hashes, so the same however the table is cut.

    Whole texts; one that would go beyond the bytes ends the sample (but the first always is in it).
    """
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select(F.xxhash64(text).alias("h"), F.octet_length(text).alias("size"), text.alias("text"))
    first = hashed.select("h", "size").orderBy("h").limit(rows).collect()  # two numbers a row
    fits = int(np.searchsorted(np.cumsum([r["size"] for r in first]), most_bytes, "right"))
    if not first:
        return []
    last = first[max(0, min(fits, len(first)) - 1)]["h"]
    return [r["text"] for r in hashed.filter(F.col("h") <= last).orderBy("h").limit(max(1, fits)).select("text").collect()]


def _one_by_one(work):
    """work() over each bucket's rows, which follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            key = batch["bucket"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if held and key[a] != now:
                        yield from work(iter(held))
                        held = []
                    now = key[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield from work(iter(held))

    return run


def in_buckets(facts: DataFrame, n: int, work, schema: str) -> DataFrame:
    """work(batches) over facts(bucket, ...), all rows of a bucket in one call."""
    if n <= MOST_TASKS:
        return facts.repartition(n, "bucket").mapInArrow(lean(work), schema)
    return facts.repartition(MOST_TASKS, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_one_by_one(work)), schema)


def last_not_above(bounds: list[int], value: Column) -> Column:
    """The place, from 0, of the last of ascending bounds that isn't above value; 0 for values below all.  A binary search without a join."""
    if len(bounds) < 2:
        return F.lit(0)
    table = F.expr(f"array({', '.join(f'{x}L' for x in bounds)})")
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def step(s: Column, _: Column) -> Column:
        below = F.get(table, middle(s)) <= value
        return F.struct(F.when(below, middle(s)).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(middle(s)).alias("hi"))

    turns = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), step, lambda s: s["lo"])


def _spark_int_hash(value: int) -> int:
    """Spark's hash() of one int column."""
    m = 0xFFFFFFFF
    k = (value & m) * 0xCC9E2D51 & m
    k = (k << 15 | k >> 17) & m
    k = k * 0x1B873593 & m
    h = 42 ^ k
    h = (h << 13 | h >> 19) & m
    h = (h * 5 + 0xE6546B64) & m
    h ^= 4
    h ^= h >> 16
    h = h * 0x85EBCA6B & m
    h ^= h >> 13
    h = h * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def even_keys(n: int) -> np.ndarray:
    """n ints; hash partitioning into n partitions puts the i-th alone into partition i.  Beyond MOST_TASKS just n ints."""
    if n > MOST_TASKS:
        return np.arange(n, dtype=np.int32)
    keys, left, k = np.full(n, -1, np.int32), n, 0
    while left:
        at = _spark_int_hash(k) % n
        if keys[at] < 0:
            keys[at], left = k, left - 1
        k += 1
    return keys


def identified(df: DataFrame, *more: Column) -> tuple[DataFrame, bool]:
    """(doc_key, doc_id, text, *more), and whether doc_key is a number of our own: see the module's docstring.  Null texts become empty."""
    kept = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
    odd = df.select("doc_id").groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if odd.isEmpty():
        return kept.filter("doc_id is not null").withColumn("doc_key", F.col("doc_id")), False
    rest = [F.to_json(F.struct(x)) for x in kept.columns[2:]]
    ordered = kept.orderBy(F.col("doc_id").asc_nulls_last(), "text", *rest)
    placed = checkpointed(ordered.withColumn("doc_key", F.monotonically_increasing_id()))  # partition << 33 | row in it
    part = F.shiftright("doc_key", 33).cast("int")
    start, before = 0, []
    for row in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row for each partition
        before.append((row["part"], start))
        start += row["count"]
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "in_part int, part_start long"))
    return placed.join(starts, part == starts["in_part"]).withColumn("doc_key", F.col("part_start") + F.col("doc_key").bitwiseAND((1 << 33) - 1)).select(*placed.columns), True


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one, so that none can clash with those of an operator."""
    return F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("whole_row")


def unpacked(df: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns that whole_row() put together, some of them changed."""
    return df.select(*[(changed[n] if n in changed else F.col("whole_row")[n]).alias(n) for n in names])


def documents(df: DataFrame, *more: Column) -> DataFrame:
    return identified(df, *more)[0]


def named(out: DataFrame, names: DataFrame | None) -> DataFrame:
    """``out`` with doc_id in place of doc_key; names: (doc_key, doc_id) where they differ."""
    return out.withColumnRenamed("doc_key", "doc_id") if names is None else names.join(out, "doc_key").drop("doc_key")


# --------------------------------------------------------------------------------------------- numpy side


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes after one another, and len + 1 offsets."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``most`` bytes; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, start, total = 0, 0, 0
    for at, size in enumerate(sizes):
        if at > start and total + size > most:
            yield start, at
            start, total = at, 0
        total += size
    if len(sizes):
        yield start, len(sizes)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of every text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for every word, from its bytes and their places."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    flat = np.arange(size.sum(), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
    part = BYTE_CODE[data[np.repeat(starts, size) + flat]]
    part *= PLACE_CODE[flat & 255]
    if size.max() > 256:
        part += (flat >> 8).astype(np.uint64) * FAR_CODE * part
    return mix(np.add.reduceat(part, np.cumsum(size) - size) + size.astype(np.uint64))


def grams(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of every n following words; the last n - 1 are missing."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    by = np.uint64((0xD6E8FEB86659FD93 + 2 * seed) & (2**64 - 1))
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out *= by
        out += words[j : len(words) - n + 1 + j]
    return mix(out)


_PACKER, _UNPACKER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def small(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, byte by byte, compressed if that pays."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    if len(planes) > 64:
        packed = _PACKER.compress(planes)
        if len(packed) < len(planes):
            return bytes([width | 0x80]) + packed
    return bytes([width]) + planes


def large(blob: bytes) -> np.ndarray:
    """What small() was given."""
    width = blob[0] & 0x7F
    planes = np.frombuffer(_UNPACKER.decompress(blob[1:]), np.uint8) if blob[0] & 0x80 else np.frombuffer(blob, np.uint8, offset=1)
    planes = planes.reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8") if len(out) else np.zeros(0, np.uint64)


def _rises(keys: np.ndarray, places: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Facts in order of (key, place) as gaps between keys, facts for each key, gaps between places."""
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    ids = keys[new].astype(np.uint64)
    gaps = np.diff(places, prepend=0)
    gaps[new] = places[new]
    return small(np.r_[ids[:1], ids[1:] - ids[:-1]]), small(np.diff(np.r_[new, len(keys)])), small(gaps)


def _unrises(ids: bytes, runs: bytes, gaps: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, n, gaps = np.cumsum(large(ids), dtype=np.uint64).astype(np.int64), large(runs).astype(np.int64), large(gaps).astype(np.int64)
    at = np.cumsum(gaps)
    firsts = np.cumsum(n) - n
    base = at[firsts] - gaps[firsts] if len(n) else at[:0]
    return np.repeat(keys, n), at - np.repeat(base, n)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


FACTS = "bucket int, keys binary, runs binary, places binary, more array<binary>"
_FACTS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("runs", pa.binary()), ("places", pa.binary()), ("more", pa.list_(pa.binary()))])


def gathered(parts: Iterator[tuple[np.ndarray, ...]], most: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of facts, the first of them keys, put together until there are ``most`` or no more, in order of key."""
    most, held, total = most or FLUSH, [], 0

    def together() -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        return tuple(columns) if (np.diff(order) == 1).all() else tuple(x[order] for x in columns)

    for part in parts:
        if len(part[0]):
            held.append(part)
            total += len(part[0])
            if total >= most:
                yield together()
                held, total = [], 0
    if held:
        yield together()


def send(to: np.ndarray, n: int, bucket_keys: np.ndarray, keys: np.ndarray, places: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each bucket.  Facts must be in order of (key, place)."""
    if not len(to):
        return
    order = np.argsort(to.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")
    found, starts = np.unique(to[order], return_index=True)
    rows = []
    for b, lo, hi in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        pick = order[lo:hi]
        rows.append((int(bucket_keys[b]), *_rises(keys[pick], places[pick]), [small(x[pick]) for x in more]))
    columns = list(zip(*rows, strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FACTS, strict=True)], schema=_FACTS)


def by_key(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets of documents."""
    return bucket_of(mix(keys.astype(np.uint64)), n)


def receive(batches: Iterator[pa.RecordBatch], *widths: int) -> list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """All facts of a bucket (keys, places, more), for each number of further columns asked for."""
    held = {w: ([], [], [[] for _ in range(w)]) for w in widths}
    for batch in batches:
        for row in batch.to_pylist():
            keys, places, more = held[len(row["more"])]
            k, p = _unrises(row["keys"], row["runs"], row["places"])
            keys.append(k)
            places.append(p)
            for out, blob in zip(more, row["more"], strict=True):
                out.append(large(blob))
    whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return [(whole(k, np.int64), whole(p, np.int64), [whole(x, np.uint64) for x in more]) for k, p, more in held.values()]


def classes(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """groups() of rows that are equal in all columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for x in columns:
        ranked = x[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(new)


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal values together, and where each value's run begins in it."""
    if len(values) < 1 << 32 and (not len(values) or int(values.max()) < 1 << 32):
        both = np.sort(values.astype(np.uint64) << np.uint64(32) | np.arange(len(values), dtype=np.uint64))
        order, ranked = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), both >> np.uint64(32)
    else:
        order = np.argsort(values, kind="stable")
        ranked = values[order]
    return order, np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(values) else np.zeros(0, np.int64)


def give_back(n: int, bucket_keys: np.ndarray, keys: np.ndarray, places: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Facts on their way back to documents: one row for each bucket of documents."""
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order]
    yield from send(by_key(keys, n), n, bucket_keys, keys, places, *(x[order] for x in more))


FOUND = "doc_key long, places binary, more array<binary>"
_FOUND = pa.schema([("doc_key", pa.int64()), ("places", pa.binary()), ("more", pa.list_(pa.binary()))])


def _merge(n_more: int, rows: int = 20_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ((keys, places, more),) = receive(batches, n_more)
        order = np.lexsort((places, keys))
        keys, places, more = keys[order], places[order], [x[order] for x in more]
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        ends = np.r_[new[1:], len(keys)]
        for at in range(0, len(new), rows):
            spans = list(zip(new[at : at + rows].tolist(), ends[at : at + rows].tolist(), strict=True))
            columns = keys[new[at : at + rows]], [small(np.diff(places[a:b], prepend=0)) for a, b in spans], [[small(x[a:b]) for x in more] for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    return run


def by_document(given: DataFrame, n: int, n_more: int = 0) -> DataFrame:
    """(doc_key, places, more): all that came back for a document, in one row."""
    return in_buckets(given, n, _merge(n_more), FOUND)


def places_of(blob: bytes) -> np.ndarray:
    return np.cumsum(large(blob).astype(np.int64))
