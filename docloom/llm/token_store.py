"""Token-id shards with a minimal perfect hash index.

Format.  A store is a folder of tables in Parquet, so any store that Spark can write holds it.  A row is a shard:

``shard`` (position in document order), ``n_docs``, ``n_tokens``, ``first_key``, ``last_key``; ``payload``: the raw ids of
all its documents after one another, little-endian, ``id_bytes`` each; ``keys``: its document keys; and ``index``: a minimal
perfect hash of these keys with, at each key's slot, a 32-bit fingerprint of the key, the document's first id in the payload and its number
of ids.

Index.  Levels of bit arrays, as in hash-and-retry perfect hashing: a key sets one bit of a level; keys that share a bit try
the next level, and the number of set bits before a key's bit is its slot.  With every 512 bits the number of set bits before
them is stored, so a lookup reads, for each level tried (1.6 on average, LEVELS at most), one bit, one stored number and at most 64 bytes, and then
one entry of each table: its cost doesn't depend on the number of keys.  The stored fingerprint finds out a key that isn't
there with probability 1 - 2**-32.  Keys left after the last level (about n / 2**LEVELS) are sorted, with their slots last.

Writing: rows are range-partitioned by document key and sorted, each partition is encoded and cut into shards; no
partition's texts or ids are gathered beyond one shard.  Row groups are about a shard, so ``fetch`` reads one shard's index and
payload by its key range.  ``lookup`` gives keys their shard by sorting both within ranges, asks the indexes for places alone,
and cuts the ids out of the payloads where they are.

Defined cases: null text is empty and has only the end id; rows with a repeated or null doc_id are documents of their own in
order of doc_id (nulls last) and text; an empty table gives an empty store; a text of more ids than a shard is a shard alone; other
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docloom.llm import common as c
from docloom.llm.tokens import default_vocabulary, encoder

END = 0
#: Ids after which a shard is full.
SHARD_IDS = 1 << 20
#: Bytes of a row group of a store's files: about a shard.
ROW_GROUP = 2 << 20
LEVELS = 24
#: Bits between stored numbers of set bits.
BLOCK = 512
_SHARD = "shard long, n_docs long, n_tokens long, first_key long, last_key long, id_bytes int, payload binary, keys binary, index binary"
_HEAD = struct.Struct("<4I")


def _hashes(keys: np.ndarray, level: int) -> np.ndarray:
    return c.mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0x632BE59BD9B4E019 & (2**64 - 1)))


def build_index(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Minimal perfect hash of distinct int64 keys with, for each, its fingerprint and columns (unsigned, 8 bytes each)."""
    left, levels, slots = np.arange(len(keys)), [], np.zeros(len(keys), np.int64)
    base = 0
    for level in range(LEVELS):
        if not len(left):
            break
        bits = -(-2 * len(left) // BLOCK) * BLOCK
        at = (_hashes(keys[left], level) % np.uint64(bits)).astype(np.int64)
        alone = np.bincount(at, minlength=bits) == 1
        won = alone[at]
        before = np.cumsum(alone) - alone
        slots[left[won]] = base + before[at[won]]
        levels.append((np.packbits(alone, bitorder="little"), (base + before[::BLOCK]).astype("<u4")))
        base += int(won.sum())
        left = left[~won]
    left = left[np.argsort(keys[left])]
    slots[left] = base + np.arange(len(left))
    prints = np.zeros(len(keys), "<u4")
    prints[slots] = _hashes(keys, 99) & np.uint64(0xFFFFFFFF)
    tables = [prints]
    for column in columns:
        tables.append(np.zeros(len(keys), "<u8"))
        tables[-1][slots] = column
    head = _HEAD.pack(len(keys), len(levels), len(left), len(columns)) + struct.pack(f"<{len(levels)}I", *[8 * len(x) for x, _ in levels])
    return head + keys[left].astype("<i8").tobytes() + b"".join(x.tobytes() + y.tobytes() for x, y in levels) + b"".join(t.tobytes() for t in tables)


class Index:
    """Reads what build_index() wrote, in place: making one reads the head alone."""

    def __init__(self, blob: bytes):
        self.n, n_levels, n_left, n_columns = _HEAD.unpack_from(blob)
        sizes = struct.unpack_from(f"<{n_levels}I", blob, _HEAD.size)
        at = _HEAD.size + 4 * n_levels
        self.left = np.frombuffer(blob, "<i8", n_left, at)
        at += 8 * n_left
        self.levels = []
        for size in sizes:
            self.levels.append((size, np.frombuffer(blob, np.uint8, size // 8, at), np.frombuffer(blob, "<u4", size // BLOCK, at + size // 8)))
            at += size // 8 + 4 * (size // BLOCK)
        self.prints = np.frombuffer(blob, "<u4", self.n, at)
        self.columns = [np.frombuffer(blob, "<u8", self.n, at + 4 * self.n + 8 * self.n * i) for i in range(n_columns)]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or some slot, or -1, for one that isn't there."""
        slot, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        inside = np.arange(BLOCK // 8)
        for level, (size, bits, before) in enumerate(self.levels):
            at = (_hashes(keys[todo], level) % np.uint64(size)).astype(np.int64)
            hit = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
            for some in np.array_split(np.flatnonzero(hit), hit.sum() // 65_536 + 1):  # 64 bytes for each, so not too many at once
                p = at[some]
                own = bits[(p // BLOCK * (BLOCK // 8))[:, None] + inside]
                byte = (p % BLOCK >> 3)[:, None]
                part = np.where(inside < byte, 0xFF, np.where(inside == byte, (1 << (p & 7)[:, None]) - 1, 0))
                slot[todo[some]] = before[p // BLOCK] + np.bitwise_count(own & part.astype(np.uint8)).sum(1)
            todo = todo[~hit]
        if len(self.left) and len(todo):
            at = np.minimum(np.searchsorted(self.left, keys[todo]), len(self.left) - 1)
            same = self.left[at] == keys[todo]
            slot[todo[same]] = self.n - len(self.left) + at[same]
        return slot

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(found, columns) for each key."""
        if not self.n:
            return np.zeros(len(keys), bool), [np.zeros(len(keys), np.uint64) for _ in self.columns]
        slot = self.slots(keys)
        found = (slot >= 0) & (self.prints[slot] == _hashes(keys, 99) & np.uint64(0xFFFFFFFF))
        return found, [x[np.where(found, slot, 0)] for x in self.columns]


def _encode(path: str, end: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path, special=True)
        task, made = TaskContext.get().partitionId(), 0
        keys, ids, total = [], [], 0

        def shard() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in ids], np.uint64)
            k = np.array(keys, np.int64)
            row = ((task << 32) + made, len(keys), int(sizes.sum()), keys[0], keys[-1], enc.width, np.concatenate(ids).tobytes(), c.small(np.r_[k[:1], np.diff(k)].astype(np.uint64)), build_index(k, np.cumsum(sizes) - sizes, sizes))
            kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.binary()] * 3
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [x.split()[0] for x in _SHARD.split(", ")])

        tail = np.array([end], f"<u{enc.width}")
        for batch in batches:
            for a, b in c.pieces(batch["text"]):
                part = batch.slice(a, b - a)
                for key, got in zip(part["doc_key"].to_pylist(), enc(part["text"]), strict=True):
                    if keys and total + len(got) + 1 > shard_ids:
                        yield shard()
                        keys, ids, total, made = [], [], 0, made + 1
                    keys.append(key)
                    ids.append(np.r_[got, tail])
                    total += len(got) + 1
        if keys:
            yield shard()

    return run


def write_store(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame | None:
    """Write docs(doc_id, text) as a store; returns (doc_key, doc_id), or None where doc_key is the doc_id."""
    rows, numbered = c.identified(docs)
    ordered = rows.select("doc_key", "text").repartitionByRange(c.buckets(rows), "doc_key").sortWithinPartitions("doc_key")
    ordered.mapInArrow(c.lean(_encode(vocabulary or default_vocabulary(), end, shard_ids)), _SHARD).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(folder)
    return rows.select("doc_key", "doc_id") if numbered else None


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, start): ids before each shard.  One small row for each shard (a million ids) is all that is ordered."""
    sizes = spark.read.parquet(folder).select("shard", "n_tokens")
    return sizes.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("before"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            keys = np.cumsum(c.large(row["keys"]), dtype=np.uint64).astype(np.int64)
            found, (at, size) = Index(row["index"])(keys)
            if not found.all():
                raise ValueError(f"shard {row['shard']}: the index misses a key")
            ids = np.frombuffer(row["payload"], f"<u{row['id_bytes']}").astype("<u4")
            at, size = at.astype(np.int64), size.astype(np.int64)
            crc = [zlib.crc32(ids[a : a + s].tobytes()) for a, s in zip(at, size, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row["shard"])), pa.array(keys), pa.array(at), pa.array(size), pa.array(crc, pa.int64())], ["of", "doc_key", "at", "n_tokens", "ids_crc32"])


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_key, start, n_tokens, ids_crc32) of all documents, each found through its shard's index.  Payloads stay where they are read."""
    found = spark.read.parquet(folder).select("shard", "id_bytes", "payload", "keys", "index").mapInArrow(c.lean(_read), "of long, doc_key long, at long, n_tokens long, ids_crc32 long")
    starts = shard_starts(spark, folder)
    return found.join(starts, found["of"] == starts["shard"]).select("doc_key", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            k = np.array(row["wanted"], np.int64)
            found, (at, size) = Index(row["index"])(k)
            columns = [np.full(found.sum(), row["shard"]), k[found], at[found].astype(np.int64), size[found].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["shard", "doc_key", "at", "size"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(x, f"<u{w}").astype(np.int32) for x, w in zip(batch["ids"].to_pylist(), batch["id_bytes"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_key"], pa.array(ids, pa.list_(pa.int32()))], ["doc_key", "ids"])


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(doc_key, ids array<int>) of keys(doc_key); keys that aren't there give no row, repeated and null ones count once and not at all.

    Keys and shards are sorted by (first) key within ranges of shards, and a key belongs to the last shard that begins before it; so
    nothing is compared with every shard.  Ranges begin where a shard does: about the square root of their number is
    collected.  Places come from the indexes alone; ids are cut out of the payloads where they are read.
    """
    shards = spark.read.parquet(folder)
    ranges = shards.select("shard", F.col("first_key").alias("doc_key"))
    n = max(1, int(shards.count() ** 0.5))
    begin = sorted({r["doc_key"] for r in ranges.filter(F.pmod(F.xxhash64("shard"), F.lit(n)) == 0).collect()})  # about sqrt(shards) longs
    both = ranges.unionByName(keys.select(F.col("doc_key").cast("long").alias("doc_key")).filter("doc_key is not null").distinct(), allowMissingColumns=True).withColumn("span", c.last_not_above(begin, F.col("doc_key")))
    last = F.last("shard", True).over(Window.partitionBy("span").orderBy("doc_key", F.col("shard").isNull()))
    routed = both.withColumn("of", last).filter("shard is null and of is not null").groupBy("of").agg(F.collect_list("doc_key").alias("wanted"))
    placed = shards.select("shard", "index").join(routed, F.col("shard") == F.col("of")).select("shard", "index", "wanted").mapInArrow(c.lean(_places), "shard long, doc_key long, at long, size long")
    cut = F.expr("substring(payload, int(at * id_bytes + 1), int(size * id_bytes))")
    ids = shards.select("shard", "id_bytes", "payload").join(placed, "shard").select("doc_key", "id_bytes", cut.alias("ids"))
    return ids.mapInArrow(c.lean(_unpack), "doc_key long, ids array<int>")


def fetch(spark: SparkSession, folder: str, key: int) -> np.ndarray | None:
    """The ids of one document.  Of the store's files, only row groups whose key range holds the key are read."""
    at = spark.read.parquet(folder).filter((F.col("first_key") <= key) & (F.col("last_key") >= key))
    row = at.select("index", "id_bytes").first()
    if row is None:
        return None
    found, (start, size) = Index(bytes(row["index"]))(np.array([key]))
    if not found[0]:
        return None
    width = row["id_bytes"]
    ids = at.select(F.expr(f"substring(payload, {int(start[0]) * width + 1}, {int(size[0]) * width})").alias("ids")).first()["ids"]
    return np.frombuffer(bytes(ids), f"<u{width}")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the whole documents table as a store, read it back, and return each document's place and checksum."""
    folder = c.new_folder(spark, "token-store")
    names = write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return c.named(read_store(spark, folder), names)
