"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A text is a bag of words in lower case; a word is itself and its character n-grams (with marks for its ends), hashed into
``BUCKETS`` rows of an embedding table.  A word's vector is the mean of its rows, a text's the mean of its words', and a
softmax over the text's vector gives two probabilities.  Table and softmax are trained together by stochastic gradient steps, so
a misspelling that training never saw has most of its n-grams' rows from words that it did see.

Training fits on a bounded sample of labelled rows: at most SAMPLE toxic and 2 * SAMPLE other ones of those whose crc32 of the
doc_id's digits mod FOLDS isn't 0, by least hash of the doc_id, and of these as many as have SAMPLE_BYTES of text.  Labels are not used elsewhere; the score of a text depends on
the text alone.  The model has BUCKETS numbers once trained (the softmax applied to every row), whatever the input's size, and
goes to the executors as one broadcast; scoring is one pass without a shuffle.

Defined cases: null text is empty; an empty text has the score of the bias alone; equal texts have equal scores; labels with null
toxic or doc_id are not used; a doc_id that is labelled both ways is toxic, one with several texts gives its least text; a very long text is
scored whole; without labels of both classes every score is the share of toxic labels (0 if there are
none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm import common as c

BUCKETS = 1 << 17
DIM = 8
#: Passes over the sample: the least, the most, and steps that a small sample's passes should add up to.
EPOCHS, MOST_EPOCHS, STEPS = 6, 40, 30_000
SAMPLE, SAMPLE_BYTES = 2500, 48 << 20
FOLDS = 5
#: Words that a Python worker remembers.
CACHE_WORDS = 300_000
_WORD = re.compile(r"[^\W_]+")


def subwords(word: str) -> list[int]:
    """Rows of the table for a word: itself and its n-grams of 3 to 5 characters."""
    marked = f"<{word}>".encode("utf-8", "replace").decode("utf-8", "replace")
    parts = [marked, *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1) if n < len(marked))]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Bags:
    """Texts as unique rows of the table with weights that sum to 1."""

    def __init__(self) -> None:
        self.known: dict[str, np.ndarray] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = words(text)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        for w in set(found).difference(self.known):
            self.known[w] = np.array(subwords(w), np.int64)
        rows = [self.known[w] for w in found]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        at, back = np.unique(np.concatenate(rows), return_inverse=True)
        return at, np.bincount(back, np.repeat(1 / (size * len(rows)), size)).astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int | None = None, seed: int = 5) -> tuple[np.ndarray, float]:
    """(one number for each row of the table, bias): the difference of the two classes' logits."""
    epochs = epochs or min(MOST_EPOCHS, max(EPOCHS, STEPS // max(1, len(texts))))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    bag = _Bags()
    bags = [bag(t) for t in texts]
    # steps in proportion to a row's gradient history, so that rare n-grams learn as fast as common ones
    seen = np.full(BUCKETS, 1e-8, np.float32)
    seen_soft = np.full((DIM, 2), 1e-8, np.float32)
    for epoch in range(epochs):
        rate = 0.25 * (1 - epoch / epochs)
        for i in rng.permutation(len(texts)):
            rows, weight = bags[i]
            if not len(rows):
                continue
            own = table[rows]
            vector = weight @ own
            logit = vector @ soft + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g_soft = np.outer(vector, p)
            g_vector = soft @ p
            seen_soft += g_soft**2
            seen[rows] += weight**2 * float(g_vector @ g_vector)
            table[rows] = own - (rate * weight / np.sqrt(seen[rows]))[:, None] * g_vector
            soft -= rate * g_soft / np.sqrt(seen_soft)
            bias -= 0.05 * rate * p
    return table @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


def _score(model, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = model.value
        known: dict[str, float] = {}
        for batch in batches:
            logits = np.full(batch.num_rows, bias)
            for i, text in enumerate(batch["text"].to_pylist()):
                found = words(text)
                if not found:
                    continue
                if len(known) > CACHE_WORDS:
                    known.clear()
                for w in set(found).difference(known):
                    known[w] = float(values[subwords(w)].mean())
                logits[i] += sum(map(known.__getitem__, found)) / len(found)
            score = 1 / (1 + np.exp(-np.clip(logits, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Model from a bounded sample of labelled rows outside the held-out fold."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out())
    order = F.xxhash64("doc_id")
    picked = usable.filter("toxic = 1").orderBy(order, "doc_id").limit(sample).union(usable.filter("toxic = 0").orderBy(order, "doc_id").limit(2 * sample))
    chosen = {(r["doc_id"], r["toxic"]) for r in picked.collect()}
    if len({t for _, t in chosen}) < 2:
        share = min(max(np.mean([t for _, t in chosen]) if chosen else 0.0, 1e-9), 1 - 1e-9)
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    by_id = dict(sorted(chosen))
    ids = docs.sparkSession.createDataFrame([(d,) for d in by_id], "wanted long")  # at most 3 * sample longs
    found = docs.join(F.broadcast(ids), docs["doc_id"] == ids["wanted"]).groupBy("wanted").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = c.checkpointed(found.select("wanted", "text", F.xxhash64("wanted").alias("h"), F.octet_length("text").alias("size")))
    sizes = found.select("h", "wanted", "size").orderBy("h", "wanted").collect()  # three numbers a row
    fits = int(np.searchsorted(np.cumsum([r["size"] for r in sizes]), SAMPLE_BYTES, "right"))
    rows = [(r["wanted"], r["text"]) for r in found.orderBy("h", "wanted").limit(max(1, fits)).collect()]
    rows.sort()
    return train([t for _, t in rows], [by_id[d] for d, _ in rows])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    values, bias = fit(rows, labels, sample)
    model = docs.sparkSession.sparkContext.broadcast(values.astype(np.float32))
    marked = rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return marked.mapInArrow(c.lean(_score(model, bias)), "doc_id long, held_out boolean, score double, predicted int")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the whole documents table."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
