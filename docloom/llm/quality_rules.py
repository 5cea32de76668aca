"""Quality rules as a short-circuit cascade.

Measures that a result shows (words, characters, symbols, repeated lines, repeated words) are made for every document.  The
verdict is a conjunction of rules, each of which rejects on evidence of its own.  On a sample of at most SAMPLE documents (and SAMPLE_BYTES)
each rule's cost (seconds a character) is measured, and the order is found step by step: of the documents that neither the base nor the
rules so far reject, the next rule is the one that rejects most for its cost.  A document goes on to a rule only if none before has
rejected it.  The order changes the work, never the verdict.

One pass, no shuffle: rows stay in their partitions.

Defined cases: null text has no words, so base_failed; equal rows have equal results; a line that holds no word is never a
repeated line; an empty table gives no rows; repeated and null ids are judged row by row; a very long text is judged whole, alone in
its piece; other columns are ignored (``keep_good`` returns them, whatever their names).
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm import common as c

SAMPLE, SAMPLE_BYTES = 400, 16 << 20
WINDOW = 8
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[[ord(x) for x in "#*$%&|<>"]] = 1


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    data, offsets = c.text_bytes(texts)
    starts, ends, n_words = c.word_spans(data, offsets)
    first = np.r_[0, np.cumsum(n_words)]
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    in_words = np.r_[0, np.cumsum(points[ends] - points[starts])] if len(starts) else np.zeros(1, np.int64)
    symbols = np.r_[0, np.cumsum(_SYMBOLS[data])]
    # windows that occur again in their text
    h = c.grams(c.word_hashes(data, starts, ends), WINDOW, 3)
    doc = np.repeat(np.arange(len(n_words)), n_words)[: len(h)]
    inside = np.flatnonzero(np.arange(len(h)) + WINDOW <= first[doc + 1])
    key = h[inside] ^ c.mix(doc[inside].astype(np.uint64))
    order, new = c.groups(key)
    size = np.diff(np.r_[new, len(key)])
    again = inside[order[np.repeat(size > 1, size)]]
    cover = np.bincount(again, minlength=len(starts) + 1)[: len(starts) + 1] - np.bincount(again + WINDOW, minlength=len(starts) + 1)[: len(starts) + 1]
    covered = np.r_[0, np.cumsum(np.cumsum(cover)[:-1] > 0)] if len(starts) else np.zeros(1, np.int64)
    return {
        "n_words": n_words,
        "word_chars": in_words[first[1:]] - in_words[first[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.array([_repeated_lines(t) for t in texts.to_pylist()], np.int64),
        "n_repeat_words": covered[first[1:]] - covered[first[:-1]],
    }


def _repeated_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = text.split("\n")
    seen = Counter(lines)
    if len(seen) == len(lines):
        return 0
    return sum(n - 1 for x, n in seen.items() if n > 1 and x.strip(" \t\n\r\x0b\x0c"))


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


_SHOUT = re.compile(r"!{2,}|\?{2,}")
_LETTER = re.compile(r"[^\W\d_]")


class Page:
    """A text, its measures, and its words, which are made once if a rule asks for them."""

    def __init__(self, text: str, measured: dict[str, int]):
        self.text, self.m = text, measured

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "replace").split()


def _symbols(p: Page) -> bool:
    return 10 * p.m["n_symbols"] > 3 * p.m["n_words"]


def _word_length(p: Page) -> bool:
    return not 2 * p.m["n_words"] <= p.m["word_chars"] <= 20 * p.m["n_words"]


def _lines(p: Page) -> bool:
    return p.m["n_dup_lines"] >= 3 and 10 * p.m["n_dup_lines"] > 3 * (p.text.count("\n") + 1)


def _shouting(p: Page) -> bool:
    return 10 * len(_SHOUT.findall(p.text)) > 2 * p.m["n_words"]


def _capitals(p: Page) -> bool:
    upper, lower = sum(map(str.isupper, p.text)), sum(map(str.islower, p.text))
    return upper > lower


def _letters(p: Page) -> bool:
    return 2 * len(_LETTER.findall(p.text)) < p.m["word_chars"]


def _one_word(p: Page) -> bool:
    return bool(p.words) and 10 * max(Counter(p.words).values()) > 4 * len(p.words)


def _stutter(p: Page) -> bool:
    return 10 * sum(map(bytes.__eq__, p.words, p.words[1:])) > 3 * len(p.words)


#: Name and test of every rule; a test says whether it rejects.
RULES: dict[str, Callable[[Page], bool]] = {
    "symbols": _symbols, "word_length": _word_length, "repeated_lines": _lines, "shouting": _shouting, "capitals": _capitals, "letters": _letters, "one_word": _one_word, "stutter": _stutter,
}


def estimate(texts: list[str]) -> list[tuple[str, float, float]]:
    """(rule, seconds a character, share that it rejects of what is left) on a sample, in the order to run them."""
    found = measures(pa.array(texts, pa.string()))
    pages = [Page(texts[i], {k: int(v[i]) for k, v in found.items()}) for i in np.flatnonzero(~base_failed(found))]
    size = max(1, sum(len(p.text) for p in pages))
    costs, rejects = {}, {}
    for name, rule in RULES.items():
        began = time.perf_counter()
        rejects[name] = np.array([rule(Page(p.text, p.m)) for p in pages], bool)
        costs[name] = (time.perf_counter() - began) / size + 1e-12
    left, order = np.ones(len(pages), bool), []
    while len(order) < len(RULES):
        share = {n: (rejects[n] & left).sum() / max(1, left.sum()) for n in RULES if n not in {x[0] for x in order}}
        best = min(share, key=lambda n: (-(share[n] + 1e-4) / costs[n], n))
        order.append((best, costs[best], float(share[best])))
        left &= ~rejects[best]
    return order


def _apply(order: list[str], only_kept: bool, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in c.pieces(batch["text"]):
                part = batch.slice(a, b - a)
                m = measures(part["text"])
                failed = base_failed(m)
                kept = ~failed
                for i in np.flatnonzero(kept):
                    page = Page(part["text"][int(i)].as_py(), {k: int(v[i]) for k, v in m.items()})
                    kept[i] = not any(RULES[name](page) for name in order)
                if only_kept:
                    yield pa.RecordBatch.from_arrays([part[n].filter(pa.array(kept)) for n in columns], columns)
                else:
                    yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(v, pa.int64()) for v in m.values()), pa.array(failed), pa.array(kept)], ["doc_id", *m, "base_failed", "kept"])

    return run


def cascade(docs: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[str]:
    """The rules in the order that the sample suggests."""
    return [name for name, _, _ in estimate(c.sampled_texts(docs, sample, most_bytes))]


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, measures, base_failed, kept) for every row of docs(doc_id, text)."""
    names = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(c.lean(_apply(cascade(docs), False, [])), f"doc_id long, {names}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that no rule rejects, with their columns, whatever their names.

    A null or empty text is rejected; repeated rows are judged alike; an empty table stays empty.
    """
    return docs.mapInArrow(c.lean(_apply(cascade(docs), True, docs.columns)), docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge the whole documents table."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
i AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
k AS (SELECT i.doc_id, i.i, array_to_string(w[i.i : i.i + 7], ' ') AS k FROM i JOIN d ON d.doc_id = i.doc_id),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM k) WHERE n > 1),
repeats AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS j FROM again) GROUP BY 1),
most AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, word, count(*) AS n FROM words GROUP BY ALL) GROUP BY 1),
twice AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY j) AS was FROM words) WHERE word = was GROUP BY 1),
dup AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(lines) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY 1),
m AS (
  SELECT d.doc_id, t, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, coalesce(most.n, 0) AS most, coalesce(twice.n, 0) AS twice
  FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN repeats ON repeats.doc_id = d.doc_id LEFT JOIN most ON most.doc_id = d.doc_id LEFT JOIN twice ON twice.doc_id = d.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
  OR 10 * len(regexp_extract_all(t, '!{2,}|\?{2,}')) > 2 * n_words OR len(regexp_extract_all(t, '\p{Lu}')) > len(regexp_extract_all(t, '\p{Ll}')) OR 2 * len(regexp_extract_all(t, '[\p{L}\p{Nl}\p{No}]')) < word_chars OR 10 * most > 4 * n_words OR 10 * twice > 3 * n_words) AS kept
FROM b
"""


def brute(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) in plain Python (for tests)."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    windows = [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
    count = Counter(windows)
    mark = [False] * len(words)
    for i, w in enumerate(windows):
        if count[w] > 1:
            mark[i : i + WINDOW] = [True] * WINDOW
    n, r = len(words), sum(mark)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 20 or 100 * r > 30 * n
