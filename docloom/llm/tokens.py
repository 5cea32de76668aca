"""Token ids of whole texts, fast.

The library's encoder spends most of its time on words that it has met before.  Texts are cut where no token can span: before white
space that follows something else, and before an ASCII mark that follows a Latin letter.  The vocabulary's splitting never joins
the one to the other and never looks back, so a cut has the same ids alone as in its text.  Cuts are slices of the texts'
own bytes; equal ones of a piece are brought together by Arrow's dictionary, and only those that a worker hasn't met go to
the tokenizers library, many at a time.  The cache is bounded: beyond CACHE_CUTS it becomes the old one, from which cuts that
come up again are taken back, and the one before is dropped.

Added tokens (``<|endoftext|>``): the library takes them out of a text before it splits the rest, so a cut begins and ends at each
and none is inside.  With ``special`` the ids are those of the file's tokenizer as it is, which is what the queries use; without it
the content of a special token is encoded like any other text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from docloom.llm import common as c

#: Cuts that a Python worker remembers.
CACHE_CUTS = 500_000
#: Bytes that surely are white space, and those that may be.
_BEFORE = np.zeros(256, bool)
_BEFORE[[0x09, 0x0A, 0x0D, 0x20]] = True
_AFTER = np.zeros(256, bool)
_AFTER[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: Last three bytes of white space beyond ASCII; of two-byte characters, the last two.
_WIDE = np.array(sorted(int.from_bytes(chr(x).encode(), "big") for x in [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

_encoders: dict[tuple[str, bool], Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where cuts of texts begin; every text that isn't empty begins one."""
    edge = _BEFORE[data]
    edge[1:] &= ~_AFTER[data[:-1]]
    at = np.flatnonzero(edge)
    wide = at[(at > 2) & (data[at - 1] >= 0x80)]
    if len(wide):
        two = data[wide - 2].astype(np.int64) << 8 | data[wide - 1]
        white = np.isin(two, _WIDE) | np.isin(data[wide - 3].astype(np.int64) << 16 | two, _WIDE)
        edge[wide[white]] = False
    letter = _LETTER[data]
    # two-byte letters of Latin-1: all with this first byte but the signs of multiplication and division
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    edge[1:] |= letter[:-1] & _MARK[data[1:]]
    # with fewer than three bytes before it, white space is not told from other characters: no cut
    edge[:3] = False
    edge[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(edge)


class Encoder:
    """Encodes texts with a byte-level vocabulary file of the tokenizers library; ids come as little-endian bytes."""

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [x for x in self.tokenizer.get_added_tokens_decoder().values() if special or not x.special]
        # where several begin, the library takes the longest
        self.added = re.compile(b"|".join(re.escape(x) for x in sorted((x.content.encode() for x in added), key=len, reverse=True))) if added else None
        #: Whether a token is found by its content alone; if not, texts that hold one are not cut.
        self.plain = self.tokenizer.normalizer is None and len({x.normalized for x in added}) < 2 and not any(x.single_word or x.lstrip or x.rstrip for x in added)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, wanted: list[bytes]) -> None:
        if len(self.known) > CACHE_CUTS:
            self.known, self.old = {}, self.known
        new = [x for x in wanted if x not in self.known]
        if self.old:
            self.known.update((x, self.old[x]) for x in new if x in self.old)
            new = [x for x in new if x not in self.old]
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            found = self.tokenizer.encode_batch_fast([x.decode() for x in some], add_special_tokens=False)
            self.known.update((x, np.array(y.ids, self.kind).tobytes()) for x, y in zip(some, found, strict=True))

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """cuts(), but whole added tokens."""
        at, blob = cuts(data, offsets), data.tobytes()
        if self.added is None or not self.added.search(blob):
            return at
        bounds, spans = offsets.tolist(), []
        for a, b in zip(bounds, bounds[1:], strict=False):
            found = [x.span() for x in self.added.finditer(blob, a, b)]
            spans += found if self.plain or not found else [(a, b)]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        for a, b in spans:
            edge[a:b] = False
            edge[[a, b]] = True
        return np.flatnonzero(edge[:-1])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text."""
        data, offsets = c.text_bytes(texts)
        if not len(data):
            return [np.zeros(0, self.kind)] * len(texts)
        at = self._cuts(data, offsets)
        ends = np.r_[at, len(data)].astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        self._learn(distinct)
        blobs = [self.known[x] for x in distinct]
        ids = np.frombuffer(b"".join(blobs), self.kind)
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.width
        code = words.indices.to_numpy()
        n = size[code]
        stop = np.cumsum(n)
        # the i-th id of a cut is the i-th after its first in ``ids``
        out = ids[np.repeat((np.cumsum(size) - size)[code] - (stop - n), n) + np.arange(stop[-1])]
        bounds = np.r_[0, stop][np.searchsorted(at, offsets)].tolist()
        return [out[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def encoder(path: str, special: bool = False) -> Encoder:
    """special: special tokens' contents in texts become those tokens, as in the file's tokenizer unless it is told otherwise."""
    if (path, special) not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path, special] = Encoder(path, special)
    return _encoders[path, special]
