"""Words and n-grams of Arrow text columns as 64-bit hashes, with numpy, inside tasks.

A word is a run of digits, letters after lower-casing A-Z, and bytes of characters beyond ASCII, as in the JVM-side
columns. The hash of a run of bytes is a difference of prefix sums, so all words of a batch are hashed at once. About
32 bytes of memory are used per byte of text in hand: batches are cut into parts of PART bytes, and only a text that is
longer itself makes a larger part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PART = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTES = np.arange(256)
_FOLDED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
_IS_WORD = (_BYTES >= 128) | ((_FOLDED >= 97) & (_FOLDED <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57))
#: A fixed random number per byte.
_NUMBERS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)[_FOLDED]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit number stirred, one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, PART + 1)
            for name, base in (("up", _BASE), ("down", _BACK)):
                values = np.full(size, base, np.uint64)
                values[0] = 1
                setattr(cls, name, np.multiply.accumulate(values))
        return cls.up, cls.down


@dataclass
class Words:
    """Words of consecutive texts. first: index of the first text; doc: text of each word, from 0; hash: its hash."""

    first: int
    n_texts: int
    doc: np.ndarray
    hash: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sums: np.ndarray

    def bounds(self) -> np.ndarray:
        """Index of the first word of each text, and the number of words at the end."""
        return np.searchsorted(self.doc, np.arange(self.n_texts + 1))

    def prefixes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of the first bytes of all words longer than that."""
        long = np.flatnonzero(self.ends - self.starts > length)
        at = self.starts[long]
        _, down = _Powers.to(len(self.sums))
        return long, mixed((self.sums[at + length] - self.sums[at]) * down[at] + np.uint64(length))

    def runs(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; the last n - 1 words of a text give values that span texts."""
        return runs_of(self.hash, n)


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    last = len(hashes) - n + 1
    out = hashes[:last]
    for k in range(1, n):
        out = mixed(out * _BASE + hashes[k : last + k])
    return out


def parts_of(texts: pa.Array, part: int = PART) -> Iterator[Words]:
    """Words of a text column, in parts of at most `part` bytes or one text. NULL counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string()) if texts.null_count or texts.type != pa.large_string() else texts
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        stop = int(np.searchsorted(offsets, offsets[first] + part, side="right")) - 1
        stop = min(max(stop, first + 1), len(texts))
        yield _words(first, data[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first])
        first = stop


def _words(first: int, data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    up, down = _Powers.to(n + 1)
    word = _IS_WORD[data]
    # A text's first byte starts anew even where the text before it ends in a word.
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    start = word.copy()
    if n:
        start[1:] &= ~word[:-1] | fresh[1:-1]
    stop = np.zeros(n + 1, bool)
    stop[1:] = word
    stop[:n] &= ~word | fresh[:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_NUMBERS[data] * up[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(first, len(offsets) - 1, doc, hashes, starts, ends, sums)
