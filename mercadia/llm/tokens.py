"""Words and word n-grams of many texts at once, as numpy arrays, inside a task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = 0x9E3779B97F4A7C15 | 1
_SPACE = frozenset(b"\x20\x09\x0a\x0b\x0c\x0d")


def byte_values(lower: bool, alnum: bool) -> np.ndarray:
    """Per byte: 0 for a separator, else a number for the hash. alnum: ASCII letters, digits and all other scripts."""
    out = np.zeros(256, np.uint64)
    for b in range(256):
        c = b + 32 if lower and 65 <= b <= 90 else b
        word = (b >= 128 or bytes([c]).isalnum()) if alnum else b not in _SPACE
        out[b] = c + 1 if word else 0
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits (the one of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            more = max(n, 1 << 20)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(more - 1, _ODD, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(more - 1, pow(_ODD, -1, 1 << 64), np.uint64)])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _running(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values times rising powers; the hash of a range is the difference times the inverse power of its start."""
    up, down = _powers.get(len(values) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:-1]))), down


@dataclass
class Words:
    """The words of several texts: byte ranges in the texts joined by line ends, hashes, and the first word of each text
    (one entry more than texts)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on, over text ends too; the last n - 1 words have none."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64)
        run, down = _running(self.hash)
        return mix((run[n:] - run[:-n]) * down[: len(run) - n])

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each word on are of one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, bool)
        doc = self.doc
        return doc[:m] == doc[n - 1 :]


def words(texts: list[bytes], values: np.ndarray) -> Words:
    """Words of all texts. Bytes are looked at in pieces of about a megabyte, so memory goes with the number of words."""
    starts, ends, hashes, at, offset = [], [], [], [0], 0
    for low, high in chunks(texts):
        v = values[np.frombuffer(b"\n".join(texts[low:high]) + b"\n", np.uint8)]
        inside = v != 0
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.r_[0, edges]
        start, end = edges[0::2], edges[1::2]
        run, down = _running(v)
        hashes.append(mix((run[end] - run[start]) * down[start]))
        starts.append(start + offset)
        ends.append(end + offset)
        offset += len(v)
    for t in texts:
        at.append(at[-1] + len(t) + 1)
    start, end, hash_ = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((starts, np.int64), (ends, np.int64), (hashes, np.uint64)))
    return Words(start, end, hash_, np.searchsorted(start, at))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n successive values, by doubling."""
    if len(x) < n:
        return x[:0]
    width = 1
    while width < n:
        step = min(width, n - width)
        x = np.minimum(x[:-step], x[step:])
        width += step
    return x


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` bytes each; a longer text stands alone and whole."""
    begin = total = 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t) > size:
            yield begin, i
            begin, total = i, 0
        total += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def text_chunks(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows with about ``size`` bytes of text, and their texts as UTF-8; only one range at a time is unpacked."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = 0
    while begin < len(lengths):
        end = max(begin + 1, int(np.searchsorted(np.cumsum(lengths[begin:]), size, "right")) + begin)
        yield begin, end, utf8(column.slice(begin, end - begin))
        begin = end


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true, as (start, end)."""
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))
