"""Word splitting and 64-bit hashes of word windows, vectorised over blocks of documents."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import xxhash

#: Words held in one block of documents; bounds the memory of the vectorised steps.
BLOCK_WORDS = 100_000
#: Distinct words remembered between blocks.
CACHE_WORDS = 200_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xD1342543DE82EF95)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class WordPairs(dict):
    """word (bytes) -> two independent 64-bit hashes, filled on demand."""

    def __init__(self):
        self.low, self.high = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        both, n = xxhash.xxh3_128_intdigest(word), len(self)
        self.low.append(both & (1 << 64) - 1)
        self.high.append(both >> 64)
        self[word] = n
        return n

    def arrays(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.low, self.high = array("Q"), array("Q")
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return np.array(self.low, np.uint64)[at], np.array(self.high, np.uint64)[at]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def window_hashes(words: np.ndarray, size: int, odd: np.uint64 = _ODD) -> np.ndarray:
    """Hash of every ``size`` consecutive words; entry i belongs to words[i : i + size]."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for j in range(1, size):
            h *= odd
            h += words[j : j + n]
        return mixed(h + np.uint64(size))


def window_pairs(words: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes (128 bits) of every ``size`` consecutive words, from ``WordPairs``."""
    return window_hashes(words[0], size), window_hashes(words[1], size, _ODD2)


def text_bytes(column) -> Iterator[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty, without decoding."""
    import pyarrow as pa

    for x in column.cast(pa.large_binary()) if hasattr(column, "cast") else column:
        yield x.as_py() or b""


def blocks(texts, lower: bool) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Groups of consecutive documents as word lists; words are runs without ASCII white space."""
    first, held, n = 0, [], 0
    for text in texts:
        words = (text.lower() if lower else text).split()
        held.append(words)
        n += len(words)
        if n >= BLOCK_WORDS:
            yield first, held
            first, held, n = first + len(held), [], 0
    if held:
        yield first, held
