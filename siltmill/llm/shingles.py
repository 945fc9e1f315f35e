"""Word shingles of whole batches of texts, as hashes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import xxhash

#: The longest runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Bits of a shingle's hash; the bits above hold the number of the text within its block.
HASH_BITS = 50
BLOCK = 1 << (64 - HASH_BITS)
HASH_MASK = np.uint64((1 << HASH_BITS) - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_KEPT_WORDS = 1 << 20


class _Vocabulary(dict):
    """Words to the place of their hash."""

    def __init__(self) -> None:
        self.hashes: list[int] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return at


class Shingler:
    """Hashes texts to sets of k-word sequences. Keeps the hashes of words seen, up to a fixed number."""

    def __init__(self, k: int) -> None:
        self.k = k
        self._seen = _Vocabulary()

    def sets(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(packed, size) of a block of texts: the number of a text and a shingle of it, ascending and distinct,
        in one unsigned number each, and the size of each text's set.

        One plain sort does for all texts of the block. A text of fewer than k words has no shingle.
        """
        if len(self._seen) > _KEPT_WORDS:
            self._seen = _Vocabulary()
        find = self._seen.__getitem__
        flat: list[int] = []
        lengths: list[int] = []
        for t in texts:
            words = WORD.findall(t.lower()) if t else ()
            lengths.append(len(words))
            flat.extend(map(find, words))
        n, k = len(lengths), self.k
        if n > BLOCK:
            raise ValueError("too many texts for a block")
        if len(flat) < k:
            return np.zeros(0, np.uint64), np.zeros(n, np.int64)
        w = np.array(self._seen.hashes, dtype=np.uint64)[np.array(flat, dtype=np.int64)]
        owner = np.repeat(np.arange(n, dtype=np.uint64), lengths)
        m = len(w) - k + 1
        h = w[:m].copy()
        for i in range(1, k):
            h = (h ^ (h >> np.uint64(29))) * _M1 + w[i : i + m]
        h = (h ^ (h >> np.uint64(32))) * _M2
        h ^= h >> np.uint64(29)
        whole = owner[:m] == owner[k - 1 :]
        packed = np.sort(((owner[:m] << np.uint64(HASH_BITS)) | (h & HASH_MASK))[whole])
        new = np.ones(len(packed), bool)
        new[1:] = packed[1:] != packed[:-1]
        packed = packed[new]
        return packed, np.bincount((packed >> np.uint64(HASH_BITS)).astype(np.int64), minlength=n)


def blocks(rows: Iterable, size: int = BLOCK) -> Iterator[list]:
    """Lists of at most ``size`` rows."""
    it = iter(rows)
    while part := list(islice(it, size)):
        yield part


def exact_set(text: str | None, k: int) -> set[tuple[str, ...]]:
    """The k-word sequences themselves."""
    words = WORD.findall(text.lower()) if text else []
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
