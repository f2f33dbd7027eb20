"""Words, word hashes and shingles of one text, with bounded working memory."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import xxhash

#: ASCII white space: what ends a word `[^\x20\x09-\x0D]+`.  bytes.split() and
#: bytes.lower() use exactly this set and exactly A-Z.
SPACE = b" \t\n\v\f\r"
BLOCK = 1 << 20

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


#: Python workers of one application share a hash seed, which Spark sets, so the
#: built-in hash of bytes is the same in all of them; elsewhere it is not.
SEEDED = os.environ.get("PYTHONHASHSEED", "").isdigit()


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every word."""
    if SEEDED:
        return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def blocks(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """Cut `data` at white space into pieces of about `size` bytes."""
    start = 0
    while len(data) - start > size:
        cut = start + size
        while cut < len(data) and data[cut] not in SPACE:
            cut += 1
        yield data[start:cut]
        start = cut
    yield data[start:] if start else data


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """64-bit hash of every word, in order."""
    parts = []
    for piece in blocks(data):
        found = (piece.lower() if lower else piece).split()
        parts.append(hashed(found))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def line_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and how many each line has."""
    if len(data) > BLOCK:
        return word_hashes(data, lower=True), np.array([sum(len(b.split()) for b in blocks(line)) for line in data.split(b"\n")])
    found, counts = [], []
    for line in data.lower().split(b"\n"):
        words = line.split()
        counts.append(len(words))
        found += words
    return hashed(found), np.array(counts)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (Murmur3's finaliser)."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def windows(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of each window of `size` (at most five) words; with fewer words,
    of the whole sequence as one; none without words."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    count = len(hashes) - size + 1
    total = np.full(count, np.uint64(size), np.uint64)
    hashes = mixed(hashes)
    for k in range(size):
        total += hashes[k : k + count] * _ODD[k]
    return mixed(total)
