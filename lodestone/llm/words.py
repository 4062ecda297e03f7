"""Hashes of all words of many texts at once, over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

BASE, SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: What keeps the first bytes, 0 to 8, of a little-endian block.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_classes(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)])


#: Words are what stands between ASCII white space.
SPACED = byte_classes(lambda b: b != 0x20 and not 9 <= b <= 0x0D)
#: Words are letters and digits, and all beyond ASCII.
ALPHANUMERIC = byte_classes(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def words_of(texts: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, A-Z folded, where each word starts and ends in them, and for each text the index of its first word (and the end of all)."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    folded = FOLD[raw]
    inside = classes[folded]
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    before = np.concatenate([[False], inside[:-1]]) & ~cut[:-1] if len(raw) else inside
    after = np.concatenate([inside[1:], [False]]) & ~cut[1:] if len(raw) else inside
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return folded, starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: chained over blocks of eight, each round a mixing bijection of the block."""
    blocks = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    left = ends - starts
    hashes = mix(left.astype(np.uint64) ^ SEED)
    at, live = starts, np.arange(len(starts))
    for _ in range(0, LONG_WORD, 8):
        hashes[live] = mix((hashes[live] ^ (blocks[at] & MASKS[np.minimum(left, 8)])) * BASE)
        more = left > 8
        at, left, live = at[more] + 8, left[more] - 8, live[more]
        if not len(live):
            return hashes
    for i in live.tolist():
        hashes[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes


def word_hashes(texts: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z folded, and for each text the index of its first word (and the end of all)."""
    data, starts, ends, first = words_of(texts, classes)
    return span_hashes(data, starts, ends), first


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` consecutive words from each word on; the last size - 1 are missing."""
    count = max(0, len(hashes) - size + 1)
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total = mix(total * BASE + hashes[k : k + count])
    return total


def phrase(words: str, classes: np.ndarray = ALPHANUMERIC) -> np.ndarray:
    return word_hashes(pa.array([words]), classes)[0]
