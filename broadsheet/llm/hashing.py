"""Hashes of words and word sequences, over whole Arrow columns at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer text goes by itself.
CHUNK = 1 << 21

_BYTES = np.arange(256, dtype=np.uint8)
#: What each byte counts for: A-Z as a-z.
LETTERS = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_BASE = 0x9E3779B97F4A7C15
#: Bytes of a word that are taken at a time, and after which the rest of it is hashed by itself.
_LANE, _LONG = 8, 256
_KEPT = np.array([(1 << (8 * i)) - 1 for i in range(_LANE)] + [(1 << 64) - 1], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def hash_words(data: np.ndarray, bounds: np.ndarray, in_word: np.ndarray, letters: np.ndarray, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in `data`, and where the words of each text begin.

    in_word: for each byte, whether words have it; letters: the byte it counts for. A word is taken eight
    bytes at a time, each stirred into the hash before the next; without the key nobody can tell which
    words would meet.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    here = in_word[data]
    before, after = np.empty_like(here), np.empty_like(here)
    before[1:], after[:-1] = here[:-1], here[1:]
    before[0] = after[-1] = False
    before[bounds[bounds < len(data)]] = False
    inner = bounds[(bounds > 0) & (bounds <= len(data))]
    after[inner - 1] = False
    start, end = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
    folded = np.zeros(len(data) + _LANE, np.uint8)
    folded[: len(data)] = letters[data]
    lanes = np.ndarray(len(data) + 1, "<u8", folded, strides=(1,))  # the eight bytes from each place on
    length = end - start
    h = mixed(length.astype(np.uint64) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))
    live, at = np.arange(len(start)), 0
    while len(live):
        left = length[live] - at
        lane = lanes[start[live] + at] & _KEPT[np.minimum(left, _LANE)]
        h[live] = mixed(h[live] ^ lane) + np.uint64(_BASE)
        live, at = live[left > _LANE], at + _LANE
        if at >= _LONG:
            for i in live.tolist():
                rest = hashlib.blake2b(folded[start[i] + at : end[i]], digest_size=8, key=int(h[i]).to_bytes(8, "little"))
                h[i] = int.from_bytes(rest.digest(), "little")
            break
    return mixed(h), np.searchsorted(start, bounds)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words, across the ends of texts too."""
    grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        grams = grams * np.uint64(_BASE) + words[j : j + len(grams)]
    return mixed(grams)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, bounds) of stretches of texts of about CHUNK bytes; a null is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + CHUNK, "right")) - 1)
        yield low, high, raw[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
        low = high
