"""Sets of word shingles, as sorted 64-bit hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from broadsheet.llm.hashing import LETTERS, chunks, gram_hashes, hash_words

_BYTES = np.arange(256, dtype=np.uint8)
#: Words are runs of bytes other than [\x20\x09-\x0D].
IN_WORD = ~((_BYTES == 0x20) | (_BYTES >= 0x09) & (_BYTES <= 0x0D))


def sets_of(texts: pa.Array, k: int, key: int = 0) -> Iterator[tuple[int, bytes | None, np.ndarray]]:
    """(row, digest, tokens) of every text: its distinct shingles of k words, sorted, and 128 bits that name the set.

    A text of fewer words has one shingle, one without words none and no digest. A-Z are lower-cased.
    """
    for low, high, data, bounds in chunks(texts):
        words, begins = hash_words(data, bounds, IN_WORD, LETTERS, key)
        grams = gram_hashes(words, k)
        for row in range(high - low):
            first, last = int(begins[row]), int(begins[row + 1])
            if last - first >= k:
                tokens = np.unique(grams[first : last - k + 1])
            elif last > first:
                # its length is part of it, so that it is not taken for a longer one
                tokens = gram_hashes(words[first:last], last - first) + np.uint64(last - first)
            else:
                tokens = np.zeros(0, np.uint64)
            yield low + row, hashlib.blake2b(tokens, digest_size=16).digest() if len(tokens) else None, tokens
