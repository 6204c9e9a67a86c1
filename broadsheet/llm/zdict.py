"""Two kinds of text told apart by how well zstandard dictionaries of either kind compress them.

Each dictionary is made from windows of its own kind alone, by zstandard's own trainer, which picks the
segments that most samples have. Two measures are made from them:

* `distances` looks at each window by itself. The dictionary of kind 0 is ordinary text; that of kind 1
  is laid in front of it, so that what both explain costs the same bytes and only what ordinary text
  lacks comes out shorter. Windows that are shorter by each of STEPS bytes or more are counted, and the
  fit calibrates what those counts mean.
* `sizes` takes the compressed sizes of the whole text under either dictionary, and their normalised
  difference alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import zstandard

#: Bytes of a window at most.
WINDOW = 64
#: Bytes by which a window must be shorter, one count for each.
STEPS = (1, 2, 3, 4, 6)


def words(text: str) -> bytes:
    """Lower-cased words, one space around each."""
    return f" {' '.join(re.findall(r'\w+', text.lower()))} ".encode()


def raw(text: str) -> bytes:
    """The text with single spaces."""
    return f" {' '.join(text.split())} ".encode()


NORMAL: dict[str, Callable[[str], bytes]] = {"words": words, "raw": raw}
_WINDOW = re.compile(rb"(?s) .{1,%d}(?= )| ?[^ ]{1,%d}" % (WINDOW - 1, WINDOW - 1))


def windows(normal: bytes) -> list[bytes]:
    """The whole text in windows that end between words, but inside a word that is longer than a window.

    Every byte but the last space is in one, and none has more than WINDOW bytes.
    """
    return _WINDOW.findall(normal)


def digest(normal: bytes) -> bytes:
    return hashlib.blake2b(normal, digest_size=8).digest()


def teaches(normal: bytes, fifths: int) -> bool:
    """Whether a labelled text is among the fifths that go into the dictionaries; the rest calibrates. Copies stay together."""
    return digest(normal)[0] % 5 >= 5 - fifths


def trained(pieces: Sequence[bytes], size: int, segment: int) -> bytes:
    """A dictionary by zstandard's trainer, of segments of so many bytes; the windows themselves if they are too few for it."""
    whole = b"".join(pieces)
    try:
        return zstandard.train_dictionary(min(size, max(len(whole), 1)), list(pieces), k=segment, d=8).as_bytes()
    except zstandard.ZstdError:
        return whole[-size:]


@dataclass(frozen=True)
class Model:
    """Two dictionaries, what is measured with them, and the calibration of it."""

    normal: str
    measure: str
    zero: bytes
    one: bytes
    weights: tuple[float, ...] = ()


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """A compressor of short windows that finds every place of the dictionary; frames bear no header."""
    log = max(17, min(22, len(dictionary).bit_length()))
    parameters = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, strategy=zstandard.STRATEGY_GREEDY, min_match=5, window_log=log + 1, hash_log=log, chain_log=log, search_log=4
    )
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    data.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters)


_KEPT: dict[tuple[str, bytes, bytes], tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]] = {}


def compressors(measure: str, zero: bytes, one: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    """Once for each worker and model. A worker outlives its job, and so keeps none but the last, which goes before another is made: a pair of toxicity takes some 50 MB."""
    key = (measure, zero, one)
    if key not in _KEPT:
        _KEPT.clear()
        if measure == "distances":  # what stands in for the other dictionary is found in no text
            _KEPT[key] = compressor(bytes(len(one)) + zero), compressor(one.replace(b"\x37\xa4\x30\xec", bytes(4), 1) + zero)
        else:
            _KEPT[key] = compressor(zero), compressor(one)
    return _KEPT[key]


def distances(model: Model, normal: bytes) -> list[float]:
    """For each of STEPS the windows that the dictionary of kind 1 makes so much shorter: per window, and as a logarithm."""
    a, b = (c.compress for c in compressors("distances", model.zero, model.one))
    pieces = windows(normal)
    least = STEPS[0]
    saved = [d for w in pieces if (d := len(a(w)) - len(b(w))) >= least]
    counts = [sum(d >= step for d in saved) for step in STEPS]
    n = max(len(pieces), 1)
    return [*(10 * c / n for c in counts), *map(math.log1p, counts), 1.0]


def sizes(model: Model, normal: bytes) -> list[float]:
    """The difference of the compressed sizes over their sum, in per cent; nothing for a text without words."""
    a, b = (c.compress for c in compressors("sizes", model.zero, model.one))
    under_zero = under_one = 0
    for w in windows(normal):
        under_zero += len(a(w))
        under_one += len(b(w))
    return [100 * (under_zero - under_one) / max(under_zero + under_one, 1), 1.0]


MEASURES: dict[str, Callable[[Model, bytes], list[float]]] = {"distances": distances, "sizes": sizes}


def logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Newton's method, shrunk a little; the last column is the constant. each: weight of a row."""
    w, shrink = np.zeros(x.shape[1]), ridge * each.sum() * np.r_[np.ones(x.shape[1] - 1), 1e-9]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * each) + shrink * w
        h = (x * (p * (1 - p) * each + 1e-6)[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrated(model: Model, measured: Sequence[Sequence[float]], labels: Sequence[int], shares: tuple[float, float], prior: float) -> Model:
    """The model with weights for what was measured of texts that its dictionaries have not seen.

    shares: how many of each label there are where the texts come from. With one kind of label only, or
    none, the score is the same for all texts: the share of label 1, `prior` counting as one row.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + prior) / (len(y) + 1)
        n = len(MEASURES[model.measure](model, b"  "))
        return Model(model.normal, model.measure, model.zero, model.one, (0.0,) * (n - 1) + (math.log(share / (1 - share)),))
    each = np.ones(len(y))
    if min(shares) > 0:
        of_ones = shares[1] / sum(shares)
        each = np.where(y == 1, of_ones / y.mean(), (1 - of_ones) / (1 - y.mean()))
    return Model(model.normal, model.measure, model.zero, model.one, tuple(map(float, logistic(np.array(measured), y, each))))


def score(model: Model, text: str | None) -> float:
    """Between 0 and 1, higher where label 1 is likelier. A null text counts as empty."""
    x = MEASURES[model.measure](model, NORMAL[model.normal](text or ""))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, model.weights, strict=True))))))
