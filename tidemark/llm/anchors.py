"""Minimizer anchors: where equal strings of a minimum length are sure to be noticed, whatever stands around them."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of the string that makes an anchor: a power of two.
GRAM = 32
_AT = 24
#: Bytes of text that are handled at once; positions have to fit in _AT bits.
CHUNK = 1 << 20


def anchors(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owned runs of the texts that lie end to end in data: text number, first start, number of starts, hash of the anchor.

    The anchor of a start is the leftmost of the smallest hashes of all GRAM-byte strings inside its `length` bytes. Starts with the
    same anchor follow one another: they are a run. Equal strings of `length` bytes have equal anchors, at the same distance.
    """
    window = length - GRAM + 1
    n = len(data)
    h = _BYTE[data]
    span = 1
    for step in _STEP[: GRAM.bit_length() - 1]:
        h = h[:-span] * step + h[span:]
        span *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    key = (h >> np.uint64(_AT)) << np.uint64(_AT) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= window:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if window > span:
        key = np.minimum(key[: len(key) - (window - span)], key[window - span :])
    owner = (key & np.uint64((1 << _AT) - 1)).astype(np.int64)  # of each start 0 .. n - length
    ends = np.cumsum(sizes)
    begins = ends - sizes
    fit = sizes >= length
    text = np.flatnonzero(fit)
    # the starts of a text of s bytes are its first s - length + 1 positions
    first_of, last_of = begins[fit], ends[fit] - length
    if not len(text):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    cut = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    inside = cut[np.searchsorted(first_of, cut, "right") > 0]
    which = np.searchsorted(first_of, inside, "right") - 1
    inside = inside[(inside > first_of[which]) & (inside <= last_of[which])]
    starts = np.union1d(inside, first_of)
    own = np.searchsorted(first_of, starts, "right") - 1
    following = np.r_[starts[1:], n]
    run = np.minimum(following, last_of[own] + 1) - starts
    return text[own], starts - first_of[own], run, h[owner[starts]].view(np.int64)
