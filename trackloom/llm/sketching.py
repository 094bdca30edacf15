"""Fast similarity sketches: every coordinate is filled after a few rounds of hashed bin placement."""

from __future__ import annotations

import numpy as np

from .text import scramble

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
VALUE_BITS = np.uint64(48)
ODD = np.uint64(0x9E3779B97F4A7C15)


def fast_sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """The sketch of a set of 64-bit elements.

    In round i < size each element falls into a hashed bin with the value i + (a hash below one); in round i >= size
    all elements fall into bin i - size, so no bin can stay empty. A bin keeps its smallest value; rounds end when all
    are filled. Two sketches agree in a coordinate with the Jaccard similarity as probability.
    """
    out = np.full(size, EMPTY)
    if len(elements) == 0:
        return out
    step, done = max(1, 4 * size // len(elements)), 0
    while done < 2 * size:
        rounds = np.arange(done, min(done + step, 2 * size), dtype=np.uint64)
        v = scramble(elements[None, :] ^ ((rounds + np.uint64(1)) * ODD)[:, None])
        bins = (v >> np.uint64(33)) % np.uint64(size)
        late = rounds >= size
        if late.any():
            bins[late] = (rounds[late] - np.uint64(size))[:, None]
        values = (rounds[:, None] << VALUE_BITS) | (scramble(v) >> (np.uint64(64) - VALUE_BITS))
        np.minimum.at(out, bins.astype(np.int64).ravel(), values.ravel())
        if (out != EMPTY).all():
            break
        done += step
    return out


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One hash per run of ``rows`` coordinates, the run's number mixed in."""
    parts = sketch.reshape(-1, rows)
    h = np.arange(1, len(parts) + 1, dtype=np.uint64) * ODD
    for j in range(rows):
        h = scramble(h + parts[:, j])
    return h.view(np.int64)
