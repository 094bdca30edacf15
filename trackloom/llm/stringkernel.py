"""A gap-weighted subsequence kernel on words, and a support vector machine on its Nyström features.

A word is seen as its symbol triples in order (letters, a mark for its start, a mark after an accented letter), up to ``SPAN`` places apart; a triple that spans s places weighs
``DECAY ** s``, so inserted characters weaken a match and do not break it. The kernel of two words is the product of
their triple weights, each word scaled by the length of its own. Because the kernel is an inner product, a machine on
landmarks folds into one table of triple weights, and a word is scored by looking its triples up.
"""

from __future__ import annotations

import unicodedata

import numpy as np

ACCENT, START = "{", "|"  # they follow the letters in ASCII
LETTERS, SPAN, DECAY = 28, 7, 0.6
PIECE, STRIDE = 24, 12
SIZE = LETTERS ** 3
STEPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def _folding() -> dict[int, str | None]:
    """Accented Latin letters to their base and a mark, combining marks to the mark, look-alike digits to letters."""
    table: dict[int, str | None] = {c: ACCENT for c in range(0x300, 0x370)}
    for c in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(c).lower())[0]
        if base.isascii() and base.isalpha():
            table[c] = base + ACCENT
    return table | str.maketrans("ßøæœđł013457{|", "soaodloieast##")


FOLD = _folding()


def encoded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols as numbers (anything else -1), and where each word starts and ends; words hold no white space."""
    text = "\n".join(words).lower().translate(FOLD).replace("\n", "\n" + START)
    raw = np.frombuffer((START + text + "\n").encode("ascii", "replace"), np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    codes = raw.astype(np.int16) - 97
    return np.where((codes >= 0) & (codes < LETTERS), codes, -1).astype(np.int16), starts, ends


def _blocks(words: list[str], most: int = 4096):
    """Padded blocks of words of like length with the numbers of their words; a long word has overlapping pieces."""
    if not words:
        return
    codes, starts, ends = encoded(words)
    owner = np.arange(len(words))
    long = np.flatnonzero(ends - starts > PIECE)
    if len(long):
        more = [(i, p, min(p + PIECE, ends[i])) for i in long for p in range(starts[i], ends[i] - PIECE + STRIDE, STRIDE)]
        short = ends - starts <= PIECE
        owner = np.concatenate([owner[short], [m[0] for m in more]])
        starts, ends = np.concatenate([starts[short], [m[1] for m in more]]), np.concatenate([ends[short], [m[2] for m in more]])
    order = np.argsort(ends - starts, kind="stable")
    for s in range(0, len(order), most):
        part = order[s:s + most]
        width = max(3, int((ends - starts)[part[-1]]))
        at = starts[part][:, None] + np.arange(width)
        yield owner[part], np.where(at < ends[part][:, None], codes[np.minimum(at, len(codes) - 1)], np.int16(-1))


def _triples(block: np.ndarray):
    """Of a padded block of words: for each step the triple numbers (0 where there is none) and weights."""
    n, width = block.shape
    for j, k in STEPS:
        if k >= width:
            continue
        a, b, c = block[:, :width - k], block[:, j:width - k + j], block[:, k:]
        there = (a >= 0) & (b >= 0) & (c >= 0)
        yield np.where(there, (a.astype(np.int32) * LETTERS + b) * LETTERS + c, 0), there * np.float32(DECAY ** (k + 1))


def features(words: list[str]) -> np.ndarray:
    """The scaled triple weights of each word of ``PIECE`` letters at most, written out; for few words."""
    out = np.zeros((len(words), SIZE), np.float32)
    for part, block in _blocks(words, 256):
        own = np.zeros((len(part), SIZE), np.float32)
        norm = np.zeros(len(part), np.float32)
        rows = np.arange(len(part))[:, None]
        for at, w in _triples(block):
            np.add.at(own, (np.broadcast_to(rows, at.shape), at), w)
            norm += (w * w).sum(1)
        out[part] = own / np.sqrt(np.maximum(norm, 1e-12))[:, None]
    return out


def scores(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """Margins of words by the folded table; a long word has that of its best piece."""
    out = np.full(len(words), -np.inf, np.float32)
    for part, block in _blocks(words):
        total, norm = np.zeros(len(part), np.float32), np.zeros(len(part), np.float32)
        for at, w in _triples(block):
            total += np.einsum("ij,ij->i", table[at], w)
            norm += np.einsum("ij,ij->i", w, w)
        np.maximum.at(out, part, total / np.sqrt(np.maximum(norm, 1e-12)) + bias)
    return out


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """Weights (the last one the bias) of a linear machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        slack = 1 - y * (x @ w)
        on = slack > 0
        if not on.any():
            break
        c = cost * weight[on]
        new = np.linalg.solve(ridge + (x[on] * c[:, None]).T @ x[on], (x[on] * (c * y[on])[:, None]).sum(0))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def kernel(words: list[str], marks: np.ndarray, most: int = 256) -> np.ndarray:
    """The kernel of words and landmarks (given by their features), some words at a time."""
    return np.vstack([features(words[i:i + most]) @ marks.T for i in range(0, len(words), most)])


def nystroem_table(landmarks: list[str], words: list[str], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The machine on Nyström features of ``words``, folded into a table of triple weights, and its bias."""
    marks = features(landmarks)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-4 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    w = machine(kernel(words, marks) @ root, y, weight)
    return (marks.T @ (root @ w[:-1])).astype(np.float32), float(w[-1])
