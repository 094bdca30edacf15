"""A segment tree over the pre-tokens of a text: lengths and token counts, with sums along the tree."""

from __future__ import annotations

import numpy as np
import regex
import tiktoken

from .tokens import plain_pieces

SLOT = 32
LOOK = 2  # a pre-token is settled by its own characters and this many after it


class Counter(dict):
    """Tokens of a pre-token, remembered up to a bound on entries."""

    def __init__(self, bpe: tiktoken.Encoding, pattern: str, most: int = 1 << 20):
        super().__init__()
        self.bpe, self.cut, self.most = bpe, regex.compile(pattern), most
        self.newline = bpe.encode_ordinary("\n")[0]

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(pieces)
        together = [p for p in new if not p.isspace() and "\n" not in p]
        for s in range(0, len(together), 20000):  # parted by line feeds, which none of them can join
            part = together[s:s + 20000]
            ids = np.array(self.bpe.encode_ordinary("\n".join(part)))
            ends = np.append(np.flatnonzero(ids == self.newline), len(ids))
            if len(ends) == len(part):
                self.update(zip(part, np.diff(ends, prepend=-1) - 1))
        for p in new:
            if p not in self:
                self[p] = len(self.bpe.encode_ordinary(p))

    def counts(self, pieces: list[str]) -> list[int]:
        self.learn(set(pieces))
        return list(map(self.__getitem__, pieces))


class Pieces(dict):
    """Packed pre-token lengths and counts of a word with the space before it, remembered up to a bound on entries.

    In lines whose words are parted by single spaces such a piece is cut alike whatever stands around it.
    """

    def __init__(self, counter: Counter, most: int = 1 << 18):
        super().__init__()
        self.counter, self.most = counter, most

    def _cut(self, piece: str) -> list[str]:
        w = piece[1:] if piece[0] == " " else piece
        if w.isalpha() and max(w) < "\u0250":
            return [piece]
        if w[:-1].isalpha() and w[-1] in ".,;:!?" and max(w) < "\u0250":
            return [piece[:-1], piece[-1]]
        return self.counter.cut.findall(piece)

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(pieces)
        cut = list(map(self._cut, new))
        self.counter.learn({t for c in cut for t in c})
        known = self.counter
        for p, c in zip(new, cut):
            self[p] = (np.array([len(t) for t in c], "<u4").tobytes(), np.array([known[t] for t in c], "<u4").tobytes())

    def packed(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed lengths and counts of whole texts."""
        parts = [plain_pieces(t) for t in texts]
        self.learn({p for c in parts if c for p in c})
        out = []
        for text, c in zip(texts, parts):
            if c is None:
                whole = self.counter.cut.findall(text)
                out.append((np.array(list(map(len, whole)), "<u4").tobytes(), np.array(self.counter.counts(whole), "<u4").tobytes()))
            else:
                got = [self[p] for p in c]
                out.append((b"".join([g[0] for g in got]), b"".join([g[1] for g in got])))
        return out


class Tree:
    """Slots of up to some pre-tokens (lengths, counts) under a binary tree of sums."""

    def __init__(self, lengths, counts):
        self.base = (np.asarray(lengths, np.int64), np.asarray(counts, np.int64))
        n = len(self.base[0])
        self.n_slots = max(1, -(-n // SLOT))
        self.leaves = 1 << (self.n_slots - 1).bit_length()
        self.sums = np.zeros((2 * self.leaves, 2), np.int64)
        if n:
            at = np.arange(0, n, SLOT)
            for i in (0, 1):
                self.sums[self.leaves:self.leaves + self.n_slots, i] = np.add.reduceat(self.base[i], at)
        level = self.leaves
        while level > 1:
            self.sums[level // 2:level] = self.sums[level:2 * level:2] + self.sums[level + 1:2 * level:2]
            level //= 2
        self.changed: dict[int, tuple[list[int], list[int]]] = {}
        self.added = 0

    def slot(self, s: int) -> tuple[list[int], list[int]]:
        own = self.changed.get(s)
        return own or tuple(x[s * SLOT:(s + 1) * SLOT].tolist() for x in self.base)

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def slot_at(self, place: int) -> tuple[int, int]:
        """The slot that holds the character at ``place`` (the last one beyond the end), and where it starts."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            here = int(self.sums[node, 0])
            if place >= start + here and self.sums[node + 1, 0]:
                start += here
                node += 1
        return min(node - self.leaves, self.n_slots - 1), start

    def boundary(self, place: int) -> int:
        """The last pre-token boundary at or before ``place``."""
        if place <= 0:
            return 0
        slot, at = self.slot_at(place)
        for n in self.slot(slot)[0]:
            if at + n > place:
                break
            at += n
        return at

    def is_boundary(self, place: int) -> bool:
        return self.boundary(place) == place

    def replace(self, start: int, end: int, lengths: list[int], counts: list[int]) -> None:
        """Put pre-tokens in place of those between two boundaries; sums change along the paths of touched slots."""
        first, at = self.slot_at(start)
        a, b = self.slot(first)
        i = 0
        while at < start:
            at += a[i]
            i += 1
        left = (a[:i], b[:i])
        slot, k = first, i
        touched = {first}
        while at < end:
            while k >= len(a):
                slot, k = slot + 1, 0
                touched.add(slot)
                a, b = self.slot(slot)
            at += a[k]
            k += 1
        right = (a[k:], b[k:])
        for s in touched:
            self.changed[s] = ([], [])
        if slot == first:
            self.changed[first] = (left[0] + lengths + right[0], left[1] + counts + right[1])
        else:
            self.changed[first] = (left[0] + lengths, left[1] + counts)
            self.changed[slot] = right
        self.added += len(lengths)
        if self.added > 4 * SLOT * self.n_slots:  # slots grown long: cut anew
            x, y = self.arrays()
            self.__init__(x, y)
            return
        for s in touched:
            node = self.leaves + s
            self.sums[node] = [sum(x) for x in self.changed[s]]
            while node > 1:
                node //= 2
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """The lengths and counts as they are now."""
        out = []
        for i, x in enumerate(self.base):
            parts, at = [], 0
            for s in sorted(self.changed):
                parts += [x[at:s * SLOT], np.array(self.changed[s][i], np.int64)]
                at = (s + 1) * SLOT
            out.append(np.concatenate([*parts, x[at:]]))
        return out[0], out[1]


def tree_of(text: str, counter: Counter) -> Tree:
    pieces = counter.cut.findall(text)
    return Tree(list(map(len, pieces)), counter.counts(pieces))


def edit(text: str, tree: Tree, start: int, end: int, put: str, counter: Counter) -> tuple[str, int]:
    """Replace characters start..end; the new text and how many of its characters were cut and counted again.

    Pre-tokens are cut anew from the last boundary that the edit cannot have moved, until a cut behind the edit falls on
    an old boundary: from there on the old cuts hold, since a cut depends on the text after it only.
    """
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    new = text[:start] + put + text[end:]
    shift = len(put) - (end - start)
    begin = at = tree.boundary(start - LOOK)
    pieces = []
    while at < len(new) and not (at >= start + len(put) and tree.is_boundary(at - shift)):
        m = counter.cut.match(new, at)
        pieces.append(m[0])
        at = m.end()
    tree.replace(begin, at - shift, list(map(len, pieces)), counter.counts(pieces))
    return new, at - begin
