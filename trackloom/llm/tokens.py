"""Token ids of whole texts with a public byte-level BPE vocabulary, each distinct word encoded once per task."""

from __future__ import annotations

import base64

import numpy as np
import tiktoken

SPECIAL = "<|endoftext|>"
NEWLINE = 198  # the id of a single line feed in the vocabulary


def vocabulary(path: str | None = None) -> str:
    """The rank file of the 50k byte-level vocabulary (the same vocabulary as its tokenizers file)."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return path


class Encoder:
    """Ids as the tokenizers file of the vocabulary gives them without adding special tokens.

    In lines whose words are parted by single spaces, a word with the space before it is encoded alone, whatever its
    neighbours: such pieces are remembered. Any other text is encoded whole.
    """

    def __init__(self, path: str | None = None, most: int = 1 << 20):
        import public_tokenizers
        with open(vocabulary(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
        self.pieces: dict[str, bytes] = {}
        self.most = most

    def _whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode(text, allowed_special="all"), "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Encode pieces in one go: parted by line feeds, which no piece holds, so none can join another."""
        if len(self.pieces) + len(new) > self.most:
            self.pieces.clear()
        self.pieces["\n"] = np.array([NEWLINE], "<u4").tobytes()
        new = [p for p in new if p != "\n"]
        for s in range(0, len(new), 20000):
            part = new[s:s + 20000]
            ids = np.array(self.bpe.encode("\n".join(part), allowed_special="all"), "<u4")
            cuts = np.flatnonzero(ids == NEWLINE)
            if len(cuts) != len(part) - 1:
                self.pieces.update((p, self._whole(p)) for p in part)
                continue
            raw, at = ids.tobytes(), [0, *((cuts + 1) * 4).tolist()]
            for p, a, b in zip(part, at, [*(cuts * 4).tolist(), len(raw)]):
                self.pieces[p] = raw[a:b]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian 32-bit integers."""
        cut = [plain_pieces(t) for t in texts]
        for s in range(0, len(cut), 500):
            part = [c for c in cut[s:s + 500] if c is not None]
            new = {p for c in part for p in c} - self.pieces.keys()
            if len(self.pieces) + len(new) > self.most:
                self.pieces.clear()
                new = {p for c in part for p in c}
            if new:
                self._learn(sorted(new))
            for i in range(s, min(s + 500, len(cut))):
                if cut[i] is not None:
                    cut[i] = b"".join(map(self.pieces.__getitem__, cut[i]))
        return [self._whole(t) if c is None else c for t, c in zip(texts, cut)]


_ODD = {c for c in map(chr, range(0x110000)) if c.isspace()} - {" ", "\n"}


def _plain(text: str) -> bool:
    """No white space but spaces and line feeds."""
    return _ODD.isdisjoint(text)


def plain_pieces(text: str) -> list[str] | None:
    """Words with the space before them, and line feeds, of a text without other white space; else None."""
    if not (text.isprintable() or _plain(text)):
        return None
    out = []
    for n, line in enumerate(text.split("\n")):
        if n:
            out.append("\n")
        ws = line.split(" ")
        if "" in ws:
            return None
        out.append(ws[0])
        out += [" " + w for w in ws[1:]]
    return out
