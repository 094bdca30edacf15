"""Sum-of-squares online packing of token sequences.

A task packs the documents that it reads, one after the other. ``levels[h]`` counts the open windows that hold h tokens.
A piece of s tokens goes to the fill level h (or a new window) for which the sum of squared counts after placing it is
least, so that levels stay evenly used and fitting rests stay at hand. A document longer than a window fills windows of
its own; its rest is placed. At the end of the task the windows still open are poured together: pieces of the emptiest
are cut to fill the fullest, and the last rest is cut into power-of-two sequences, which need no padding.

No exchange: documents stay where they are read; open windows (few, by the rule) are all that a task holds. The sequence
number carries the partition number in its high bits, so runs over the same input agree.

Null and empty texts are documents of one token, the end mark. Repeated rows are packed one by one. Only id and text are
read, so other columns cannot clash. Empty input gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .registry import query
from .text import documents
from .tokens import Encoder

WINDOW, END_ID, SHIFT = 2048, 1, 33
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Open windows by fill level; a piece is (doc, start, ids as bytes, tokens of the document)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)  # both ends stay 0: empty and full windows do not count
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def place(self, piece: tuple) -> list | None:
        """Put a piece of fewer tokens than a window into the best level; the window if that filled it."""
        s = len(piece[2]) // 4
        levels = self.levels
        change = levels[s:] - levels[:self.window + 1 - s] + 1  # half the change in squares from level h to h + s
        change[-1] = -levels[self.window - s]  # filling a window only takes one away from its level
        usable = levels[:self.window + 1 - s] > 0
        usable[0] = True
        h = int(np.where(usable, change, np.iinfo(np.int64).max).argmin())
        box = self.open[h].pop() if h else []
        levels[h] -= h > 0
        box.append(piece)
        if h + s == self.window:
            return box
        levels[h + s] += 1
        self.open[h + s].append(box)
        return None

    def rest(self) -> Iterator[list]:
        """The open windows poured together, fullest first; the last ones have power-of-two lengths."""
        boxes = [(h, b) for h in range(self.window - 1, 0, -1) for b in self.open[h]]
        low = len(boxes) - 1
        spare: list[tuple] = []
        i = 0
        while i <= low:
            h, box = boxes[i]
            i += 1
            while h < self.window and (spare or low >= i):
                if not spare:
                    spare = boxes[low][1][:]
                    low -= 1
                piece = spare.pop()
                n = len(piece[2]) // 4
                take = min(n, self.window - h)
                box.append((piece[0], piece[1], piece[2][:4 * take], piece[3]))
                if take < n:
                    spare.append((piece[0], piece[1] + take, piece[2][4 * take:], piece[3]))
                h += take
            if h == self.window:
                yield box
            else:
                spare += box
        while spare:
            left = sum(len(p[2]) // 4 for p in spare)
            room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            box = []
            while room:
                doc, start, ids, total = spare.pop()
                take = min(len(ids) // 4, room)
                box.append((doc, start, ids[:4 * take], total))
                if take < len(ids) // 4:
                    spare.append((doc, start + take, ids[4 * take:], total))
                room -= take
            yield box


def packed(documents_: Iterator[tuple[int, bytes]], window: int = WINDOW) -> Iterator[list]:
    """Sequences (lists of pieces) of documents given as (doc, ids as bytes)."""
    packer = SumOfSquares(window)
    for doc, ids in documents_:
        total = len(ids) // 4
        for start in range(0, total, window):
            part = ids[4 * start:4 * (start + window)]
            if len(part) == 4 * window:
                yield [(doc, start, part, total)]
            else:
                full = packer.place((doc, start, part, total))
                if full:
                    yield full
    yield from packer.rest()


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: its document, place in the document and in its sequence, and the checksum of its ids."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        high = TaskContext.get().partitionId() << SHIFT

        def read() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for s in range(0, batch.num_rows, 256):
                    part = batch.slice(s, 256)
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    for doc, ids in zip(part.column(0).to_pylist(), encoder.encode_batch(texts)):
                        yield doc, ids + end

        rows: list[tuple] = []
        for number, box in enumerate(packed(read(), window)):
            offset = 0
            for doc, start, ids, total in box:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, high + number, offset))
                offset += n
            if len(rows) >= 20000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(run, COLUMNS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in COLUMNS.split(", ")])


@query("op5_pack_sequences")
def op5_pack_sequences(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
