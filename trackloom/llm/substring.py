"""Substring duplicates: windows of words that an earlier document holds too, found behind a count-min prefilter.

Each window of 13 words has an anchor, the smallest hash of its 5-word shingles; equal windows have equal anchors, and a
document has about one anchor for five windows.

1. Every task sketches the anchors of its documents, once per document, and hands the touched cells on by slices of the
   sketch; per slice the cells add up. A cell that only one document touched proves its anchors unique: the sketch
   overestimates and never loses a repeat.
2. Windows whose anchor is estimated repeated are grouped exactly by a 128-bit key (anchor and window hash). A task first
   settles repeats among its own documents and hands on one entry per window with its smallest document, so a window
   that a third of all rows hold gives one entry per task. Per slice of keys the smallest document is found; the others
   get the places of their windows back.
3. Documents take their places together and drop the covered words.

The sketch is as wide as the number of windows asks for, up to ``sketch_bytes``; within this bound its bit table goes to
all executors. Beyond it the cells stay a table: the repeated ones are joined back to their documents, whose texts are
then joined by id. Both ways give the same windows.

Null and empty texts, and texts of fewer words than a window, lose nothing. Rows that share an id count as one document
against each other: the words of the first rows do not remove those of the others. Rows without an id lose nothing and
remove nothing. Only id and text are read. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query
from .text import WordHashes, documents, scramble, shingle_hashes

WIDTH, ANCHOR = 13, 5
SKETCH_BYTES = 64 << 20
CELLS_PER_ANCHOR = 8
SLICE_KEYS = 1 << 17
CHUNK_WORDS = 500_000
KNOWN_WORDS = 1 << 18


def _chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_WORDS) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(id, words) of documents long enough for a window, some million words at a time."""
    out, n = [], 0
    for batch in (b.slice(s, 256) for b in batches for s in range(0, b.num_rows, 256)):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ws = text.encode("utf-8", "surrogatepass").split() if text and doc is not None else []
            if len(ws) >= WIDTH:
                out.append((doc, ws))
                n += len(ws)
                if n >= most:
                    yield out
                    out, n = [], 0
    if out:
        yield out


class Windows:
    """The windows of a chunk: document number, place of the first word, anchor and hash of each."""

    def __init__(self, chunk: list[tuple[int, list[bytes]]], known: WordHashes):
        sizes = np.array([len(ws) for _, ws in chunk])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        h = np.concatenate([known.of(ws) for _, ws in chunk])
        small = shingle_hashes(h, ANCHOR)
        owner = np.repeat(np.arange(len(chunk)), sizes)[:len(h) - WIDTH + 1]
        place = np.arange(len(owner)) - starts[owner]
        inside = place <= sizes[owner] - WIDTH
        span = WIDTH - ANCHOR + 1
        best = small[:len(owner)].copy()
        for j in range(1, span):
            np.minimum(best, small[j:j + len(owner)], out=best)
        self.ids = np.array([d for d, _ in chunk], np.int64)
        self.owner, self.place, self.anchor = owner[inside], place[inside], best[inside]
        self._small, self._inside = small, inside

    def keys(self) -> np.ndarray:
        """Window hashes; the last shingles of a window and its first fix all its words."""
        s, n = self._small, len(self._inside)
        w = scramble(s[:n] + np.uint64(1))
        for j in (ANCHOR - 1, WIDTH - ANCHOR):
            w = scramble(w + s[j:j + n])
        return w[self._inside]


def _binary(x: np.ndarray, dtype: str) -> bytes:
    return np.ascontiguousarray(x, dtype).tobytes()


def _sliced(number: np.ndarray, *columns: tuple[np.ndarray, str]) -> Iterator[tuple]:
    """Rows (slice, packed columns) of entries grouped by slice number."""
    order = np.argsort(number, kind="stable")
    cuts = np.flatnonzero(np.diff(number[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield (int(number[part[0]]), *(_binary(c[part], t) for c, t in columns))


def _cells(width: int, slices: int):
    """Cells touched by a task's documents: (slice, offsets touched by one document, offsets touched by more)."""
    per = width // slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(KNOWN_WORDS)
        for chunk in _chunks(batches):
            w = Windows(chunk, known)
            fresh = np.flatnonzero(np.concatenate([[True], (np.diff(w.anchor) != 0) | (np.diff(w.owner) != 0)]))
            cell, owner = scramble(w.anchor[fresh]) % np.uint64(width), w.owner[fresh]
            order = np.lexsort((owner, cell))
            cell, owner = cell[order], owner[order]
            other = np.concatenate([[True], (np.diff(cell) != 0) | (np.diff(owner) != 0)])
            unique, count = np.unique(cell[other], return_counts=True)
            rows = list(_sliced((unique // np.uint64(per)).astype(np.int64), (unique % np.uint64(per), "<u4"), (np.minimum(count, 2), "u1")))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                                              pa.array([r[2] for r in rows], pa.binary())], ["s", "cells", "n"])
    return run


def _add(per: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(per, np.uint8)
        for batch in batches:
            for cells, n in zip(batch.column("cells").to_pylist(), batch.column("n").to_pylist()):
                at = np.frombuffer(cells, "<u4")
                total[at] = np.minimum(total[at] + np.frombuffer(n, "u1"), 2)
        bits = np.packbits(total >= 2)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["s", "bits"])
    return run


def sketch(docs: DataFrame, width: int, slices: int) -> np.ndarray:
    """The merged sketch as a bit table: set where two documents or more touched the cell. ``width`` is bounded by the caller."""
    per = width // slices
    cells = docs.mapInArrow(_cells(width, slices), "s int, cells binary, n binary")
    merged = cells.groupBy("s").applyInArrow(_add(per), "s int, bits binary").collect()  # width / 8 bytes
    table = np.zeros(width // 8, np.uint8)
    for r in merged:
        table[r.s * per // 8:(r.s + 1) * per // 8] = np.frombuffer(r.bits, np.uint8)
    return table


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes(KNOWN_WORDS)
    for chunk in _chunks(batches):
        w = Windows(chunk, known)
        pairs = np.unique(np.stack([w.ids[w.owner].view(np.uint64), w.anchor], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], ["doc_id", "anchor"])


def _repeats(chunk, w: Windows, on: np.ndarray, slices: int) -> list[tuple]:
    """Of the chosen windows: entries for the slices of keys, and places settled inside the chunk.

    Rows (slice, doc_id, anchors, keys, docs, places); the settled ones have a document and places only.
    """
    anchor, key = w.anchor[on], w.keys()[on]
    doc, place = w.ids[w.owner[on]], w.place[on]
    order = np.lexsort((place, doc, key, anchor))
    anchor, key, doc, place = anchor[order], key[order], doc[order], place[order]
    new = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(key) != 0)]) if len(anchor) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    first = doc[new][group] if len(doc) else doc
    later = doc > first
    rows = [(s, None, a, k, d, p) for s, a, k, d, p in _sliced(
        (scramble(anchor[~later]) >> np.uint64(33)).astype(np.int64) % slices, (anchor[~later], "<u8"), (key[~later], "<u8"),
        (doc[~later], "<i8"), (place[~later], "<u4"))]
    if later.any():
        where = np.argsort(doc[later], kind="stable")
        d, p = doc[later][where], place[later][where]
        for part in np.split(np.arange(len(d)), np.flatnonzero(np.diff(d)) + 1):
            rows.append((int(scramble(np.array([d[part[0]]], np.uint64))[0] >> np.uint64(33)) % slices, int(d[part[0]]), None, None, None, _binary(p[part], "<u4")))
    return rows


ENTRIES = pa.schema([("s", pa.int32()), ("doc_id", pa.int64()), ("anchors", pa.binary()), ("keys", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())])
ENTRY_COLUMNS = "s int, doc_id long, anchors binary, keys binary, docs binary, places binary"


def _entries(slices: int, table):
    """Entries of windows whose anchor the sketch (a broadcast bit table) estimates repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = WordHashes(KNOWN_WORDS), np.frombuffer(table.value, np.uint8)
        for chunk in _chunks(batches):
            w = Windows(chunk, known)
            cell = scramble(w.anchor) % np.uint64(len(bits) * 8)
            on = np.flatnonzero((bits[(cell >> np.uint64(3)).astype(np.int64)] >> (7 - (cell & np.uint64(7))).astype(np.uint8)) & 1)
            rows = _repeats(chunk, w, on, slices)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ENTRIES)], schema=ENTRIES)
    return run


def _entries_joined(slices: int):
    """The same from rows (doc_id, text, repeated anchors of the document)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(KNOWN_WORDS)
        for batch in batches:
            wanted = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            for chunk in _chunks(iter([batch])):
                w = Windows(chunk, known)
                pairs = np.concatenate([np.array([(i, a & 0xFFFFFFFFFFFFFFFF) for a in wanted[d]], np.uint64).reshape(-1, 2) for i, (d, _) in enumerate(chunk)])
                mix = lambda o, a: scramble(a + scramble(o + np.uint64(7)))
                on = np.flatnonzero(np.isin(mix(w.owner.astype(np.uint64), w.anchor), mix(pairs[:, 0], pairs[:, 1])))
                rows = _repeats(chunk, w, on, slices)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ENTRIES)], schema=ENTRIES)
    return run


def _settle(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the entries of one slice, the (doc_id, places) of windows that a smaller document holds."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    out_doc, out_places = [], []
    for batch in batches:
        for doc, *packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "anchors", "keys", "docs", "places"))):
            if doc is not None:
                out_doc.append(doc)
                out_places.append(packed[3])
                continue
            for part, raw, t in zip(parts, packed, ("<u8", "<u8", "<i8", "<u4")):
                part.append(np.frombuffer(raw, t))
    if parts[0]:
        anchor, window, doc, place = map(np.concatenate, parts)
        order = np.lexsort((doc, window, anchor))
        anchor, window, doc, place = anchor[order], window[order], doc[order], place[order]
        new = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(window) != 0)])
        later = doc > doc[new][np.cumsum(new) - 1]
        where = np.argsort(doc[later], kind="stable")
        d, p = doc[later][where], place[later][where]
        for part in np.split(np.arange(len(d)), np.flatnonzero(np.diff(d)) + 1):
            if len(part):
                out_doc.append(int(d[part[0]]))
                out_places.append(_binary(p[part], "<u4"))
    yield pa.RecordBatch.from_arrays([pa.array(out_doc, pa.int64()), pa.array(out_places, pa.binary())], ["doc_id", "places"])


def repeated_places(docs: DataFrame, sketch_bytes: int = SKETCH_BYTES, slice_keys: int = SLICE_KEYS) -> DataFrame:
    """(doc_id, places): packed places of windows that a document with a smaller id holds too; several rows a document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    windows = max(1, size // 6)
    slices = max(64, int(windows // slice_keys))
    width = 1 << max(16, int(windows / 5 * CELLS_PER_ANCHOR).bit_length())
    if width // 8 <= sketch_bytes:
        table = sketch(docs, width, max(1, width >> 20))
        entries = docs.mapInArrow(_entries(slices, spark.sparkContext.broadcast(table.tobytes())), ENTRY_COLUMNS)
    else:
        pairs = docs.mapInArrow(_anchors, "doc_id long, anchor long")
        cell = F.pmod(F.xxhash64("anchor"), F.lit(1 << 48))
        repeated = pairs.groupBy(cell.alias("cell")).agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).filter("_a <> _b")
        wanted = pairs.withColumn("cell", cell).join(repeated.select("cell"), "cell", "left_semi")
        wanted = wanted.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
        entries = docs.join(wanted, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_entries_joined(slices), ENTRY_COLUMNS)
    return entries.groupBy("s").applyInArrow(_settle, "doc_id long, places binary")


def covered(n: int, places: list[bytes] | None) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the places."""
    edge = np.zeros(n + 1, np.int32)
    for raw in places or ():
        at = np.frombuffer(raw, "<u4").astype(np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WIDTH, -1)
    return np.cumsum(edge[:-1]) > 0


def with_places(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text and the packed places of all rows."""
    found = repeated_places(docs, **options).groupBy("doc_id").agg(F.collect_list("places").alias("places"))
    return docs.select(F.col("doc_id").cast("long"), "text").join(found, "doc_id", "left")


def _kept_words(text: str | None, places: list[bytes] | None) -> tuple[int, list[bytes]]:
    ws = (text or "").encode("utf-8", "surrogatepass").split()
    if not places:
        return len(ws), ws
    return len(ws), [w for w, gone in zip(ws, covered(len(ws), places).tolist()) if not gone]


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text (kept words, one space between), n_words, n_removed of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_kept_words(t, p) for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b" ".join(k).decode("utf-8", "surrogatepass") for _, k in rows], pa.string()),
                 pa.array([n for n, _ in rows], pa.int64()), pa.array([n - len(k) for n, k in rows], pa.int64())],
                ["doc_id", "text", "n_words", "n_removed"])

    return with_places(docs, **options).select("doc_id", "text", "places").mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")


@query("op7_substring_dedup")
def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
