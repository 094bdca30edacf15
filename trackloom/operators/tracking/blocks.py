"""Walking many tracking sessions of a task side by side.

The sorted Arrow stream of a task is cut into blocks, and the sessions of a block into pieces of ``PIECE`` frames. The
k-th frames of all pieces form one step, so the numeric work of a step runs on stacked arrays over hundreds of pieces
instead of one camera at a time, however long a session is. The state a later piece begins with is a guess: that of a
fold which starts ``warm`` frames earlier without tracks. Old tracks die, so it is nearly always the true one. Every
guess is compared, value by value, with what the piece before ends with; a piece that began with another state is walked
again from there, and where that does not settle a session (tracks that never end), the rest of it is walked as one piece.
So the result is that of one walk. The session that is still open at the end of a
block hands its live tracks to the next block; nothing else is kept, so memory is bounded by the block size.

A key may hold one part of a longer session. Its rows then begin with ``warm`` frames of the part before, which are walked
but not put out, and ``edge`` is set in the last frame before the next part. The tracks at both places are noted in
``marks`` as digests, so that the parts of a session may be walked by different tasks and compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_ROWS = 100_000   # rows read before a block is worked on
EMIT_ROWS = 100_000    # output rows handed on at once
PIECE = 256            # frames of a piece


class Bank:
    """Parallel arrays of live tracks."""

    def __init__(self, **fields: np.ndarray):
        self.__dict__.update(fields)

    def __len__(self) -> int:
        return len(self.g)

    def take(self, index: np.ndarray) -> "Bank":
        return Bank(**{k: v[index] for k, v in self.__dict__.items()})

    def join(self, *others: "Bank") -> "Bank":
        return Bank(**{k: np.concatenate([v, *[o.__dict__[k] for o in others]]) for k, v in self.__dict__.items()})

    def parts(self, n: int) -> list["Bank"]:
        """The tracks of each of ``n`` pieces."""
        order = np.argsort(self.g, kind="stable")
        bounds = np.searchsorted(self.g[order], np.arange(n + 1))
        return [self.take(order[bounds[k]:bounds[k + 1]]) for k in range(n)]

    def digest(self, labels: dict[str, int]) -> bytes:
        """Of every value of the tracks, whatever piece they are in and whatever codes labels have."""
        out, names = hashlib.blake2b(digest_size=16), [*labels]
        for k, v in sorted(self.__dict__.items()):
            if k == "lab":
                v = np.array([names[i] for i in v.tolist()], dtype=object)
            if k != "g":
                out.update(f"{k} {v.dtype} {v.shape}".encode())
                out.update(v.tobytes() if v.dtype != object else repr(
                    [x if x is None or isinstance(x, str) else (x.shape, x.tobytes()) for x in v]).encode())
        return out.digest()

    def same(self, other: "Bank") -> bool:
        """Whether the tracks are the same in every value, whatever piece they are in."""
        return len(self) == len(other) and all(_equal(v, other.__dict__[k]) for k, v in self.__dict__.items() if k != "g")


def _equal(a: np.ndarray, b: np.ndarray) -> bool:
    if a.dtype != object:
        return a.tobytes() == b.tobytes()
    return all(x is y or (x is not None and y is not None and np.array_equal(x, y, equal_nan=True)) for x, y in zip(a, b))


class Rows:
    """Columns of a block as arrays; list columns as (values, offsets, valid)."""

    def __init__(self, table: pa.Table, labels: dict[str, int]):
        table = table.combine_chunks()
        self.n = table.num_rows
        self.col, self.lists, self._box = {}, {}, None
        for name in table.column_names:
            arr = table.column(name)
            arr = arr.chunk(0) if arr.num_chunks == 1 else pa.concat_arrays(arr.chunks)
            if pa.types.is_list(arr.type):
                self.lists[name] = (arr.values.to_numpy(zero_copy_only=False), arr.offsets.to_numpy(),
                                    arr.is_valid().to_numpy(zero_copy_only=False))
            elif name == "label":
                enc = arr.fill_null("").dictionary_encode()
                codes = np.array([labels.setdefault(v, len(labels)) for v in enc.dictionary.to_pylist()] or [0])
                self.col[name] = codes[enc.indices.to_numpy()]
            else:
                self.col[name] = arr.to_numpy(zero_copy_only=False)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.col[name]

    @property
    def box(self) -> np.ndarray:
        if self._box is None:
            self._box = np.stack([self.col[c] for c in ("x1", "y1", "x2", "y2")], axis=1)
        return self._box

    def vector(self, name: str, i: int) -> np.ndarray | None:
        values, off, valid = self.lists[name]
        return values[off[i]:off[i + 1]] if valid[i] else None


def named(codes: np.ndarray, names: list[str]) -> pa.Array:
    """Strings by their place in ``names``."""
    return pa.array(names, pa.string()).take(pa.array(codes, pa.int64()))


def _changes(cols: list[np.ndarray]) -> np.ndarray:
    flag = np.zeros(len(cols[0]), dtype=bool)
    flag[0] = True
    for c in cols:
        flag[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(flag)


def blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, bool]]:
    """Blocks of whole frames, and whether another one follows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= BLOCK_ROWS:
            table = pa.Table.from_batches(held)
            cols = [table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in (*keys, "frame_id")]
            cut = int(_changes(cols)[-1])  # the last frame may go on in the next batch
            if cut:
                yield table.slice(0, cut), True
                held, n = table.slice(cut).to_batches(), table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held), False


class Step:
    """The k-th frames of all pieces of a block that are that long."""

    def __init__(self, groups, frame_id, ordinal, is_inf, rows, row_group):
        self.groups, self.frame_id, self.ordinal, self.is_inf = groups, frame_id, ordinal, is_inf
        self.rows, self.row_group = rows, row_group


class Engine:
    """What :class:`BlockRunner` feeds: ``empty()``, ``step(bank, rows, step, keys) -> (bank, fields or None)``, and
    ``batch(fields, keys, labels)`` for the output. Tracks are the state; an engine that keeps more per key offers it here.
    """

    pieces = True  # whether old tracks die, so that sessions may be cut into pieces
    warm = 32      # frames, at most PIECE, after which a fold without tracks is mostly that with the right ones

    rewalks = 1    # how often pieces are walked again before the rest of their session is walked as one

    def nothing(self) -> pa.RecordBatch:
        """Output without rows."""
        return self.batch(self._report(self.empty(), np.zeros(0, dtype=np.int64)), [], {"": 0})

    def enter(self, key: tuple, extra) -> None:
        """``key`` begins with ``extra``, which stays as it is; None at the very beginning."""

    def leave(self, key: tuple):
        """What ``key`` holds beside its tracks; the engine forgets it."""

    def settle(self, guess, end, true):
        """Whether a walk that began with ``guess`` and ended with ``end`` is that from ``true``, and what it ends with then
        (if not: a guess)."""
        return True, end


class BlockRunner:
    """Feeds blocks to an engine; ``show`` names keys that are added to the output."""

    def __init__(self, engine: Engine, keys: list[str], labels: dict[str, int], show: tuple[str, ...] = ()):
        self.engine, self.keys, self.show = engine, keys, show
        self.labels = dict(labels)
        self.marks: list[tuple[tuple, bool, bytes]] = []  # key, whether at its end, tracks
        self.open_warm = self.open_edge = False           # of the last frame of the open session
        self.open_key, self.open_bank, self.open_extra = None, None, None
        self.open_whole = False  # the open session could not be cut before

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, more in blocks(batches, self.keys):
            yield from self.feed(table, keep_open=more)

    def feed(self, table: pa.Table, keep_open: bool = True) -> Iterator[pa.RecordBatch]:
        """Process whole frames; ``keep_open`` leaves the last session open for the next call."""
        frame_cols = [table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
                      for c in (*self.keys, "frame_id")]
        starts = _changes(frame_cols)
        rows = Rows(table, self.labels)
        key_cols = [rows[k] for k in self.keys]
        group_starts = _changes(key_cols)
        first_frame = np.searchsorted(starts, group_starts)
        frames_in = np.diff(np.append(first_frame, len(starts)))
        frames = starts, np.append(starts[1:], rows.n)

        group_keys = list(zip(*[c[group_starts].tolist() for c in key_cols]))
        known = self.open_bank is not None and group_keys[0] == self.open_key
        if self.open_key is not None and not known:
            self._close(self.open_key, self.open_edge, self.open_bank)
        warm = rows.col["warm"][starts] if "warm" in rows.col else np.zeros(len(starts), dtype=bool)
        before = np.append(False, warm[:-1])
        before[first_frame] = False
        before[0] = known and self.open_warm
        turns = np.flatnonzero(before & ~warm)  # here the warm frames of a part end, and a piece
        segment = np.union1d(first_frame, turns)
        length = np.diff(np.append(segment, len(starts)))
        cut = -(-length // PIECE) if self.engine.pieces else np.ones(len(segment), dtype=np.int64)
        if known and self.open_whole:
            cut[segment < frames_in[0]] = 1
        of = np.repeat(np.arange(len(segment)), cut)
        within = np.arange(len(of)) - np.repeat(np.cumsum(cut) - cut, cut)
        lo = segment[of] + within * PIECE
        hi = np.where(within == cut[of] - 1, (segment + length)[of], lo + PIECE)
        group = np.searchsorted(first_frame, lo, side="right") - 1
        pieces = np.bincount(group)
        number = np.arange(len(group)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        over = (segment + length)[of]
        begins, unseen = lo.copy(), warm[lo]
        keys = [(*group_keys[g], n) for g, n in zip(group.tolist(), number.tolist())]

        later = number > 0
        start, extra, _ = self._walk(rows, frames, np.where(later, np.maximum(lo - self.engine.warm, first_frame[group]), lo), lo, {}, {}, keys, False)
        if known:
            start[0], extra[0] = self.open_bank, self.open_extra
        end, left, walked = self._walk(rows, frames, lo, hi, dict(enumerate(start)), dict(enumerate(extra)), keys, True)
        walks, by = [walked], np.zeros(len(keys), dtype=np.int64)
        whole = known and self.open_whole
        while True:
            wrong, settled = [], list(left)
            for k in np.flatnonzero(later).tolist():
                fits, settled[k] = self.engine.settle(extra[k], left[k], settled[k - 1])
                if not fits or not start[k].same(end[k - 1]):
                    wrong.append(k)
            if not wrong:
                break
            for g, n in zip(*np.unique(of[wrong], return_counts=True)):
                if len(walks) > self.engine.rewalks or self.engine.rewalks == 1 and n * 4 > cut[g]:
                    k = next(k for k in wrong if of[k] == g)
                    rest = (of == g) & (np.arange(len(keys)) > k)
                    hi[k], later[rest], by[rest] = over[k], False, -1
                    hi[rest] = lo[rest] = over[k]
                    wrong = [j for j in wrong if not rest[j]]
                    whole |= bool(g == len(segment) - 1)
            for k in wrong:
                start[k], extra[k] = end[k - 1], settled[k - 1]
            again = np.zeros(len(keys), dtype=bool)
            again[wrong] = True
            new_end, new_left, walked = self._walk(rows, frames, lo, np.where(again, hi, lo), {k: start[k] for k in wrong},
                                                   {k: extra[k] for k in wrong}, keys, True)
            by[again] = len(walks)
            walks.append(walked)
            for k in wrong:
                end[k], left[k] = new_end[k], new_left[k]
                if hi[k] == over[k]:  # pieces that went into this one end with it
                    for j in range(k + 1, len(keys)):
                        if of[j] != of[k]:
                            break
                        end[j], left[j] = end[k], left[k]
        for f in turns.tolist():
            k = int(np.searchsorted(begins, f))
            self.marks.append((group_keys[group[k]], False, start[k].digest(self.labels)))
        edge = rows.col["edge"][starts] if "edge" in rows.col else warm
        last = np.cumsum(pieces) - 1
        for g in range(len(group_keys) - bool(keep_open)):
            self._close(group_keys[g], edge[over[last[g]] - 1], end[last[g]])
        self.open_warm, self.open_edge = bool(warm[-1]), bool(edge[-1])
        self.open_key, self.open_bank, self.open_extra, self.open_whole = None, None, None, False
        if keep_open:
            self.open_key, self.open_bank, self.open_extra, self.open_whole = group_keys[-1], end[-1], settled[-1], whole
        for n, walked in enumerate(walks):
            if len(walks) > 1 or unseen.any():
                told = (by == n) & ~unseen
                walked = [{c: v[told[o["g"]]] for c, v in o.items()} for o in walked]
            yield from self._emit(walked, keys)

    def _close(self, key: tuple, edge: bool, bank: Bank) -> None:
        if edge:
            self.marks.append((key, True, bank.digest(self.labels)))

    def _walk(self, rows: Rows, frames: tuple, lo: np.ndarray, hi: np.ndarray, banks: dict, extras: dict, keys: list[tuple],
              report: bool) -> tuple[list[Bank], list, list[dict]]:
        """Walk frames ``lo`` to ``hi`` of every piece; gives its tracks and extra state at the end, and the output."""
        begin, stop = frames
        n = hi - lo
        going = np.flatnonzero(n)
        held = []
        for k in going.tolist():
            self.engine.enter(keys[k], extras.get(k))
            if k in banks and len(banks[k]):
                banks[k].g = np.full(len(banks[k]), k)
                held.append(banks[k])
        bank = held[0].join(*held[1:]) if held else self.engine.empty()
        ended, out = [self.engine.empty()], []
        for k in range(int(n.max(initial=0))):
            groups = going[n[going] > k]
            f = lo[groups] + k
            lengths = stop[f] - begin[f]
            idx = np.repeat(begin[f] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
            s = begin[f]
            step = Step(groups, rows["frame_id"][s], rows["ord"][s], rows["is_inf"][s], idx, np.repeat(groups, lengths))
            bank, fields = self.engine.step(bank, rows, step, keys)
            if report and fields is not None:
                out.append(fields)
            done = n[bank.g] <= k + 1
            if done.any():
                ended.append(bank.take(done))
                bank = bank.take(~done)
        ends = ended[0].join(*ended[1:]).parts(len(keys))
        left = [None] * len(keys)
        for k in going.tolist():
            left[k] = self.engine.leave(keys[k])
        return ends, left, out

    def _emit(self, walked: list[dict], keys: list[tuple]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for k, fields in enumerate(walked):
            walked[k] = None
            held.append(fields)
            size += len(fields["g"])
            if size >= EMIT_ROWS or k == len(walked) - 1:
                if size:
                    fields = {c: np.concatenate([e[c] for e in held]) for c in held[0]}
                    out = self.engine.batch(fields, keys, self.labels)
                    for c in self.show:
                        out = out.append_column(c, pa.array(np.array([key[self.keys.index(c)] for key in keys])[fields["g"]]))
                    yield out
                held, size = [], 0
