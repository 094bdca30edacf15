"""Rows of tracks put together by track inside a task, before they are written or sent anywhere.

A track is reported in each frame it lives, and most tracks are short. One row a track, with the frames in lists or with
what is asked of them, is a fraction of the rows and bytes. Blocks are packed one by one, so a track that lives on in the next
block, or in the next part of a session, has a row in each of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TRACK = ("slot_id", "birth_frame", "birth_det", "label")  # the same in all rows of a track
BIRTH = ("birth_frame", "birth_det")
BOX = ("x1", "y1", "x2", "y2")
RECORDS_DDL = {c: f"{c} {t}" for c, t in (
    ("slot_id", "int"), ("birth_frame", "bigint"), ("birth_det", "int"), ("label", "string"), ("first_frame", "bigint"),
    ("last_frame", "bigint"), ("frames_visible", "bigint"), *[(f"{e}_{c}", "double") for e in ("first", "last") for c in BOX],
    ("whole", "boolean"), ("frames", "array<bigint>"), ("counts", "array<bigint>"))}


def _by_track(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by track and frame, and where in it the tracks begin."""
    slot, frame, born, det = (t[c].to_numpy() for c in ("slot_id", "birth_frame", "birth_det", "frame_id"))
    order = np.lexsort((det, born, frame, slot))
    change = np.zeros(len(order), dtype=bool)
    change[:1] = True
    for v in (slot, frame, born):
        v = v[order]
        change[1:] |= v[1:] != v[:-1]
    return order, np.flatnonzero(change)


def _lists(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


class Packed:
    """A row a track; what is not the same in all its rows comes as lists in order of the frames."""

    def ddl(self, fields: dict[str, str], made: list[str]) -> dict[str, str]:
        return {c: fields[c] if c in TRACK else f"{c} array<{fields[c].split(' ', 1)[1]}>" for c in made}

    def pack(self, t: pa.Table, made: list[str]) -> pa.RecordBatch:
        order, starts = _by_track(t)
        rows, first = pa.array(order), pa.array(order[starts])
        cols = {c: _one(t[c]).take(first) if c in (*TRACK, "session") else _lists(_one(t[c]).take(rows), starts) for c in [*made, "session"]}
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


class Records:
    """A row a track: its first and last frame with their boxes and the number of frames; and by label and session a row
    with the number of tracks in each frame. ``whole`` tells that no other block has rows of the track."""

    def ddl(self, fields: dict[str, str], made: list[str]) -> dict[str, str]:
        return RECORDS_DDL

    def pack(self, t: pa.Table, made: list[str]) -> pa.RecordBatch:
        order, starts = _by_track(t)
        length = np.diff(np.append(starts, len(order)))
        first, last = order[starts], order[starts + length - 1]
        frame, tracks = t["frame_id"].to_numpy(), len(starts)
        unit = pd.DataFrame({c: t[c].to_pandas().to_numpy()[first] for c in ("slot_id", "label", "session", "part") if c in t.column_names})
        by = unit.groupby(list(unit.columns), sort=False)
        ends = by.ngroup().to_numpy()
        newest = np.full(by.ngroups, np.iinfo(np.int64).min)
        np.maximum.at(newest, ends, frame[last])
        # all live tracks are reported, so one that is not in the newest frame has ended
        whole = (frame[first] == t["birth_frame"].to_numpy()[first]) & (frame[last] < newest[ends])
        of, at = np.repeat(ends, length), frame[order]
        place = np.lexsort((at, of))
        of, at = of[place], at[place]
        change = np.append(True, (of[1:] != of[:-1]) | (at[1:] != at[:-1]))[:len(of)]
        begins = np.flatnonzero(change)
        units = np.searchsorted(of[begins], np.arange(by.ngroups))
        one = first[np.unique(ends, return_index=True)[1]]  # a row of each unit

        def column(c: str, values: np.ndarray | None, more: pa.Array | None = None) -> pa.Array:
            kind = RECORDS_TYPES[c]
            return pa.concat_arrays([pa.nulls(tracks, kind) if values is None else pa.array(values).cast(kind),
                                     pa.nulls(by.ngroups, kind) if more is None else more.cast(kind)])

        cols = {c: pa.concat_arrays([_one(t[c]).take(pa.array(first)), _one(t[c]).take(pa.array(one))]) for c in ("slot_id", "label", "session")}
        cols |= {c: column(c, t[c].to_numpy()[first]) for c in BIRTH}
        cols |= {"first_frame": column("first_frame", frame[first]), "last_frame": column("last_frame", frame[last]),
                 "frames_visible": column("frames_visible", length), "whole": column("whole", whole)}
        for end, rows in (("first", first), ("last", last)):
            cols |= {f"{end}_{c}": column(f"{end}_{c}", t[c].to_numpy()[rows]) for c in BOX}
        cols["frames"] = column("frames", None, _lists(pa.array(at[begins]), units))
        cols["counts"] = column("counts", None, _lists(pa.array(np.diff(np.append(begins, len(of)))), units))
        names = [*RECORDS_DDL, "session"]
        return pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(),
          "array<bigint>": pa.list_(pa.int64())}
RECORDS_TYPES = {c: _ARROW[f.split()[1]] for c, f in RECORDS_DDL.items()}


def unpacked(tracks: DataFrame, *named: str) -> DataFrame:
    """The rows of :class:`Packed` tracks; columns ``named`` are those of the track beside ``TRACK``."""
    same = [c for c in tracks.columns if c in TRACK or c in named]
    lists = [c for c in tracks.columns if c not in same]
    return tracks.select(*same, F.inline(F.arrays_zip(*lists)))


def records_of(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the rows of :class:`Records`: one record a track, and the number of tracks in each frame, by run and slot."""
    key = ["run", "slot_id", *BIRTH]
    rows = done.filter("frames IS NULL").select(*key, "first_frame", "last_frame", "frames_visible", "whole", *[
        F.struct(*[F.col(f"{e}_{c}").alias(c) for c in BOX]).alias(f"{e}_box") for e in ("first", "last")])
    joined = rows.filter("NOT whole").groupBy(*key).agg(
        F.min("first_frame").alias("first"), F.max("last_frame").alias("last_frame"), F.sum("frames_visible").alias("frames_visible"),
        F.min_by("first_box", "first_frame").alias("first_box"), F.max_by("last_box", "last_frame").alias("last_box"))
    frames = (done.filter("frames IS NOT NULL").select("run", "slot_id", F.inline(F.arrays_zip("frames", "counts")))
              .groupBy("run", "slot_id", F.col("frames").alias("frame_id")).agg(F.sum("counts").alias("n")))
    return rows.filter("whole").drop("whole").unionByName(joined.withColumnRenamed("first", "first_frame")), frames
