"""User models over frames and user functions over the detections of a frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.fold import by_key

SCORED_DDL = ("slot_id int, frame_id bigint, ts double, det_idx int, class_id int, label string, "
              "confidence double, x1 double, y1 double, x2 double, y2 double")


def score_frames(frames: DataFrame, loader: Callable[[], Callable], conf: float = 0.25,
                 image: str = "image") -> DataFrame:
    """Run a detector over frames.

    ``loader()`` is called once per task and returns ``predict_batch(images) -> list of lists of
    dicts`` (class_id, label, confidence, x1, y1, x2, y2). Frames without image give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = None
        for pdf in batches:
            pdf = pdf[pdf[image].notna()]
            if pdf.empty:
                continue
            predict = predict or loader()
            rows = []
            for (slot, frame, ts), dets in zip(
                    pdf[["slot_id", "frame_id", "ts"]].itertuples(index=False), predict(list(pdf[image]))):
                kept = [d for d in dets if d["confidence"] >= conf]
                rows += [(slot, frame, ts, i, d.get("class_id", 0), d.get("label", ""), d["confidence"],
                          d["x1"], d["y1"], d["x2"], d["y2"]) for i, d in enumerate(kept)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCORED_DDL.split(", ")])

    return frames.select("slot_id", "frame_id", "ts", image).mapInPandas(run, SCORED_DDL)


def process_frames(det: DataFrame, fn: Callable, schema: str, arrays: bool = False) -> DataFrame:
    """A user's processor: detections of one frame in, detections of that frame out.

    ``fn`` takes and gives a pandas table, or, with ``arrays``, a dict of numpy arrays by column, all of one length: a
    table a frame costs far more than most processors. None gives no rows. Frames are walked inside sorted partitions; a frame cut by the
    end of a batch waits for the next.
    """
    keys, names = ["slot_id", "frame_id"], [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last frame of a batch may go on in the next
        for pdf in batches:
            if pdf.empty:
                continue
            whole = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            change = np.zeros(len(whole), dtype=bool)
            change[0] = True
            for k in keys:
                v = whole[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(change).tolist()
            held = whole.iloc[starts[-1]:]
            yield from joined(whole, starts)
        if held is not None:
            yield from joined(held, [0, len(held)])

    def joined(rows: pd.DataFrame, starts: list[int]) -> Iterator[pd.DataFrame]:
        """What the processor makes of the frames; columns are put together once a batch."""
        columns = {c: [] for c in names}
        if arrays:
            whole = {c: rows[c].to_numpy() for c in rows.columns}
            for a, b in zip(starts, starts[1:]):
                out = fn({c: v[a:b] for c, v in whole.items()})
                if out is not None and len(out[names[0]]):
                    for c in names:
                        columns[c].append(out[c])
            if columns[names[0]]:
                yield pd.DataFrame({c: np.concatenate(v) for c, v in columns.items()}, copy=False)
            return
        for a, b in zip(starts, starts[1:]):
            frame = rows.iloc[a:b]
            frame.index = pd.RangeIndex(b - a)
            out = fn(frame)
            if out is not None and len(out):
                for c in names:
                    columns[c].append(out[c])
        if columns[names[0]]:
            yield pd.DataFrame({c: _stacked(v) for c, v in columns.items()})

    return by_key(det, keys, ["det_idx"]).mapInPandas(run, schema)


def _stacked(parts: list[pd.Series]):
    if len({p.dtype for p in parts}) == 1 and isinstance(parts[0].dtype, np.dtype):
        return np.concatenate([p.to_numpy() for p in parts])
    return pd.concat(parts, ignore_index=True)
