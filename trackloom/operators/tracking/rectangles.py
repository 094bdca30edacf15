"""Tracker of rectangles: linear filter, tracks choose first, confidence fades while unseen."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ...functions.presets import RECTANGLE_PRESETS
from ...sources.detections import on_clock
from ..suppress import RECTANGLE_TRACK_RULE, suppress
from . import filters
from .blocks import Bank, Engine, Rows, Step, named
from .job import AHEAD, NUMBERED, PART, fold_input, fold_sessions, number_tracks
from .tracker import iou

EVENTS = ["matched", "new", "predicted"]
DDL = ("slot_id int, frame_id bigint, birth_frame bigint, birth_det int, label string, confidence double, "
       "x1 double, y1 double, x2 double, y2 double, track_hits int, track_misses int, "
       "predicted_only boolean, event string, deleted boolean")
POLY_DDL = ", polygon array<struct<x:double,y:double>>"


@dataclass(frozen=True)
class RectangleConfig:
    iou_threshold: float = 0.25
    max_misses: int = 4
    min_hits: int = 2
    smooth_alpha: float = 0.65
    stride: int = 1


# Tracker settings by sensitivity; unknown levels use "low".
PRESETS = {k: RectangleConfig(p.match_iou, p.max_misses, p.min_hits, p.smooth_alpha) for k, p in RECTANGLE_PRESETS.items()}


def preset(level: str | None) -> RectangleConfig:
    return PRESETS.get(str(level or "low").lower(), PRESETS["low"])


def scores(a: np.ndarray, b: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Match score of box pairs and whether they may match."""
    overlap = iou(a, b) if len(a) else np.zeros(0)
    mid = ((a[:, :2] + a[:, 2:]) - (b[:, :2] + b[:, 2:])) * 0.5
    dist = np.sqrt((mid ** 2).sum(axis=1))
    sa, sb = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2]
    centre = np.maximum(0.0, 1.0 - dist / np.maximum((sa + sb).sum(axis=1) * 0.25 * 1.8, 0.08))
    sa, sb = np.maximum(1e-6, sa), np.maximum(1e-6, sb)
    size = (np.minimum(sa, sb) / np.maximum(sa, sb)).mean(axis=1)
    ok = ((overlap >= limit) | ((centre >= 0.72) & (size >= 0.58))
          | ((overlap >= 0.04) & (centre >= 0.58) & (size >= 0.45)))
    return overlap * 0.62 + centre * 0.26 + size * 0.12, ok


class RectangleTracker(Engine):
    """Engine for the block runner."""

    def __init__(self, cfg: RectangleConfig, with_polygon: bool):
        self.cfg, self.with_polygon = cfg, with_polygon

    def empty(self) -> Bank:
        z = np.zeros(0, dtype=np.int64)
        return self._new(z, z, z, z, np.zeros((0, 4)), np.zeros(0))

    def _new(self, g, frame, det, lab, box, conf) -> Bank:
        n = len(g)
        x, p, _ = filters.start(box)
        return Bank(g=g, birth_frame=frame, birth_det=det, lab=lab, box=box, conf=conf, x=x, p=p,
                    hits=np.ones(n, dtype=np.int64), misses=np.zeros(n, dtype=np.int64),
                    event=np.ones(n, dtype=np.int64), poly=np.zeros((n, 4, 2)), has_poly=np.zeros(n, dtype=bool))

    def step(self, t: Bank, rows: Rows, s: Step, block_keys: list[tuple]):
        cfg, a = self.cfg, self.cfg.smooth_alpha
        frame_of = np.zeros(len(block_keys), dtype=np.int64)
        frame_of[s.groups] = s.frame_id
        inf_of = np.zeros(len(block_keys), dtype=bool)
        inf_of[s.groups] = s.is_inf
        active = inf_of[t.g]
        if not s.is_inf.all():  # frames without inference leave rectangles as they are
            idle = t.take(~active)
            t = t.take(active)
        else:
            idle = None
        if len(t):
            t.x, t.p = filters.linear_predict(t.x, t.p)
            old, t.box = t.box, filters.corners(t.x)
            if t.has_poly.any():
                o_side = np.maximum(1e-6, old[:, None, 2:] - old[:, None, :2])
                n_side = np.maximum(1e-6, t.box[:, None, 2:] - t.box[:, None, :2])
                moved = np.clip(t.box[:, None, :2] + (t.poly - old[:, None, :2]) / o_side * n_side, 0.0, 1.0)
                t.poly = np.where(t.has_poly[:, None, None], moved, t.poly)
        use = (rows["kind"][s.rows] == 0) & inf_of[s.row_group]
        d, dg = s.rows[use], s.row_group[use]
        d_box = rows.box[d]
        d_conf = rows["confidence"][d]
        d_poly, d_has = np.zeros((len(d), 4, 2)), np.zeros(len(d), dtype=bool)
        if self.with_polygon:
            for k, i in enumerate(d):
                v = rows.vector("polygon", i)
                if v is not None and len(v) == 8:
                    d_poly[k], d_has[k] = v.reshape(4, 2), True

        mt, md = self._choose(t, dg, d_box)
        t.event = np.full(len(t), 2, dtype=np.int64)
        if len(mt):
            t.x[mt], t.p[mt] = filters.linear_correct(t.x[mt], t.p[mt], d_box[md])
            t.box[mt] = a * filters.corners(t.x[mt]) + (1.0 - a) * t.box[mt]
            both = (t.has_poly[mt] & d_has[md])[:, None, None]
            t.poly[mt] = np.where(both, a * d_poly[md] + (1.0 - a) * t.poly[mt], d_poly[md])
            t.has_poly[mt] = d_has[md]
            t.conf[mt] = 0.75 * d_conf[md] + 0.25 * t.conf[mt]
            t.hits[mt] += 1
            t.misses[mt] = 0
            t.event[mt] = 0
        t.misses[t.event == 2] += 1
        born = np.ones(len(d), dtype=bool)
        born[md] = False
        if born.any():
            new = self._new(dg[born], frame_of[dg[born]], rows["det_idx"][d[born]].astype(np.int64),
                            rows["label"][d[born]], d_box[born], d_conf[born])
            new.poly, new.has_poly = d_poly[born], d_has[born]
            t = t.join(new)
            t = t.take(np.argsort(t.g, kind="stable"))
        gone = t.misses > cfg.max_misses
        out = self._report(t, frame_of, gone) if len(t) else None
        t = t.take(~gone)
        if idle is not None and len(idle):
            t = t.join(idle)
            t = t.take(np.argsort(t.g, kind="stable"))
        return t, out

    def _choose(self, t: Bank, dg: np.ndarray, d_box: np.ndarray):
        """Older tracks choose first; each takes its best free rectangle, the first one on ties."""
        lo, hi = np.searchsorted(dg, t.g), np.searchsorted(dg, t.g, side="right")
        n = hi - lo
        if not n.sum():
            z = np.zeros(0, dtype=np.int64)
            return z, z
        pt = np.repeat(np.arange(len(t)), n)
        pd = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        score, ok = scores(t.box[pt], d_box[pd], self.cfg.iou_threshold)
        pt, pd, score = pt[ok], pd[ok], score[ok]
        taken, done, out = set(), -1, []
        for k in np.lexsort((pd, -score, pt)):
            track, det = int(pt[k]), int(pd[k])
            if track != done and det not in taken:
                taken.add(det)
                done = track
                out.append((track, det))
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    def _report(self, t: Bank, frame_of: np.ndarray, gone: np.ndarray | None = None) -> dict[str, np.ndarray]:
        gone = np.zeros(len(t), dtype=bool) if gone is None else gone
        fade = np.maximum(0.1, t.conf * (1.0 - t.misses / (self.cfg.max_misses + 1)))
        return dict(g=t.g, frame_id=frame_of[t.g], birth_frame=t.birth_frame, birth_det=t.birth_det, lab=t.lab,
                    conf=fade, box=t.box.copy(), hits=t.hits.copy(), misses=t.misses.copy(),
                    event=t.event.copy(), gone=gone, poly=t.poly.copy(), has_poly=t.has_poly.copy())

    def batch(self, d: dict[str, np.ndarray], block_keys: list[tuple], labels: dict[str, int]) -> pa.RecordBatch:
        slot = np.array([k[0] for k in block_keys], dtype=np.int32)
        cols = {
            "slot_id": pa.array(slot[d["g"]]), "frame_id": pa.array(d["frame_id"]),
            "birth_frame": pa.array(d["birth_frame"]), "birth_det": pa.array(d["birth_det"].astype(np.int32)),
            "label": named(d["lab"], [*labels]),
            "confidence": pa.array(d["conf"]),
            **{c: pa.array(d["box"][:, i].copy()) for i, c in enumerate(("x1", "y1", "x2", "y2"))},
            "track_hits": pa.array(d["hits"].astype(np.int32)), "track_misses": pa.array(d["misses"].astype(np.int32)),
            "predicted_only": pa.array(d["misses"] > 0),
            "event": named(d["event"], EVENTS), "deleted": pa.array(d["gone"]),
        }
        if self.with_polygon:
            cols["polygon"] = pa.array([
                [{"x": x, "y": y} for x, y in p] if h else None for p, h in zip(d["poly"].tolist(), d["has_poly"])],
                pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def rectangle_steps(det: DataFrame, frames: DataFrame | None = None, cfg: RectangleConfig = PRESETS["low"],
                    bucket: int = 65536, split_sessions: bool = True, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Every track in every frame, with what happened to it, before any output rule.

    All columns and ``track_id``, or the ``columns`` named; what these do not ask for is not made: numbers, and polygons,
    which change nothing else.
    """
    poly = "polygon" in det.columns and (columns is None or "polygon" in columns)
    numbered = columns is None or "track_id" in columns
    made = None if columns is None else list(dict.fromkeys([*(NUMBERED if numbered else ()), *(c for c in columns if c != "track_id")]))
    rows = fold_input(det, frames, cfg, None, False, ("polygon",) if poly else (), bucket, split_sessions, linger=1)
    done = fold_sessions(rows, lambda: {"": RectangleTracker(cfg, poly)}, DDL + (POLY_DDL if poly else ""), {}, "rectangles", False,
                         made, *((PART, AHEAD) if split_sessions else ())).drop("run")
    done = number_tracks(done, bucket) if numbered else done
    return done if columns is None else done.select(*columns)


def visible_rectangles(steps: DataFrame, cfg: RectangleConfig = PRESETS["low"]) -> DataFrame:
    """The rectangles to show: confirmed, alive, and not covered by a better one."""
    shown = steps.filter((F.col("track_hits") >= cfg.min_hits) & ~F.col("deleted"))
    order = [-F.col("track_hits"), F.col("track_misses"), -F.col("confidence")]
    return suppress(shown, ["slot_id", "frame_id"], order, RECTANGLE_TRACK_RULE, tie="track_id")


def track_rectangles(det: DataFrame, frames: DataFrame | None = None, level: str = "low") -> DataFrame:
    cfg = preset(level)
    return visible_rectangles(rectangle_steps(det, frames, cfg), cfg)


def rectangle_stats(steps: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Per frame the number of matched, coasting, new and deleted tracks.

    ``frames`` is the frame clock: its quiet frames are counted with zeros. Without it only frames with a track show.
    """
    e = F.col("event")
    stats = steps.groupBy("slot_id", "frame_id").agg(
        F.count_if(e == "matched").alias("matched"), F.count_if(e == "predicted").alias("predicted_only"),
        F.count_if(e == "new").alias("new"), F.count_if("deleted").alias("deleted"))
    return stats if frames is None else on_clock(stats, frames)
