"""Box, polygon and region geometry as Spark columns.

Coordinates are normalised to [0, 1] unless a name ends in ``_px``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .presets import QUAD_ASPECT, RECTANGLE_PRESETS


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "", of: Column | None = None) -> Box:
    """The four corner columns named ``<prefix>x1 ...``, or the fields of a struct."""
    if of is not None:
        return Box(of["x1"], of["y1"], of["x2"], of["y2"])
    return Box(*(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def overlap(a: Box, b: Box) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    h = F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    return w * h


def area(b: Box, clamped: bool = False) -> Column:
    w, h = b.x2 - b.x1, b.y2 - b.y1
    if clamped:
        w, h = F.greatest(F.lit(0.0), w), F.greatest(F.lit(0.0), h)
    return w * h


def box_iou(a: Box, b: Box, variant: str = "tracker") -> Column:
    """Intersection over union.

    The variants differ on degenerate boxes only: ``tracker`` lets areas go negative,
    ``clamped`` cuts side lengths at zero, and ``eval`` also divides by at least 1e-10
    instead of returning 0 for a tiny union.
    """
    inter = overlap(a, b)
    clamped = variant != "tracker"
    union = area(a, clamped) + area(b, clamped) - inter
    if variant == "eval":
        touching = (F.least(a.x2, b.x2) <= F.greatest(a.x1, b.x1)) | (
            F.least(a.y2, b.y2) <= F.greatest(a.y1, b.y1))
        return F.when(touching, 0.0).otherwise(inter / F.greatest(union, F.lit(1e-10)))
    return F.when(union > 1e-8, inter / union).otherwise(0.0)


def box_centre(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) * 0.5, (b.y1 + b.y2) * 0.5


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def to_centre(df: DataFrame, floored: bool = False) -> DataFrame:
    """Corner form to ``cx, cy, width, height``; ``floored`` keeps sides at 1e-5 or more."""
    b = box()
    if floored:
        w = F.greatest(F.lit(1e-5), b.x2 - b.x1)
        h = F.greatest(F.lit(1e-5), b.y2 - b.y1)
        return df.withColumns({"cx": b.x1 + w * 0.5, "cy": b.y1 + h * 0.5, "width": w, "height": h})
    cx, cy = box_centre(b)
    return df.withColumns({"cx": cx, "cy": cy, "width": b.x2 - b.x1, "height": b.y2 - b.y1})


def with_rect(df: DataFrame) -> DataFrame:
    """Centre form to a ``rect`` struct of corners."""
    cx, cy, w, h = (F.col(c) for c in ("cx", "cy", "width", "height"))
    return df.withColumn("rect", F.struct(
        (cx - w / 2.0).alias("x1"), (cy - h / 2.0).alias("y1"),
        (cx + w / 2.0).alias("x2"), (cy + h / 2.0).alias("y2")))


# --- polygons: array<struct<x,y>> -------------------------------------------------------

def poly_area(p: Column) -> Column:
    """Shoelace area; 0 below three points."""
    after = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    terms = F.zip_with(p, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    return F.when(F.size(p) >= 3, F.abs(total) * 0.5).otherwise(0.0)


def poly_centre(p: Column) -> Column:
    """Vertex mean as ``struct<x,y>``."""
    n = F.size(p)
    sx = F.aggregate(p, F.lit(0.0), lambda s, t: s + t["x"])
    sy = F.aggregate(p, F.lit(0.0), lambda s, t: s + t["y"])
    return F.struct(
        F.when(n > 0, sx / n).otherwise(0.0).alias("x"),
        F.when(n > 0, sy / n).otherwise(0.0).alias("y"))


def poly_bbox(p: Column) -> Column:
    xs, ys = F.transform(p, lambda t: t["x"]), F.transform(p, lambda t: t["y"])
    zero = F.lit(0.0)
    return F.struct(
        F.coalesce(F.array_min(xs), zero).alias("x1"), F.coalesce(F.array_min(ys), zero).alias("y1"),
        F.coalesce(F.array_max(xs), zero).alias("x2"), F.coalesce(F.array_max(ys), zero).alias("y2"))


def shape_iou(a: Box, a_poly: Column, b: Box, b_poly: Column) -> Column:
    """IoU of polygon bounds when both shapes have four corners, else of the boxes."""
    both = (F.size(a_poly) == 4) & (F.size(b_poly) == 4)
    quad = box_iou(box(of=poly_bbox(a_poly)), box(of=poly_bbox(b_poly)))
    return F.when(both, quad).otherwise(box_iou(a, b))


def shape_centre(b: Box, p: Column) -> Column:
    cx, cy = box_centre(b)
    return F.when(F.size(p) >= 3, poly_centre(p)).otherwise(F.struct(cx.alias("x"), cy.alias("y")))


def order_quad(p: Column) -> Column:
    """Corners as top-left, top-right, bottom-right, bottom-left by extremes of x+y and y-x."""
    sums = F.transform(p, lambda t: t["x"] + t["y"])
    diffs = F.transform(p, lambda t: t["y"] - t["x"])

    def at(values: Column, extreme: Column) -> Column:
        return F.element_at(p, F.array_position(values, extreme).cast("int"))

    return F.array(at(sums, F.array_min(sums)), at(diffs, F.array_min(diffs)),
                   at(sums, F.array_max(sums)), at(diffs, F.array_max(diffs)))


QUAD_AREA_RATIO = {k: (p.least_area, p.most_area) for k, p in RECTANGLE_PRESETS.items()}


def preset_value(level: Column, table: dict[str, float], default: str = "low") -> Column:
    """Value of a preset chosen by a (case-insensitive) level column; unknown levels use ``default``."""
    pick = F.lower(level)
    out = F.lit(table[default])
    for name, value in table.items():
        out = F.when(pick == name, F.lit(value)).otherwise(out)
    return out


def quad_valid(p_px: Column, frame_w: Column, frame_h: Column, level: Column) -> Column:
    """Geometry rules for four ordered corners in pixels."""
    pt = [p_px[i] for i in range(4)]
    side = [distance(pt[i]["x"], pt[i]["y"], pt[(i + 1) % 4]["x"], pt[(i + 1) % 4]["y"])
            for i in range(4)]
    aspect = F.greatest(side[0], side[2]) / F.greatest(side[1], side[3], F.lit(1.0))
    b = box(of=poly_bbox(p_px))
    ratio = (b.x2 - b.x1) * (b.y2 - b.y1) / F.greatest(frame_w * frame_h * 1.0, F.lit(1.0))
    border = (b.x1 <= 2.0) | (b.y1 <= 2.0) | (b.x2 >= frame_w - 2.0) | (b.y2 >= frame_h - 2.0)
    low = preset_value(level, {k: v[0] for k, v in QUAD_AREA_RATIO.items()})
    high = preset_value(level, {k: v[1] for k, v in QUAD_AREA_RATIO.items()})
    min_side = F.greatest(F.lit(18.0), F.least(frame_w, frame_h) * 0.05)
    return ((F.least(*side) >= min_side) & aspect.between(*QUAD_ASPECT)
            & ~(border & (ratio > 0.35)) & (ratio >= low) & (ratio <= high))


# --- regions of interest ---------------------------------------------------------------

def _trunc(c: Column) -> Column:
    return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("int")


def compute_roi(b: Box, frame_w: Column, frame_h: Column, pad: float) -> Column:
    """Padded region in whole pixels, cut at the frame border."""
    cx, cy = box_centre(b)
    px, py = cx * frame_w, cy * frame_h
    bw, bh = (b.x2 - b.x1) * frame_w, (b.y2 - b.y1) * frame_h
    return F.struct(
        F.greatest(F.lit(0), _trunc(px - bw * 0.5 - bw * pad)).alias("x1"),
        F.greatest(F.lit(0), _trunc(py - bh * 0.5 - bh * pad)).alias("y1"),
        F.least(frame_w.cast("int"), _trunc(px + bw * 0.5 + bw * pad)).alias("x2"),
        F.least(frame_h.cast("int"), _trunc(py + bh * 0.5 + bh * pad)).alias("y2"))


def roi_gate(roi: Column, frame_w: Column, frame_h: Column,
             min_px: int = 24, max_ratio: float = 0.20) -> Column:
    """At least ``min_px`` on each side and at most ``max_ratio`` of the frame."""
    w, h = roi["x2"] - roi["x1"], roi["y2"] - roi["y1"]
    return (w >= min_px) & (h >= min_px) & (w * h <= frame_w * frame_h * max_ratio)


def roi_to_frame(c: Column, start_px: Column, size_px: Column, frame_px: Column) -> Column:
    return clamp01((start_px + c * size_px) / frame_px)


def map_roi_box(b: Box, roi: Column, frame_w: Column, frame_h: Column) -> Column:
    """A box found inside a region, in frame coordinates."""
    w, h = roi["x2"] - roi["x1"], roi["y2"] - roi["y1"]
    return F.struct(
        roi_to_frame(b.x1, roi["x1"], w, frame_w).alias("x1"),
        roi_to_frame(b.y1, roi["y1"], h, frame_h).alias("y1"),
        roi_to_frame(b.x2, roi["x1"], w, frame_w).alias("x2"),
        roi_to_frame(b.y2, roi["y1"], h, frame_h).alias("y2"))


def map_roi_landmarks(points: Column, roi: Column, frame_w: Column, frame_h: Column) -> Column:
    w, h = roi["x2"] - roi["x1"], roi["y2"] - roi["y1"]
    return F.transform(points, lambda p: F.struct(
        roi_to_frame(p["x"], roi["x1"], w, frame_w).alias("x"),
        roi_to_frame(p["y"], roi["y1"], h, frame_h).alias("y"),
        F.coalesce(p["z"], F.lit(0.0)).alias("z"),
        F.coalesce(p["conf"], F.lit(1.0)).alias("conf")))


def _warp(old: Box, new: Box, floor_new: bool):
    ox, oy = box_centre(old)
    nx, ny = box_centre(new)
    nw, nh = new.x2 - new.x1, new.y2 - new.y1
    if floor_new:
        nw, nh = F.greatest(F.lit(1e-5), nw), F.greatest(F.lit(1e-5), nh)
    sx = nw / F.greatest(F.lit(1e-5), old.x2 - old.x1)
    sy = nh / F.greatest(F.lit(1e-5), old.y2 - old.y1)
    return (lambda x: clamp01(nx + (x - ox) * sx)), (lambda y: clamp01(ny + (y - oy) * sy))


def warp_keypoints(points: Column, old: Box, new: Box) -> Column:
    """Keypoints moved and scaled with their box; a missing confidence becomes 0.5."""
    fx, fy = _warp(old, new, floor_new=False)
    return F.transform(points, lambda p: F.struct(
        fx(p["x"]).alias("x"), fy(p["y"]).alias("y"),
        F.coalesce(p["conf"], F.lit(0.5)).alias("conf")))


def warp_polygon(points: Column, old: Box, new: Box) -> Column:
    """Four corners moved and scaled about the box centre; other sizes stay as they are."""
    fx, fy = _warp(old, new, floor_new=True)
    moved = F.transform(points, lambda p: F.struct(fx(p["x"]).alias("x"), fy(p["y"]).alias("y")))
    return F.when(F.size(points) == 4, moved).otherwise(points)


def warp_polygon_corner(points: Column, old: Box, new: Box) -> Column:
    """Same move anchored at the top-left corner, with side floor 1e-6 (rectangle tracks)."""
    e = F.lit(1e-6)
    ow, oh = F.greatest(e, old.x2 - old.x1), F.greatest(e, old.y2 - old.y1)
    nw, nh = F.greatest(e, new.x2 - new.x1), F.greatest(e, new.y2 - new.y1)
    return F.transform(points, lambda p: F.struct(
        clamp01(new.x1 + (p["x"] - old.x1) / ow * nw).alias("x"),
        clamp01(new.y1 + (p["y"] - old.y1) / oh * nh).alias("y")))


def quality_gate(pred: Box, refined: Box, confidence: Column, original: Column,
                 conf_floor: float = 0.15, conf_ratio: float = 0.6, iou_floor: float = 0.35,
                 scale: tuple[float, float] = (0.5, 1.6)) -> Column:
    """Accept a refined box unless it is both weak and far off, or its size jumps."""
    weak = confidence < F.greatest(F.lit(conf_floor), original * conf_ratio)
    e = F.lit(1e-5)
    pw, ph = F.greatest(e, pred.x2 - pred.x1), F.greatest(e, pred.y2 - pred.y1)
    rw, rh = F.greatest(e, refined.x2 - refined.x1), F.greatest(e, refined.y2 - refined.y1)
    return (~(weak & (box_iou(pred, refined) < iou_floor))
            & (rw >= pw * scale[0]) & (rw <= pw * scale[1])
            & (rh >= ph * scale[0]) & (rh <= ph * scale[1]))
