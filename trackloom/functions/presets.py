"""Rectangle presets by sensitivity level."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RectanglePreset:
    least_area: float        # share of the frame that a quad covers at least
    most_area: float         # and at most
    least_confidence: float  # of a rectangle that is put out
    most_rectangles: int     # per frame
    match_iou: float         # tracker: overlap of a match
    max_misses: int          # tracker: frames without a match
    min_hits: int            # tracker: matches before a track shows
    smooth_alpha: float      # tracker: weight of the new box


# Fixed values.
RECTANGLE_PRESETS = {
    "low": RectanglePreset(0.015, 0.40, 0.60, 1, 0.18, 5, 1, 0.72),
    "medium": RectanglePreset(0.01, 0.45, 0.55, 2, 0.16, 6, 1, 0.70),
    "high": RectanglePreset(0.006, 0.55, 0.50, 3, 0.14, 8, 1, 0.68),
}
QUAD_ASPECT = (0.18, 5.5)  # sides of a quad, at every level
