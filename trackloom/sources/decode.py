"""Raw detector outputs to detection rows.

Input rows carry ``pred array<double>`` (one candidate) with the frame keys, a candidate index
``det_idx`` and the letterbox: ``scale, pad_x, pad_y, frame_w, frame_h``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import clamp01
from ..functions.rows import once
from ..operators.suppress import DETECTOR_RULE, suppress

# The COCO class names by id.
COCO = [
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light",
    "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat", "dog", "horse", "sheep", "cow", "elephant",
    "bear", "zebra", "giraffe", "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard",
    "sports ball", "kite", "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket", "bottle",
    "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich", "orange", "broccoli",
    "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch", "potted plant", "bed", "dining table", "toilet",
    "tv", "laptop", "mouse", "remote", "keyboard", "cell phone", "microwave", "oven", "toaster", "sink",
    "refrigerator", "book", "clock", "vase", "scissors", "teddy bear", "hair drier", "toothbrush",
]


def _label(cls: Column, fallback: Column) -> Column:
    names = F.array(*[F.lit(n) for n in COCO])
    return F.coalesce(F.get(names, cls), fallback)


def _unletterbox(df: DataFrame) -> DataFrame:
    """Corners in frame coordinates; boxes thinner than 1e-5 are dropped."""
    p = F.col("pred")

    def corner(centre: int, size: int, sign: float, pad: str, frame: str) -> Column:
        return clamp01((p[centre] + sign * p[size] * 0.5 - F.col(pad)) / F.col("scale") / F.col(frame))

    return once(df, x1=corner(0, 2, -1.0, "pad_x", "frame_w"), y1=corner(1, 3, -1.0, "pad_y", "frame_h"),
                 x2=corner(0, 2, 1.0, "pad_x", "frame_w"), y2=corner(1, 3, 1.0, "pad_y", "frame_h")
                 ).filter("x2 - x1 > 1e-5 AND y2 - y1 > 1e-5")


def _argmax(df: DataFrame, scores: Column, conf: float) -> DataFrame:
    best = once(df, _s=scores, confidence=F.array_max(scores)).filter(F.col("confidence") >= conf)
    return best.withColumn("class_id", (F.array_position("_s", F.col("confidence")) - 1).cast("int")).drop("_s")


def decode_detect(df: DataFrame, conf: float = 0.25) -> DataFrame:
    """Rows ``[cx, cy, w, h, class scores...]`` to detections after label-aware NMS."""
    p = F.col("pred")
    kept = _argmax(df.filter(F.size(p) >= 5), F.slice(p, 5, F.size(p) - 4), conf)
    rows = _unletterbox(kept).withColumn("label", _label(F.col("class_id"), F.col("class_id").cast("string")))
    out = rows.select("slot_id", "frame_id", "det_idx", "class_id", "label", "confidence", "x1", "y1", "x2", "y2")
    return suppress(out, ["slot_id", "frame_id"], [-F.col("confidence")], DETECTOR_RULE, source=df)


def decode_pose(df: DataFrame, conf: float = 0.25) -> DataFrame:
    """Rows with 17 keypoints in the last 51 values; 56-value rows have a single score."""
    p, n = F.col("pred"), F.size("pred")
    scores = F.when(n == 56, F.slice(p, 5, 1)).otherwise(F.slice(p, 5, F.greatest(n - 55, F.lit(0))))
    kept = _argmax(df.filter(n >= 56), scores, conf)
    start = F.col("_k")

    def at(j: Column, i: int, pad: str, frame: str) -> Column:
        return clamp01((F.get(p, start + j * 3 + i) - F.col(pad)) / F.col("scale") / F.col(frame))

    pts = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: F.struct(
        at(j, 0, "pad_x", "frame_w").alias("x"), at(j, 1, "pad_y", "frame_h").alias("y"),
        F.get(p, start + j * 3 + 2).alias("conf")))
    rows = (_unletterbox(kept).withColumn("_k", n - 51)
            .withColumns({"label": _label(F.col("class_id"), F.lit("person")), "keypoints": pts}))
    out = rows.select("slot_id", "frame_id", "det_idx", "class_id", "label", "confidence",
                      "x1", "y1", "x2", "y2", "keypoints")
    return suppress(out, ["slot_id", "frame_id"], [-F.col("confidence")], DETECTOR_RULE, source=df)


def decode_scored(df: DataFrame, conf: float = 0.25) -> DataFrame:
    """Rows ``[score, class, cx, cy, w, h]`` already in frame coordinates to person detections."""
    p = F.col("pred")
    return df.filter(p[0] >= conf).select(
        "slot_id", "frame_id", "det_idx", F.lit("person").alias("label"), p[0].alias("confidence"),
        clamp01(p[2] - p[4] * 0.5).alias("x1"), clamp01(p[3] - p[5] * 0.5).alias("y1"),
        clamp01(p[2] + p[4] * 0.5).alias("x2"), clamp01(p[3] + p[5] * 0.5).alias("y2"))
