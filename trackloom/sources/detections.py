"""Reading, replaying and merging detection logs, and the frame clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import DETECTIONS


def normalise(df: DataFrame) -> DataFrame:
    """Fill the defaults of a raw detection row.

    A missing x1 or y1 falls back to a column x or y, other missing numbers become 0, a missing
    label is empty and a missing track state is "normal". Keypoints without confidence get 1.0.
    """
    have = set(df.columns)

    def col(name: str, *fallback: str, default=None) -> Column:
        tries = [F.col(c) for c in (name, *fallback) if c in have]
        if default is not None:
            tries.append(F.lit(default))
        return F.coalesce(*tries) if tries else F.lit(None)

    out = {
        "class_id": col("class_id", default=0), "label": col("label", default=""),
        "confidence": col("confidence", default=0.0),
        "x1": col("x1", "x", default=0.0), "y1": col("y1", "y", default=0.0),
        "x2": col("x2", default=0.0), "y2": col("y2", default=0.0),
        "track_state": col("track_state", default="normal"),
    }
    if "keypoints" in have:
        out["keypoints"] = F.transform("keypoints", lambda p: F.struct(
            p["x"].alias("x"), p["y"].alias("y"), F.coalesce(p["conf"], F.lit(1.0)).alias("conf")))
    return df.withColumns(out)


def read_detections(spark: SparkSession, path: str, fmt: str = "parquet",
                    columns: list[str] | None = None) -> DataFrame:
    """A recorded log with the defaults of missing values filled in; ``columns`` limits what the scan reads."""
    df = normalise(spark.read.schema(DETECTIONS).format(fmt).load(path))
    return df.select(*columns) if columns else df


def write_detections(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """A log laid out for slot pruning."""
    df.write.mode(mode).format(fmt).partitionBy("slot_id").save(path)


def stream_detections(spark: SparkSession, path: str, files_per_trigger: int = 1,
                      fmt: str = "parquet", schema=None) -> DataFrame:
    """Replay a recorded log as a stream, a number of files at a time."""
    return (spark.readStream.schema(schema or DETECTIONS).format(fmt)
            .option("maxFilesPerTrigger", files_per_trigger).load(path))


def frames_of(det: DataFrame) -> DataFrame:
    """The frames that hold at least one detection."""
    return det.groupBy("slot_id", "frame_id").agg(F.min("ts").alias("ts"))


def frame_clock(frames: DataFrame, det: DataFrame | None = None, stride: int = 1) -> DataFrame:
    """All processed frames with the inference flag and, given ``det``, the number of detections."""
    out = frames.withColumn("is_inference", F.col("frame_id") % stride == 0)
    if det is None:
        return out
    n = det.groupBy("slot_id", "frame_id").agg(F.count("*").alias("n_det"))
    return (out.join(n, ["slot_id", "frame_id"], "left")
            .withColumn("n_det", F.coalesce("n_det", F.lit(0))))


def merge_sources(*parts: DataFrame) -> DataFrame:
    """Detections of several detectors in one table; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def on_clock(counts: DataFrame, frames: DataFrame) -> DataFrame:
    """Counts per (slot_id, frame_id) on every frame of the clock; frames without counts get zeros."""
    names = [c for c in counts.columns if c not in ("slot_id", "frame_id")]
    return (frames.select("slot_id", "frame_id").distinct().join(counts, ["slot_id", "frame_id"], "left")
            .na.fill(0, names).select(*counts.columns))
