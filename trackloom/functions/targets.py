"""Target identifiers and row conversions between detections, tracks, targets and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TARGET_ID = r"^S(\d+)-T(\d+)$"


def format_target_id(slot: Column, number: Column) -> Column:
    """``S<slot>-T<number>`` with at least four digits."""
    return F.format_string("S%d-T%04d", slot, number)


def parse_target_id(target_id: Column) -> Column:
    """``struct<slot, number>``; null when the text has another form."""
    return F.when(target_id.rlike(TARGET_ID), F.struct(
        F.regexp_extract(target_id, TARGET_ID, 1).cast("int").alias("slot"),
        F.regexp_extract(target_id, TARGET_ID, 2).cast("bigint").alias("number")))


def tracks_to_targets(tracks: DataFrame, priority: int = 0) -> DataFrame:
    """One target row per track row: ACTIVE while it is observed, LOST while frames are missing."""
    return tracks.select(
        format_target_id(F.col("slot_id"), F.col("track_id")).alias("target_id"), "slot_id", "track_id",
        F.lit(priority).alias("priority"),
        F.when(F.col("lost_frames") == 0, "ACTIVE").otherwise("LOST").alias("state"),
        F.create_map(F.lit("velocity"), F.format_string("(%s, %s)", F.col("vx").cast("string"), F.col("vy").cast("string")),
                     F.lit("age"), F.col("age").cast("string"),
                     F.lit("lost_frames"), F.col("lost_frames").cast("string")).alias("attributes"),
        F.col("ts").alias("last_seen"))


def detections_to_tracks(det: DataFrame) -> DataFrame:
    """Rows with a track id, in centre form, with velocity, age and lost frames at 0."""
    def num(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    x1, y1, x2, y2 = (num(c) for c in ("x1", "y1", "x2", "y2"))
    cls = F.coalesce(F.col("class_id"), F.lit(0)) if "class_id" in det.columns else F.lit(0)
    return det.filter(F.col("track_id").isNotNull()).select(
        "slot_id", "frame_id", "ts", F.col("track_id").cast("bigint").alias("track_id"),
        ((x1 + x2) * 0.5).alias("cx"), ((y1 + y2) * 0.5).alias("cy"),
        (x2 - x1).alias("width"), (y2 - y1).alias("height"),
        num("confidence").alias("score"), cls.alias("class_id"),
        F.coalesce(F.col("label"), F.lit("")).alias("class_name"),
        F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0).alias("age"), F.lit(0).alias("lost_frames"))


def events_to_snapshots(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshots of target events and, apart, the events whose target id cannot be read.

    ``payload`` is a map of strings, ``detection`` an optional struct
    (class_name, score, bbox struct<x,y,w,h>).
    """
    marked = events.withColumn("_id", parse_target_id(F.col("target_id")))
    ok, bad = marked.filter("_id IS NOT NULL"), marked.filter("_id IS NULL").drop("_id")
    track = F.coalesce(F.col("payload")["track_id"].cast("bigint"), F.col("_id")["number"])
    det = F.col("detection")

    def num(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    head = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("event_id"), F.col("event_id"))
    # payload entries win over the two leading ones, as they are written later
    rest = F.map_filter("payload", lambda k, _: k != "detection")
    lead = F.map_filter(head, lambda k, _: ~F.map_contains_key(rest, k))
    return ok.select(
        track.alias("target_id"), track.alias("local_id"), F.lit(None).cast("bigint").alias("global_id"),
        F.coalesce(det["class_name"], F.lit("unknown")).alias("label"), num(det["score"]).alias("confidence"),
        num(det["bbox"]["x"]).alias("cx"), num(det["bbox"]["y"]).alias("cy"),
        F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"),
        num(det["bbox"]["w"]).alias("width"), num(det["bbox"]["h"]).alias("height"),
        F.col("timestamp"), F.col("slot_id").alias("camera_id"),
        F.map_concat(lead, rest).alias("metadata")), bad


def project_snapshots(targets: DataFrame) -> DataFrame:
    """Snapshots of the ACTIVE targets that hold a track.

    ``target_id`` carries the number inside the target's id.
    """
    return (targets.filter((F.col("state") == "ACTIVE") & F.col("track_id").isNotNull())
            .select(parse_target_id(F.col("target_id"))["number"].alias("target_id"),
                    F.col("track_id").alias("local_id"), F.lit(None).cast("bigint").alias("global_id"),
                    F.col("class_name").alias("label"), F.col("score").alias("confidence"),
                    "cx", "cy", "vx", "vy", "width", "height", F.col("ts").alias("timestamp"),
                    F.col("slot_id").alias("camera_id")))


def enrich(df: DataFrame, attributes: Column | None = None, gesture: Column | None = None,
           health: Column | None = None) -> DataFrame:
    """Attach attributes, gesture and health; constants until a column is given."""
    return df.withColumns({
        "attributes": F.create_map().cast("map<string,string>") if attributes is None else attributes,
        "gesture": F.lit(None).cast("string") if gesture is None else gesture,
        "health": F.lit(1.0) if health is None else health})


def stamp(df: DataFrame, now: Column) -> DataFrame:
    """Source frame, source time and latency in milliseconds."""
    return df.withColumns({"source_frame_id": F.col("frame_id"), "source_ts": F.col("ts"),
                           "latency_ms": (now - F.col("ts")) * 1000.0})
