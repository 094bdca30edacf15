"""Raw candidates are evaluated once where no frame of theirs is large."""

from pyspark.sql import functions as F, types as T

from trackloom.operators.suppress import DETECTOR_RULE, suppress
from trackloom.sources.decode import decode_pose


def candidates(spark, frames, per_frame):
    seen = spark.sparkContext.accumulator(0)

    def confidence(i):
        seen.add(1)
        return 0.5 + (i % 7) / 20.0

    count = F.udf(confidence, T.DoubleType()).asNondeterministic()
    rows = spark.range(frames * per_frame).select(
        F.lit(0).alias("slot_id"), F.floor(F.col("id") / per_frame).alias("frame_id"), (F.col("id") % per_frame).cast("int").alias("det_idx"))
    rows = rows.withColumn("c", count("det_idx"))
    at = F.col("det_idx") * 60.0
    return seen, rows.withColumns({"pred": F.array(100.0 + at, F.lit(300.0), F.lit(50.0), F.lit(50.0), F.col("c"),
                                                   *[at + j for j in range(51)]),
                                   "scale": F.lit(0.5), "pad_x": F.lit(0.0), "pad_y": F.lit(140.0), "frame_w": F.lit(1280.0),
                                   "frame_h": F.lit(720.0)}).drop("c")


def test_candidates_are_decoded_once(spark):
    seen, raw = candidates(spark, 5, 4)
    rows = decode_pose(raw, 0.4).collect()
    assert len(rows) == 20 and seen.value == 20
    one = next(r for r in rows if r.frame_id == 2 and r.det_idx == 3)
    assert [round(one.keypoints[16].x, 9), round(one.keypoints[16].y, 9), one.keypoints[16].conf] == [
        round((180.0 + 48) / 0.5 / 1280, 9), round((180.0 + 49 - 140) / 0.5 / 720, 9), 230.0]


def test_large_frames_of_the_source_are_counted_again(spark):
    _, raw = candidates(spark, 2, 6)
    df = raw.select("slot_id", "frame_id", "det_idx", F.lit("person").alias("label"), F.col("pred")[4].alias("confidence"),
                    F.col("det_idx").cast("double").alias("x1"), F.lit(0.0).alias("y1"), (F.col("det_idx") + 1.5).alias("x2"), F.lit(1.0).alias("y2"))
    kept = [{(r.frame_id, r.det_idx) for r in suppress(df, ["slot_id", "frame_id"], [-F.col("confidence")], DETECTOR_RULE, large_group=n,
                                                       source=raw).collect()} for n in (2000, 3)]
    assert kept[0] == kept[1] and kept[0]
