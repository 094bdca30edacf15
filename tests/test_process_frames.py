"""A user's processor sees every frame whole, also where batches end inside frames."""

import pandas as pd

from trackloom.sources.scoring import process_frames


def test_frames_cut_by_batches_are_seen_whole(spark):
    rows = [(s, f, i) for s in range(2) for f in range(12) for i in range(f % 5 + 1)]
    det = spark.createDataFrame(rows, "slot_id int, frame_id bigint, det_idx int")

    def count(pdf):
        assert list(pdf.index) == list(range(len(pdf)))
        if pdf["frame_id"].iat[0] == 4:
            return None
        return pd.DataFrame({"frame_id": pdf["frame_id"], "n": len(pdf), "name": "a" if len(pdf) > 2 else None})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = [(r.frame_id, r.n, r.name) for r in process_frames(det, count, "frame_id bigint, n int, name string").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(f, f % 5 + 1, "a" if f % 5 + 1 > 2 else None) for _, f, _ in rows if f != 4]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_processors_on_arrays_give_the_rows_of_those_on_tables(spark):
    """Frames that are cut by batches, frames without rows out, and text columns."""
    det = spark.range(3000).selectExpr("CAST(id % 2 AS INT) AS slot_id", "id div 6 AS frame_id", "CAST(id % 6 AS INT) AS det_idx",
                                       "CASE WHEN id % 5 > 0 THEN CONCAT('l', id % 3) END AS label", "(id % 11) / 10 AS confidence")

    def table(pdf):
        return None if pdf["frame_id"].iat[0] % 7 == 0 else pdf[pdf["confidence"] > 0.2]

    def columns(frame):
        keep = frame["confidence"] > 0.2
        return None if frame["frame_id"][0] % 7 == 0 else {c: v[keep] for c, v in frame.items()}

    schema = "slot_id int, frame_id bigint, det_idx int, label string, confidence double"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = sorted(map(str, process_frames(det.withColumn("confidence", det.confidence.cast("double")), columns, schema, arrays=True).collect()))
        want = sorted(map(str, process_frames(det.withColumn("confidence", det.confidence.cast("double")), table, schema).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(got) > 1000
