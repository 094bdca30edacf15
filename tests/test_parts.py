"""Sessions that are walked in parts by several tasks give the rows of one walk."""

import pytest
from pyspark.sql import functions as F

from trackloom.operators import quality as ql
from trackloom.operators.materialize import written as real
from trackloom.operators.tracking import blocks, job, rectangles as rt
from trackloom.operators.tracking.job import run_records, track, track_runs
from trackloom.operators.tracking.tracker import TrackerConfig

DDL = "slot_id int, frame_id long, det_idx int, label string, confidence double, x1 double, y1 double, x2 double, y2 double"


def camera(spark, still: bool, frames: int = 400):
    """A camera that is never quiet: boxes that jump among places, and one that is never lost if ``still``."""
    rows = []
    for f in range(frames):
        for i in range(3):
            fixed = still and i == 0
            x, y = (0.5, 0.5) if fixed else (0.1 * ((f * 7 + i * 5 + f * f) % 6), 0.1 * ((f * 3 + i * 4 + f // 5) % 6))
            rows.append((1, f, i, "rectangle" if i == 2 else "person", 0.4 + 0.05 * ((f + i) % 10), x, y, x + 0.2, y + 0.3))
    return spark.createDataFrame(rows, DDL).withColumn("ts", F.col("frame_id") * 0.1)


@pytest.fixture
def short_parts(monkeypatch):
    for module in (job, rt):
        monkeypatch.setattr(module, "PART", 128)
        monkeypatch.setattr(module, "AHEAD", 48)


def sorted_rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("still, stride", [(False, 1), (True, 3)])
def test_parts_give_the_rows_of_one_walk(spark, short_parts, still, stride):
    det = camera(spark, still)
    cfg = TrackerConfig(stride=stride, strategy="cascade")
    assert sorted_rows(track(det, None, cfg)) == sorted_rows(track(det, None, cfg, split_sessions=False))
    rect = rt.RectangleConfig(stride=stride)
    assert sorted_rows(rt.rectangle_steps(det, None, rect)) == sorted_rows(rt.rectangle_steps(det, None, rect, split_sessions=False))


def test_a_camera_that_is_never_quiet_spreads_over_tasks(spark, short_parts):
    """Before, its session was one task however long it was."""
    det = camera(spark, False)
    steps = rt.rectangle_steps(det, None, rt.RectangleConfig(), columns=("slot_id", "frame_id", "event", "deleted"))
    assert steps.select(F.input_file_name()).distinct().count() > 1
    runs = track_runs(det, None, {"a": TrackerConfig(), "b": TrackerConfig(strategy="greedy")})
    assert runs.filter("run = 'a'").select(F.input_file_name()).distinct().count() > 2


def test_named_columns_are_those_of_all(spark):
    det = camera(spark, True, 60)
    some = ("slot_id", "frame_id", "track_id", "x1")
    assert sorted_rows(track(det, columns=some)) == sorted_rows(track(det).select(*some))
    assert sorted_rows(track(det, columns=("frame_id", "label"))) == sorted_rows(track(det).select("frame_id", "label"))
    some = ("slot_id", "frame_id", "track_id", "event")
    assert sorted_rows(rt.rectangle_steps(det, columns=some)) == sorted_rows(rt.rectangle_steps(det).select(*some))


@pytest.mark.parametrize("still", [False, True])
def test_records_made_in_the_fold_are_those_of_the_rows(spark, short_parts, monkeypatch, still):
    """Tracks that live on in another block or part are put together; nothing the size of the rows is written."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 150)
    det = camera(spark, still)
    runs = {s: TrackerConfig(strategy=s) for s in ("greedy", "cascade")}
    records, per_frame = run_records(det, None, runs)
    rows = track_runs(det, None, runs)
    want = ql.track_records(rows, ("run", "slot_id"), ql.BIRTH)
    assert sorted_rows(records.select(*want.columns)) == sorted_rows(want)
    assert sorted_rows(per_frame) == sorted_rows(rows.groupBy("run", "slot_id", "frame_id").agg(F.count("*").alias("n")))
    clock = det.select("slot_id", "frame_id").distinct()
    got = ql.compare_records(*(d.withColumnRenamed("run", "strategy") for d in (records, per_frame)), clock, list(runs))
    assert sorted_rows(got) == sorted_rows(ql.compare_runs(rows.withColumnRenamed("run", "strategy"), clock, list(runs)))


def test_tracks_are_written_one_row_each(spark, monkeypatch):
    """Before, each frame of a track was written as a row and met the numbers as a row."""
    sizes = []
    monkeypatch.setattr(job, "written", lambda df, name="rows": sizes.append((name, out := real(df, name), out.count())) or out)
    rows = track(camera(spark, True), columns=("slot_id", "frame_id", "track_id", "x1"), digits=3)
    tracks = [n for name, _, n in sizes if name == "tracks"]
    assert tracks == [rows.select("track_id").distinct().count()] and rows.count() > 2 * tracks[0]
    assert rows.filter("x1 <> round(x1, 3)").isEmpty()
