"""Rows meet the poses of their frame in one join."""

from pyspark.sql import functions as F

from trackloom.operators.joins import merge_pose

BASE = "slot_id int, frame_id bigint, det_idx int, x1 double, y1 double, x2 double, y2 double"
POSE = "slot_id int, frame_id bigint, det_idx int, keypoints array<struct<x:double,y:double,conf:double>>"


def points(x, conf, n=17):
    return [(x, 0.5, conf)] * n


def poses(spark):
    return spark.createDataFrame([(0, 1, 0, points(0.1, 0.5)), (0, 1, 1, points(0.12, 0.9)), (0, 1, 2, points(0.15, 0.9)),
                                  (0, 1, 3, points(0.6, 0.4)), (0, 1, 4, points(0.61, 1.0, 5)), (0, 2, 0, points(0.1, 0.9, 5))], POSE)


def noses(df):
    return sorted((r.frame_id, r.det_idx, r.x1, r.keypoints[0].x if r.keypoints else None) for r in df.collect())


def test_rows_of_one_index_take_the_pose_of_their_own_box(spark):
    """Before, both rows took the best pose of either box."""
    base = spark.createDataFrame([(0, 1, 7, 0.0, 0.0, 0.2, 1.0), (0, 1, 7, 0.5, 0.0, 0.7, 1.0), (0, 1, 8, 0.8, 0.0, 0.9, 1.0),
                                  (0, 2, 0, 0.0, 0.0, 1.0, 1.0), (0, 3, 0, 0.0, 0.0, 1.0, 1.0)], BASE)
    want = [(1, 7, 0.0, 0.12), (1, 7, 0.5, 0.6), (1, 8, 0.8, None), (2, 0, 0.0, None), (3, 0, 0.0, None)]
    out = merge_pose(base, poses(spark))
    assert noses(out) == want and out.columns == [*base.columns, "keypoints"]
    own = base.withColumn("keypoints", F.expr("array(struct(9D AS x, 9D AS y, 9D AS conf))"))
    assert noses(merge_pose(own, poses(spark))) == [*want[:-1], (3, 0, 0.0, 9.0)]


def test_rows_without_points_of_their_own_are_joined_once(spark):
    base = spark.createDataFrame([(0, 1, 7, 0.0, 0.0, 0.2, 1.0)], BASE)
    plan = merge_pose(base, poses(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
