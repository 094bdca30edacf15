"""Appearance vectors join admissible pairs, not the rows that are paired."""

from pyspark.sql import functions as F

from trackloom.operators.joins import match_costs

DDL = "slot_id int, frame_id bigint, label string, {} int, x1 double, y1 double, x2 double, y2 double, vec_id bigint"


def test_looked_up_vectors_give_the_same_costs(spark):
    boxes = [(0.1 * i, 0.1, 0.1 * i + 0.3, 0.5) for i in range(4)]
    t = spark.createDataFrame([(0, 1, "person", i, *b, i % 3) for i, b in enumerate(boxes)], DDL.format("track_id"))
    d = spark.createDataFrame([(0, 1, "person", i, *b, (i + 1) % 4) for i, b in enumerate(boxes)], DDL.format("det_idx"))
    looks = spark.createDataFrame([(i, [1.0, float(i), 0.5]) for i in range(3)], "vec_id bigint, embedding array<double>")
    looked = match_costs(t, d, reid=True, looks=looks)
    carried = match_costs(t.join(looks, "vec_id", "left"), d.join(looks, "vec_id", "left"), reid=True)
    cols = ["t_track_id", "d_det_idx", F.round("cost", 9).alias("cost")]
    assert looked.select(*cols).orderBy(*cols).collect() == carried.select(*cols).orderBy(*cols).collect()
    assert looked.count() > 4
