"""The two forms of suppression, ingest defaults and missing labels."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators.monitor import attr_carry, slot_cache
from trackloom.operators.suppress import DETECTOR_RULE, FINAL_RULE, ROI_RULE, suppress
from trackloom.operators.tracking.assign import solve_pairs
from trackloom.operators.tracking.job import track
from trackloom.sources.detections import normalise, on_clock, read_detections

SCHEMA = "slot_id int, frame_id long, det_idx int, label string, confidence double, x1 double, y1 double, x2 double, y2 double"


def boxes(seed, n):
    r, nan = random.Random(seed), float("nan")
    rows = []
    for i in range(n):
        x, y, w, h = r.random() * 0.5, r.random() * 0.5, r.random() * 0.3, r.random() * 0.3
        rows.append([0, i % 2, i, r.choice(["person", "rectangle", None, ""]), round(r.random(), 2), x, y, x + w, y + h])
    for k, bad in enumerate((None, nan)):
        for c in range(5, 9):
            rows.append([0, 0, 1000 + 10 * k + c, "person", 0.99, 0.1, 0.1, 0.6, 0.6])
            rows[-1][c] = bad
    rows += [[0, 0, 2000, "person", 0.9, 0.2, 0.2, 0.2, 0.5], [0, 0, 2001, "person", 0.9, 0.4, 0.2, 0.3, 0.5]]  # no area
    rows += [[0, 0, 3000 + i, None, 0.5, 0.1, 0.1, 0.4, 0.4] for i in range(4)] + [rows[0][:]] * 2  # copies
    return [tuple(x) for x in rows]


@pytest.mark.parametrize("rule", [DETECTOR_RULE, FINAL_RULE, ROI_RULE])
def test_both_forms_keep_the_same_rows(spark, rule):
    df = spark.createDataFrame(boxes(3, 120), SCHEMA)
    one, many = (sorted(map(str, suppress(df, ["slot_id", "frame_id"], [-F.col("confidence")], rule, large_group=n).collect())) for n in (10 ** 6, 5))
    assert one == many
    kept = {r.det_idx for r in suppress(df, ["slot_id", "frame_id"], [-F.col("confidence")], rule).collect()}
    assert {1000 + 10 * k + c for k in (0, 1) for c in range(5, 9)} <= kept and {2000, 2001} <= kept
    if rule is DETECTOR_RULE:
        assert len(kept & {3000, 3001, 3002, 3003}) <= 1  # missing labels suppress each other


@pytest.mark.parametrize("large_group", [10 ** 6, 3])
def test_tiny_copies_and_equal_priorities_at_every_size(spark, large_group):
    def kept(rows):
        df = spark.createDataFrame(rows, SCHEMA)
        return sorted((r.confidence, r.x1) for r in suppress(df, ["slot_id", "frame_id"], [-F.col("confidence")], DETECTOR_RULE, large_group=large_group).collect())

    tiny = (0, 0, 7, "person", 0.5, 0.5, 0.5, 0.50001, 0.50001)
    large = (0, 0, 8, "person", 0.4, 0.1, 0.1, 0.3, 0.3)
    assert kept([tiny] * 3 + [large] * 3) == [(0.4, 0.1)] + [(0.5, 0.5)] * 3
    # equal confidence and number: (0.2, ...) gives way to (0.21, ...) of a higher confidence, (0.7, ...) has no rival,
    # and of the two near 0.4 the first in the order of columns stays
    same = [(0, 0, 1, "person", 0.6, x, 0.1, x + 0.2, 0.3) for x in (0.2, 0.7)] + [(0, 0, 2, "person", 0.5, x, 0.6, x + 0.2, 0.8) for x in (0.4, 0.41)]
    assert kept([(0, 0, 0, "person", 0.9, 0.21, 0.1, 0.41, 0.3), *same]) == [(0.5, 0.4), (0.6, 0.7), (0.9, 0.21)]


def test_missing_labels_are_tracked(spark):
    rows = [(0, f, i, None if i else "person", 0.9, 0.1 + 0.3 * i, 0.1, 0.2 + 0.3 * i, 0.3, f / 10) for f in range(12) for i in range(2)]
    got = track(spark.createDataFrame(rows, SCHEMA + ", ts double")).collect()
    assert {r.label for r in got} == {"", "person"}


def test_defaults_on_reading(spark, tmp_path):
    raw = spark.createDataFrame([(0, 1, 0, None, None, None, 0.1, 0.2, 0.3)], SCHEMA)
    r = normalise(raw).first()
    assert (r.label, r.confidence, r.x1, r.track_state) == ("", 0.0, 0.0, "normal")
    raw.write.parquet(f"{tmp_path}/log")
    assert read_detections(spark, f"{tmp_path}/log").first().label == ""


def test_a_carried_value_ends_with_the_stride(spark):
    rows = [(0, 1, f, None if f in (10, 50) else "a") for f in (0, 3, 10, 50)]
    got = {r.frame_id: r.carried for r in attr_carry(spark.createDataFrame(rows, "slot_id int, track_id int, frame_id long, v string"), 5, "v").collect()}
    assert got == {0: "a", 3: "a", 10: None, 50: None}


def test_quiet_frames_count(spark):
    clock = spark.createDataFrame([(0, f, f / 10) for f in range(5)], "slot_id int, frame_id long, ts double")
    counts = spark.createDataFrame([(0, 2, 7)], "slot_id int, frame_id long, n long")
    assert sorted((r.frame_id, r.n) for r in on_clock(counts, clock).collect()) == [(0, 0), (1, 0), (2, 7), (3, 0), (4, 0)]
    det = spark.createDataFrame([(0, 2, 0, "person", 0.2)], "slot_id int, frame_id long, det_idx int, label string, ts double")
    last = slot_cache(det, ["label"], clock).first()
    assert last.frame_id == 4 and last.detections == []


def test_assignment_by_components_is_cheapest():
    import itertools

    import numpy as np
    r = random.Random(2)
    for _ in range(200):
        n, m = r.randrange(1, 5), r.randrange(1, 5)
        pairs = [(i, j, round(r.random() * 0.9, 3)) for i in range(n) for j in range(m) if r.random() < 0.6]
        cost = {(i, j): c for i, j, c in pairs}
        got = solve_pairs(*(np.array(x) for x in zip(*pairs))) if pairs else []
        chosen = [pairs[k] for k in got]
        assert len({p[0] for p in chosen}) == len({p[1] for p in chosen}) == len(chosen)
        best = min((-len(s), sum(cost[p] for p in s)) for k in range(min(n, m) + 1) for rows in itertools.combinations(range(n), k)
                   for cols in itertools.permutations(range(m), k) for s in [list(zip(rows, cols))] if all(p in cost for p in s))
        assert (-len(chosen), round(sum(p[2] for p in chosen), 6)) == (best[0], round(best[1], 6))


def test_rows_of_large_groups_are_made_once(spark, monkeypatch):
    """Before, what the rows are made of was evaluated in each of several reads."""
    from trackloom.operators import suppress as sp
    kept = []
    real = sp.written
    monkeypatch.setattr(sp, "written", lambda df, name="rows": kept.append(real(df, name)) or kept[-1])
    df = spark.range(60).selectExpr("CAST(id % 3 = 0 AS INT) AS g", "CAST(id AS INT) AS det_idx", "'a' AS label", "id % 7 / 7 AS confidence",
                                    "id % 5 / 10 AS x1", "0.1D AS y1", "id % 5 / 10 + 0.2 AS x2", "0.4D AS y2")
    df = df.selectExpr("g", "det_idx", "label", *[f"CAST({c} AS DOUBLE) AS {c}" for c in ("confidence", "x1", "y1", "x2", "y2")])
    large = sp.suppress(df, ["g"], [-df["confidence"]], sp.DETECTOR_RULE, large_group=30)
    assert [d.select("g").distinct().collect()[0].g for d in kept] == [0] and kept[0].count() == 40
    assert sorted(map(str, large.collect())) == sorted(map(str, sp.suppress(df, ["g"], [-df["confidence"]], sp.DETECTOR_RULE).collect()))
