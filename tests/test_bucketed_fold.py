"""Rules along one hot camera or over all rows, cut into buckets, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import monitor as mn
from trackloom.operators.fold import by_key
from trackloom.operators.materialize import cut_lineage
from trackloom.operators.timeline import ordinal, running_totals
from trackloom.operators.tracking import smooth

LOG = "slot_id int, frame_id bigint, ts double"


def kept_by_loop(rows, gap_us):
    last, kept = {}, []
    for slot, frame, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        us = round(ts * 1e6)
        if slot not in last or us - last[slot] >= gap_us:
            kept.append((slot, frame))
            last[slot] = us
    return kept


@pytest.mark.parametrize("interval", [0.5, 1.0, 7.3])
def test_throttle_equals_the_loop(spark, interval):
    """Dense stretches, pauses of many buckets, equal times and times below zero."""
    rng = random.Random(interval)
    rows, t = [], -20.0
    for i in range(3000):
        t += rng.choice([0.0, 0.01, 0.1, 0.1, 0.5, 1.0]) if i % 700 else 95.0
        rows.append((0, i, round(t, 3)))
    rows += [(1, i, i * 0.25) for i in range(800)] + [(2, 5, 1.0)]
    df = spark.createDataFrame(rows, LOG)
    got = sorted((r.slot_id, r.frame_id) for r in mn.throttle(df, interval, bucket_s=3.0).collect())
    assert got == sorted(kept_by_loop(rows, round(interval * 1e6)))


def test_a_live_camera_spreads_over_tasks(spark):
    df = spark.range(200_000).select(F.lit(0).alias("slot_id"), F.col("id").alias("frame_id"), (F.col("id") / 30).alias("ts"))
    kept = mn.throttle(df, 0.5, bucket_s=60.0)
    assert kept.count() == -(-200_000 // 15)
    assert len(kept.groupBy(F.spark_partition_id()).count().collect()) == 4


def test_throttle_of_rows_without_time_and_of_no_rows(spark):
    assert mn.throttle(spark.createDataFrame([], LOG), 1.0).count() == 0
    df = spark.createDataFrame([(0, 1, None), (0, 2, 3.0)], LOG)
    assert [r.frame_id for r in mn.throttle(df, 1.0).collect()] == [2]


def episodes_by_loop(rows, recovery, required):
    out, lifted, good = [], {}, {}
    for slot, frame, mean, ok in sorted(rows):
        if lifted.get(slot, True):
            if not ok:
                lifted[slot], good[slot] = False, 0
                out.append((slot, frame, "fallback"))
        elif ok:
            good[slot] = good[slot] + 1 if mean >= recovery else 0
            if good[slot] == required:
                lifted[slot] = True
                out.append((slot, frame, "restore"))
    return out


@pytest.mark.parametrize("block", [7, 50, 4096])
def test_episodes_equal_the_loop_at_every_block_size(spark, block):
    rng = random.Random(block)
    rows = []
    for slot in range(3):
        mean = 0.5
        for frame in range(1500):
            mean = min(0.9, max(0.1, mean + rng.uniform(-0.06, 0.062)))
            rows.append((slot, frame * (1 if slot else 3), mean, mean >= 0.35))
    df = spark.createDataFrame(rows, "slot_id int, frame_id bigint, recent_mean double, healthy boolean")
    got = mn.health_episodes(df, recovery=0.5, required=12, block=block)
    want = episodes_by_loop(rows, 0.5, 12)
    assert sorted((r.slot_id, r.frame_id, r.event) for r in got.collect()) == sorted(want)
    assert len(want) > 10
    means = {(s, f): m for s, f, m, _ in rows}
    assert all(r.recent_mean == means[r.slot_id, r.frame_id] for r in got.collect())


def test_running_totals_over_the_whole_table(spark):
    rng = random.Random(3)
    order = rng.sample(range(10 ** 9), 2000)
    df = spark.createDataFrame([(i, v, i % 7) for i, v in enumerate(order)], "id int, at bigint, amount int")
    got = {r.at: (r.total, r.none) for r in running_totals(df, ["at"], total=F.col("amount"), none=F.lit(None).cast("int")).collect()}
    total = 0
    for at, amount in sorted((v, i % 7) for i, v in enumerate(order)):
        total += amount
        assert got[at] == (total, 0)
    n = {r.at: r.ordinal for r in ordinal(df, [], ["at"]).collect()}
    assert [n[v] for v in sorted(order)] == list(range(1, 2001))
    assert ordinal(df.limit(0), [], ["at"]).count() == 0


@pytest.mark.parametrize("alpha", [0.01, 0.85, 1.0])
def test_ema_of_one_long_piece(spark, alpha):
    rng = random.Random(8)
    values = [rng.uniform(-5, 5) for _ in range(20_000)]
    df = spark.createDataFrame([(1, i, v, "x") for i, v in enumerate(values)], "k int, t bigint, v double, _row string")
    got = {r.t: r.ema for r in smooth.ema(df, alpha, ["k"], ["t"], "v", piece=15_000).collect()}
    mean = values[0]
    for i, v in enumerate(values):
        mean = mean if i == 0 else alpha * v + (1 - alpha) * mean
        assert got[i] == pytest.approx(mean, abs=1e-12)


def test_embedding_mean_over_tails_is_that_of_whole_tracks(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 8))
    rows = []
    for i in range(6000):
        track = 0 if i % 3 else i % 5
        v = base[track % 3] + rng.normal(size=8) * 0.3
        rows.append((track, i, (v / np.linalg.norm(v)).tolist()))
    # opposed vectors do not let the past fade: this track has to be folded whole
    rows += [(9, i, [1.0, 0.0] if i % 2 else [-1.0, 0.0]) for i in range(50)]
    rows += [(10, 1, [0.6, 0.8]), (11, 1, None)]
    df = spark.createDataFrame(rows, "track_id long, i long, embedding array<double>")
    want = {}
    for track, _, v in rows:
        if v is not None:
            v = np.array(v)
            mean, n = want.get(track, (None, 0))
            mean = v if mean is None else 0.8 * mean + 0.2 * v
            want[track] = mean / np.linalg.norm(mean), n + 1
    for tail in (40, 256):
        got = {r.track_id: (r.embedding, r.n) for r in smooth.embedding_ema(df, ["track_id"], "i", tail=tail).collect()}
        assert got.keys() == want.keys()
        for track, (mean, n) in want.items():
            assert got[track][1] == n
            assert np.abs(np.array(got[track][0]) - mean).max() < 1e-9


def test_health_episodes_with_batches_that_have_no_event(spark):
    """The rows of the last slots come in batches without an event; before, their missing columns had no type."""
    df = spark.createDataFrame([(s, i, 0.9, s > 0 or i > 3) for s in range(3) for i in range(70)],
                               "slot_id int, frame_id bigint, recent_mean double, healthy boolean")
    rows = mn.health_episodes(df, recovery=0.5, required=60).collect()
    assert sorted((r.slot_id, r.frame_id, r.event) for r in rows) == [(0, 0, "fallback"), (0, 63, "restore")]
    assert mn.health_episodes(df.filter("slot_id = 1"), recovery=0.5, required=60).collect() == []


def test_keys_stay_whole_after_a_join_on_them(spark):
    """Spark used to leave out the exchange after such a join; turned into a broadcast join, it deals the rows of a key over several tasks."""
    rows = cut_lineage(spark.range(100).selectExpr("id % 2 AS k", "id"))
    few = cut_lineage(spark.range(2).selectExpr("id AS k", "id AS v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = by_key(rows.join(few, "k", "left"), ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "REPARTITION_BY_NUM" in plan
