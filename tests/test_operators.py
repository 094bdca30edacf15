"""Suppression, time lines, lifecycle, monitoring and streams against plain Python on small data."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as g, targets as tg
from trackloom.operators import events as ev, lifecycle as lc, monitor as mn, suppress as sp
from trackloom.operators.tracking import smooth
from trackloom.operators.tracking.job import track
from trackloom.operators.timeline import Timeline, asof_forward, bucket_of
from trackloom.sources import snapshots as sn
from trackloom.streaming import run as rn, stateful as st

BOX = "slot_id int, frame_id bigint, det_idx int, label string, confidence double, x1 double, y1 double, x2 double, y2 double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    area = [max(0.0, z[2] - z[0]) * max(0.0, z[3] - z[1]) for z in (a, b)]
    union = sum(area) - inter
    return inter / union if union > 1e-8 else 0.0


def boxes(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.random() * 0.9, rng.random() * 0.9
        w, h = rng.choice([0.02, 0.05, 0.2]) * (0.5 + rng.random()), rng.choice([0.02, 0.05, 0.2]) * (0.5 + rng.random())
        rows.append((0, 1, i, rng.choice(["person", "rectangle", "cat"]), round(rng.random(), 2), x, y, x + w, y + h))
    hot = rows[0][3:]  # a third of the rows are copies of one box
    rows += [(0, 1, n + i, *hot) for i in range(n // 2)]
    return rows


@pytest.mark.parametrize("rule", [sp.DETECTOR_RULE, sp.FINAL_RULE, sp.QUAD_RULE])
def test_suppression_forms_agree(spark, rule):
    rows = boxes(150, 5)
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[2])):
        limit = rule.per_label.get(r[3]) if rule.per_label else rule.iou
        if limit is not None and any((not rule.same_label or k[3] == r[3]) and iou(k[5:], r[5:]) > limit for k in kept):
            continue
        kept.append(r)
    want = sorted(r[2] for r in kept)
    df = spark.createDataFrame(rows, BOX)
    for large in (10_000, 50):
        out = sp.suppress(df, ["slot_id", "frame_id"], [-F.col("confidence")], rule, large_group=large)
        assert sorted(r.det_idx for r in out.select("det_idx").collect()) == want


def test_timeline_matches_plain_windows(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 3), i * rng.choice([1, 1, 7]), i, rng.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t bigint, i bigint, v int")
    out = (Timeline(df, ["k"], ["t", "i"], bucket_of("t", 37)).lag(lg=F.col("v")).lead(ld=F.col("v")).running_sum(rs=F.col("v"))
           .ffill(ff=F.col("v")).bfill(bf=F.col("v")).suffix_min(sm=F.col("v")).run_start(9, st=F.col("t")).apply())
    got = {r.i: r for r in out.collect()}
    for k in range(4):
        seq = sorted([r for r in rows if r[0] == k], key=lambda r: (r[1], r[2]))
        start = None
        for n, r in enumerate(seq):
            vals = [s[3] for s in seq]
            seen, rest = [v for v in vals[:n + 1] if v is not None], [v for v in vals[n:] if v is not None]
            start = r[1] if n == 0 or r[1] - seq[n - 1][1] >= 9 else start
            o = got[r[2]]
            assert o.lg == (vals[n - 1] if n else None) and o.ld == (vals[n + 1] if n + 1 < len(vals) else None)
            assert (o.rs or 0) == sum(seen) and o.ff == (seen[-1] if seen else None)
            assert o.bf == (rest[0] if rest else None) and o.sm == (min(rest) if rest else None) and o.st == start


def test_asof_forward(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 31), (2, 1)], "k int, at bigint")
    clock = spark.createDataFrame([(1, 10, "a"), (1, 30, "b"), (2, 500, "c")], "k int, t bigint, n string")
    got = {(r.k, r.at): r.hit and r.hit.n for r in asof_forward(left, clock, ["k"], "at", "t", 8).collect()}
    assert got == {(1, 5): "a", (1, 10): "a", (1, 31): None, (2, 1): "c"}


def test_asof_forward_of_equal_times(spark):
    left = spark.createDataFrame([(1, 5), (1, 40)], "k int, at bigint")
    clock = spark.createDataFrame([(1, t, n) for t in (10, 60) for n in (7, 9, 3, 8, 4, 6)], "k int, t bigint, n int").repartition(5)
    got = {r.at: r.hit.n for r in asof_forward(left, clock, ["k"], "at", "t", 8).collect()}
    assert got == {5: 3, 40: 3}


def log(spark, rows):
    return spark.createDataFrame(rows, "slot_id int, track_id bigint, frame_id bigint, ts double")


def test_lifecycle_rules(spark):
    # track 7 is seen at 1 and 12; the slot has a frame each second, track 9 keeps it running to 60
    obs = [(0, 7, 1, 1.0), (0, 7, 12, 12.0)] + [(0, 9, t, float(t)) for t in range(1, 61)]
    clock = spark.createDataFrame([(0, t, float(t)) for t in range(1, 61)], "slot_id int, frame_id bigint, ts double")
    out = lc.lifecycle(log(spark, obs), clock, 5.0, 30.0)
    got = [(r.event, r.frame_id, r.generation) for r in out.filter("track_id = 7").orderBy("us").collect()]
    # lost at 1+5, recovered at 12, lost at 12+5, removed 30 s after the loss
    assert got == [("created", 1, 0), ("lost", 6, 0), ("recovered", 12, 0), ("lost", 17, 0), ("removed", 47, 0)]
    assert [r.frame_id for r in lc.lifecycle_counts(out).filter("removed = 1").collect()] == [47]
    ids = {r.track_id: r.target_id for r in lc.number_targets(out).select("track_id", "target_id").distinct().collect()}
    assert ids == {7: "S0-T0001", 9: "S0-T0002"}


def test_removed_track_starts_a_new_target(spark):
    obs = [(0, 7, 1, 1.0), (0, 7, 50, 50.0)] + [(0, 9, t, float(t)) for t in range(1, 61)]
    clock = spark.createDataFrame([(0, t, float(t)) for t in range(1, 61)], "slot_id int, frame_id bigint, ts double")
    out = lc.lifecycle(log(spark, obs), clock, 5.0, 30.0).filter("track_id = 7").orderBy("us").collect()
    assert [(r.event, r.generation) for r in out[:4]] == [("created", 0), ("lost", 0), ("removed", 0), ("created", 1)]


def test_sweeps_need_frames_of_the_same_slot(spark):
    obs = [(0, 7, 1, 1.0)] + [(1, 9, t, float(t)) for t in range(1, 61)]
    clock = spark.createDataFrame([(0, 1, 1.0)] + [(1, t, float(t)) for t in range(1, 61)], "slot_id int, frame_id bigint, ts double")
    out = lc.lifecycle(log(spark, obs), clock, 5.0, 30.0)
    assert [r.event for r in out.filter("slot_id = 0").collect()] == ["created"]


def test_locked_targets_do_not_go_stale(spark):
    obs = log(spark, [(0, 7, 1, 1.0)] + [(0, 9, t, float(t)) for t in range(1, 61)])
    clock = spark.createDataFrame([(0, t, float(t)) for t in range(1, 61)], "slot_id int, frame_id bigint, ts double")
    cmd = spark.createDataFrame([(0, 7, 2.0, "lock"), (0, 7, 20.0, "unlock"), (0, 7, 30.5, "remove")],
                                "slot_id int, track_id bigint, ts double, command string")
    out = lc.lifecycle_fsm(obs, cmd, clock, 5.0, 30.0).filter("track_id = 7").orderBy("us").collect()
    assert [(r.event, r.ts) for r in out] == [("created", 1.0), ("locked", 2.0), ("unlocked", 20.0), ("lost", 21.0), ("removed", 30.5)]


def walk_lifecycle(frames, seen, commands, stale, removal):
    """One track against the frames of its slot, frame by frame; commands after the frames of their time."""
    state, out, gen, at, earliest = None, [], 0, 0, 0
    steps = sorted([(t, 0, None) for t in frames] + [(t, 1, c) for t, c in commands])
    for t, _, command in steps:
        if command is None and t in seen:
            event = {None: "created", "ACTIVE": "updated", "LOST": "recovered", "LOCKED": "kept"}[state]
            state, at, earliest = ("LOCKED" if state == "LOCKED" else "ACTIVE"), t, t + stale
            out.append((event, t, gen))
        elif command is None and state == "ACTIVE" and t >= earliest:
            state, at = "LOST", t
            out.append(("lost", t, gen))
        elif command is None and state == "LOST" and t >= at + removal or command == "remove" and state == "LOST":
            out.append(("removed", t, gen))
            state, gen = None, gen + 1
        elif command == "lock" and state == "ACTIVE":
            state = "LOCKED"
            out.append(("locked", t, gen))
        elif command == "unlock" and state == "LOCKED":
            state, earliest = "ACTIVE", max(earliest, t + 1)
            out.append(("unlocked", t, gen))
    return out


def test_lifecycle_with_commands_against_frame_by_frame(spark):
    rng = random.Random(21)
    obs, told, clock, want = [], [], [], set()
    for slot in range(3):
        frames = sorted(rng.sample(range(1, 400), 160))
        clock += [(slot, 99, t, float(t)) for t in frames]
        for track in range(6):
            seen = set(rng.sample(frames, rng.choice([5, 25, 60])))
            commands = [] if track == 0 else [(t, rng.choice(["lock", "unlock", "remove", "none"])) for t in rng.sample(range(1, 400), 30)]
            obs += [(slot, track, t, float(t)) for t in seen]
            told += [(slot, track, float(t), c) for t, c in commands]
            want |= {(slot, track, *e) for e in walk_lifecycle(frames, seen, commands, 7, 15)}
    cmd = spark.createDataFrame(told + [(0, None, 5.0, "lock"), (0, 0, 5.0, None)], "slot_id int, track_id bigint, ts double, command string")
    out = lc.lifecycle_fsm(log(spark, obs), cmd, log(spark, clock).drop("track_id"), 7.0, 15.0, bucket_s=50.0).collect()
    assert {(r.slot_id, r.track_id, r.event, int(r.ts), r.generation) for r in out} == want and len(out) == len(want)


def test_transitions(spark):
    rows = [(a, b) for a in lc.STATES for b in lc.STATES]
    out = lc.validate_transitions(spark.createDataFrame(rows, "from_state string, to_state string")).collect()
    assert {(r.from_state, r.to_state) for r in out if r.legal} == set(lc.EDGES)
    assert {r.from_state for r in out if r.terminal} == {"REMOVED"}


def test_commands_of_one_time_go_by_name(spark):
    clock = spark.createDataFrame([(0, t, float(t)) for t in range(1, 9)], "slot_id int, frame_id bigint, ts double")
    cmd = spark.createDataFrame([(0, 7, 2.0, c) for c in ("unlock", "lock")], "slot_id int, track_id bigint, ts double, command string")
    out = lc.lifecycle_fsm(log(spark, [(0, 7, t, float(t)) for t in range(1, 5)]), cmd.coalesce(1), clock, 50.0, 50.0)
    assert [r.event for r in out.filter("frame_id = -1").collect()] == ["locked", "unlocked"]


def test_health_settles_ties_in_billionths(spark):
    assert (0.0 + 0.0 + 0.3) / 3 < 0.1  # by the order of the sum only
    tie = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.0, 0.0, 0.3])], "slot_id int, frame_id bigint, mean_conf double")
    assert all(r.healthy for r in mn.health(tie, history=3, threshold=0.1).collect())


def test_health_blocks_and_episodes(spark):
    conf = [0.6] * 100 + [0.0] * 100 + [0.91] * 220
    df = spark.createDataFrame([(0, f, c) for f, c in enumerate(conf)], "slot_id int, frame_id bigint, mean_conf double")
    h = mn.health(df, block=128)
    for r in h.collect():
        window = conf[max(0, r.frame_id - 89):r.frame_id + 1]
        assert r.recent_mean == pytest.approx(sum(window) / len(window))
        assert r.healthy == (len(window) < 90 or r.recent_mean >= 0.35 - 1e-12)
    episodes = [(r.event, r.frame_id) for r in mn.health_episodes(h).orderBy("frame_id").collect()]
    assert [e for e, _ in episodes] == ["fallback", "restore"]
    assert episodes[1][1] - next(f for f in range(200, 420) if sum(conf[f - 89:f + 1]) / 90 >= 0.55) == 59


def test_throttle_and_zero_interval(spark):
    rng = random.Random(4)
    times = sorted(round(rng.random() * 60, 3) for _ in range(400))
    df = log(spark, [(0, 1, i, t) for i, t in enumerate(times)])
    kept, last = [], None
    for i, t in enumerate(times):
        if last is None or round((t - last) * 1e6) >= 500000:
            kept.append(i)
            last = t
    assert sorted(r.frame_id for r in mn.throttle(df, 0.5, bucket_s=3.0).collect()) == kept
    assert mn.throttle(df, 0.0).count() == 400


def test_failure_runs(spark):
    flags = [1, 1, 1, 0, 0, 1, 0] + [1] * 65
    df = spark.createDataFrame([(0, i, bool(b)) for i, b in enumerate(flags)], "slot_id int, frame_id bigint, failed boolean")
    got = sorted((r.frame_id, r.event, r.run_length) for r in mn.failure_runs(df, bucket=8).collect())
    assert got == [(0, "failure", 1), (3, "recovered", 3), (5, "failure", 1), (6, "recovered", 1),
                   (7, "failure", 1), (36, "failure", 30), (66, "failure", 60)]


def test_ema_over_pieces(spark):
    vals = [random.Random(1).random() for _ in range(50)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "k int, t bigint, v double")
    got = {r.t: r.ema for r in smooth.ema(df, 0.3, ["k"], ["t"], "v", piece=7).collect()}
    m = vals[0]
    for i, v in enumerate(vals):
        m = m if i == 0 else 0.3 * v + 0.7 * m
        assert got[i] == pytest.approx(m)


def test_target_ids(spark):
    df = spark.createDataFrame([(0, 1), (3, 99), (0, 10000)], "s int, n bigint")
    ids = [r[0] for r in df.select(tg.format_target_id(F.col("s"), F.col("n"))).collect()]
    assert ids == ["S0-T0001", "S3-T0099", "S0-T10000"]


def test_degenerate_boxes(spark):
    a, b = g.box("a"), g.box("b")
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5)], [p + c for p in "ab" for c in ("x1", "y1", "x2", "y2")])
    assert [list(r) for r in df.select(*[g.box_iou(a, b, v) for v in ("tracker", "clamped", "eval")]).collect()] == [[0.0, 0.0, 0.0]]


def test_snapshot_round_trip_and_type_check(spark):
    s = spark.createDataFrame([(1, 1, None, "person", 0.5, 0.1, 0.2, 0.0, 0.0, 0.3, 0.4, 9.0, {"a": "b"})],
                              "target_id bigint, local_id bigint, global_id bigint, label string, confidence double, cx double, cy double, "
                              "vx double, vy double, width double, height double, timestamp double, metadata map<string,string>")
    good, bad = sn.parse_snapshots(sn.to_snapshot_json(s))
    r = good.collect()[0]
    assert (r.target_id, r.global_id, r.metadata, bad.count()) == (1, None, {"a": "b"}, 0)
    with pytest.raises(TypeError):
        sn.publish(s.drop("cx"), "noop")


def test_route_isolates_a_failing_sink(spark):
    e = spark.createDataFrame([("target.lost", True), ("target.lost", False), ("x", True)], "event_type string, typed boolean")
    got = {}

    def down(df):
        raise OSError("down")

    failed = ev.route(e, {"bad": ("*", down), "typed": ("TargetLostEvent", lambda d: got.update(typed=d.count())),
                          "text": ("target.lost", lambda d: got.update(text=d.count()))})
    assert got == {"typed": 1, "text": 2} and list(failed) == ["bad"]


def stream_of(spark, df, tmp_path, parts):
    """The rows of ``df`` as a stream of several micro-batches in frame order."""
    src = str(tmp_path / "in")
    for i in range(parts):
        df.filter((F.col("frame_id") >= i * 20) & (F.col("frame_id") < (i + 1) * 20)).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_stream_tracker_matches_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for f in range(80):
        for i in range(rng.randint(0, 3)):
            x = [0.1, 0.4, 0.7][i] + rng.random() * 0.02
            rows.append((0, f, i, ["person", "car"][i % 2], 0.5 + rng.random() / 2, x, 0.3, x + 0.15, 0.5))
    det = spark.createDataFrame(rows, BOX)
    frames = spark.range(80).selectExpr("0 AS slot_id", "id AS frame_id")
    batch = track(det, frames).collect()
    arr = det.groupBy("slot_id", "frame_id").agg(F.collect_list(F.struct(
        "det_idx", "label", "confidence", "x1", "y1", "x2", "y2")).alias("detections"))
    full = frames.join(arr, ["slot_id", "frame_id"], "left")
    out = rn.run_available(st.stream_tracker(stream_of(spark, full, tmp_path, 4)), "t").collect()

    def key(rs):
        return sorted((r.frame_id, r.track_id, r.track_state, r.hits, round(r.x1, 6)) for r in rs)

    assert key(out) == key(batch)


def test_stream_lifecycle_matches_batch(spark, tmp_path):
    rng = random.Random(11)
    rows = [(f % 2, rng.randint(1, 4), f, f * 1.5) for f in range(80)]
    df = log(spark, rows)
    clock = df.select("slot_id", "frame_id", "ts")
    batch = {(r.slot_id, r.track_id, r.event, r.frame_id, r.generation) for r in lc.lifecycle(df, clock, 6.0, 12.0).collect()}
    out = rn.run_available(st.stream_lifecycle(stream_of(spark, df, tmp_path, 4), 6.0, 12.0), "l").collect()
    assert {(r.slot_id, r.track_id, r.event, r.frame_id, r.generation) for r in out} == batch


def test_stream_lifecycle_sweeps_silent_slots(spark, tmp_path):
    # slot 0 falls silent after frame 10 (ts 1010), slot 1 goes on to frame 79
    df = log(spark, [(0, 5, f, 1000.0 + f) for f in range(11)] + [(1, 6, f, 1000.0 + f) for f in range(80)])
    life = st.stream_lifecycle(stream_of(spark, df, tmp_path, 4), 6.0, 12.0, sweep_delay="2 seconds")
    out = rn.run_available(life, "s").filter("event <> 'updated'").collect()
    got = sorted((r.slot_id, r.track_id, r.event, r.frame_id, r.us // 1_000_000) for r in out if r.slot_id == 0)
    assert got == [(0, 5, "created", 0, 1000), (0, 5, "lost", None, 1016), (0, 5, "removed", None, 1028)]
    assert [r.event for r in out if r.slot_id == 1] == ["created"]


def test_streams_give_late_rows_back(spark, tmp_path):
    df = log(spark, [(0, 1, f, float(f)) for f in range(60)])
    src = str(tmp_path / "late")
    for lo, hi in ((0, 20), (30, 60), (20, 30)):
        df.filter((F.col("frame_id") >= lo) & (F.col("frame_id") < hi)).coalesce(1).write.mode("append").parquet(src)

    def source():
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)

    life = rn.run_available(st.stream_lifecycle(source(), 5.0, 30.0), "l").collect()
    health = rn.run_available(st.stream_health(source().select("slot_id", "frame_id", F.lit(0.5).alias("mean_conf"))), "h").collect()
    for out in (life, health):
        assert sorted(r.frame_id for r in out if r.late) == list(range(20, 30))
        assert sorted(r.frame_id for r in out if not r.late) == [*range(20), *range(30, 60)]


def test_stream_lifecycle_forgets_generations(spark, tmp_path):
    df = log(spark, [(0, 1, 0, 0.0), (0, None, 10, 10.0), (0, None, 20, 20.0), (0, 1, 30, 30.0), (0, None, 40, 40.0),
                     (0, None, 50, 50.0), (0, 2, 60, 500.0), (0, 1, 70, 600.0)])
    out = rn.run_available(st.stream_lifecycle(stream_of(spark, df, tmp_path, 4), 5.0, 5.0, forget=100.0), "g").collect()
    assert sorted((r.frame_id, r.generation) for r in out if r.event == "created" and r.track_id == 1) == [(0, 0), (30, 1), (70, 0)]


def test_publish_keeps_old_events(spark, tmp_path):
    rows = [(i, 1_000_000 - 50_000 * i, i % 3 > 0) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, s long, success boolean")
    src = str(tmp_path / "events")
    for lo, hi in ((0, 6), (4, 12)):
        df.filter(F.col("event_id").between(lo, hi)).coalesce(1).write.mode("append").parquet(src)
    raw = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    events = raw.select("event_id", F.timestamp_seconds("s").alias("event_time"), "success")
    rn.use_rocksdb(spark)
    rn.publish_events(events, "parquet", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(12))


def test_stream_lifecycle_looks_at_due_targets_only(spark, monkeypatch):
    import pandas as pd
    asked = []
    p = st._LifecycleProcessor(3_000_000, 5_000_000, None, False)
    kept = {}
    p.load, p.save = lambda: kept.get("state"), lambda state: kept.update(state=state)
    limit = p._limit
    p._limit = lambda target: asked.append(1) or limit(target)
    n = 400
    rows = pd.DataFrame({"us": [i * 10_000 for i in range(n)], "frame_id": range(n), "ts": [i / 100 for i in range(n)], "track_id": range(n)})
    first = pd.concat(list(p.handleInputRows((0,), iter([rows]), None)))
    assert (first["event"] == "created").sum() == n and (first["event"] == "lost").sum() == n - 300
    assert len(asked) < 5 * n  # once a frame and open target would be 80,000
    late = rows[:1].assign(us=20_000_000, frame_id=n, ts=20.0, track_id=0)
    second = pd.concat(list(p.handleInputRows((0,), iter([late]), None)))
    assert sorted(second["event"].value_counts().to_dict().items()) == [("lost", 300), ("recovered", 1), ("removed", 99)]
