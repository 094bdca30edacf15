"""Health, throttling, caches, counters and timing over frame and stage logs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.presets import RECTANGLE_PRESETS
from .fold import bucketed_fold
from .lifecycle import micros
from .materialize import cut_lineage
from .suppress import final_priority
from .timeline import Timeline, bucket_of, ordinal, running_totals

RECT_CONF = {k: p.least_confidence for k, p in RECTANGLE_PRESETS.items()}
RECT_MAX = {k: p.most_rectangles for k, p in RECTANGLE_PRESETS.items()}


# --- filters ---------------------------------------------------------------------------

def filter_detections(df: DataFrame, conf_floor: float = 0.0, person: bool = True,
                      skeleton: bool = False) -> DataFrame:
    """Confidence floor, person visibility, and no keypoints on persons unless ``skeleton``."""
    out = df.filter(F.col("confidence") >= conf_floor)
    if not person:
        out = out.filter(~F.col("label").eqNullSafe("person"))
    if not skeleton and "keypoints" in df.columns:
        none = F.array().cast(df.schema["keypoints"].dataType)
        out = out.withColumn("keypoints", F.when(F.col("label") == "person", none).otherwise(F.col("keypoints")))
    return out


def filter_snapshots(df: DataFrame, drop: Column | None = None, dry_run: bool = True):
    """Rows kept and a one-row report; the default predicate is ``confidence < 0``.

    A dry run only counts what would be dropped.
    """
    hit = F.coalesce(F.col("confidence") < 0 if drop is None else drop, F.lit(False))
    report = df.agg(F.count("*").alias("total"), F.count_if(hit).alias("would_drop"))
    return (df if dry_run else df.filter(~hit)), report


def fresh_only(df: DataFrame, frame_ts: Column, last_update: Column | None = None, max_age: float = 0.28,
               ttl: float = 2.0) -> DataFrame:
    """Drop detections older than ``max_age`` against their frame, and frames without news for ``ttl``."""
    stale = (F.col("source_ts") > 0.0) & (frame_ts - F.col("source_ts") > max_age)
    if last_update is not None:
        stale = stale | (frame_ts - last_update > ttl)
    return df.filter(~stale)


def rect_output(df: DataFrame, preset: str = "low") -> DataFrame:
    """Rectangles above the preset's confidence, at most its number per frame, best first."""
    keep = df.filter((F.col("label") == "rectangle") & (F.col("confidence") >= RECT_CONF.get(preset, 0.55)))
    rank = F.row_number().over(W.partitionBy("slot_id", "frame_id").orderBy(*final_priority(df), "det_idx"))
    most = RECT_MAX.get(preset.lower(), RECT_MAX["low"])
    return keep.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def small_candidates(df: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Small uncertain persons worth a second look: the best ``k`` of a frame, and per-frame counts."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cand = df.filter((F.col("label") == "person") & (w < 0.035) & (h < 0.035)
                     & (F.col("confidence") >= 0.18) & (F.col("confidence") < 0.42)).withColumn("area", w * h)
    order = W.partitionBy("slot_id", "frame_id").orderBy(F.col("confidence").desc(), "area", "det_idx")
    top = cand.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    n = F.count("*")
    counts = cand.groupBy("slot_id", "frame_id").agg(
        n.alias("candidates"), F.least(n, F.lit(k)).alias("attempts"),
        F.greatest(n - k, F.lit(0)).alias("skipped"))
    return top, counts


# --- health ----------------------------------------------------------------------------

def frame_confidence(frames: DataFrame, det: DataFrame) -> DataFrame:
    """Mean person confidence of every frame, 0 for frames without a person."""
    mean = (det.filter("label = 'person'").groupBy("slot_id", "frame_id")
            .agg(F.avg("confidence").alias("mean_conf")))
    return (frames.join(mean, ["slot_id", "frame_id"], "left")
            .withColumn("mean_conf", F.coalesce("mean_conf", F.lit(0.0))))


def health(per_frame: DataFrame, keys: list[str] = ["slot_id"], history: int = 90, threshold: float = 0.35,
           order: str = "frame_id", block: int = 8192) -> DataFrame:
    """Rolling mean over the last ``history`` frames; unhealthy only once that many exist.

    A mean is compared with a limit in whole billionths, so that the order of a sum does not settle ties.

    Frames are numbered along each key and cut into blocks; the last ``history - 1`` frames of a
    block are copied into the next one, so that a camera's frames spread over many tasks while every
    rolling mean still sees its full window.
    """
    size = max(block, history)
    rows = ordinal(per_frame, keys, [order], bucket_of(order, size * 4), "n")
    own = F.floor((F.col("n") - 1) / size).cast("long")
    into_next = (F.pmod(F.col("n") - 1, F.lit(size)) >= size - (history - 1))
    rows = rows.withColumn("_own", own).withColumn(
        "_blk", F.explode(F.when(into_next, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    w = W.partitionBy(*keys, "_blk").orderBy("n").rowsBetween(-(history - 1), 0)
    rolled = rows.withColumn("recent_mean", F.avg("mean_conf").over(w)).filter("_blk = _own")
    return (rolled.withColumn("healthy", (F.col("n") < history) | (F.round("recent_mean", 9) >= threshold))
            .select(*per_frame.columns, "n", "recent_mean", "healthy"))


def _runs(part: dict, recovery: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of frames of one kind: kind (0 unhealthy, 1 healthy but weak, 2 good), first row, length."""
    ok, mean = part["healthy"].astype(bool), part["recent_mean"].astype(float)
    kind = np.where(~ok, 0, np.where(np.round(mean, 9) >= recovery, 2, 1))
    first = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    return kind[first], first, np.diff(np.r_[first, len(kind)])


def health_episodes(monitored: DataFrame, keys: list[str] = ["slot_id"], recovery: float = 0.55,
                    required: int = 60, order: str = "frame_id", block: int = 65536) -> DataFrame:
    """Fallback and restore events over the output of :func:`health`.

    A fallback starts in an unhealthy frame; it is lifted after ``required`` good frames, healthy and with a
    rolling mean of ``recovery`` or more, without a weaker healthy frame among them.

    The state is -1 (no fallback) or the number of good frames since. A block of ``block`` order values turns each
    of these ``required + 1`` states into another one; the maps are carried along the blocks, then every block is
    walked by itself. A task holds the narrow rows of one block.
    """
    narrow = ["recent_mean", "healthy"]
    rows = cut_lineage(monitored.select(*keys, order, *narrow).withColumn("_b", bucket_of(order, block)))
    schema = ", ".join(f"`{k}` {monitored.schema[k].dataType.simpleString()}" for k in [*keys, order])
    schema += ", event string, recent_mean double"

    def after(states: np.ndarray, kind: int, n: int) -> np.ndarray:
        if kind == 0:
            return np.maximum(states, 0)
        if kind == 1:
            return np.minimum(states, 0)
        return np.where((states < 0) | (states + n >= required), -1, states + n)

    def describe(part: dict) -> list[int]:
        states = np.arange(-1, required)
        kinds, _, lengths = _runs(part, recovery)
        for kind, n in zip(kinds, lengths):
            states = after(states, kind, n)
        return states.tolist()

    def step(state: int, part: dict):
        at, events = [], []
        for kind, first, n in zip(*_runs(part, recovery)):
            if kind == 0 and state < 0:
                at.append(first)
                events.append("fallback")
            elif kind == 2 and 0 <= state and state + n >= required:
                at.append(first + max(required - state, 1) - 1)
                events.append("restore")
            state = int(after(np.int64(state), kind, n))
        return state, at, {"event": events, "recent_mean": part["recent_mean"][at].tolist()} if at else {}

    return bucketed_fold(rows, keys, "_b", [order], narrow, describe, lambda state, effect: int(effect[state + 1]),
                         step, schema, -1)


# --- sampling and caches ---------------------------------------------------------------

NEVER = -(2 ** 62)


def throttle(df: DataFrame, interval: float, keys: list[str] = ["slot_id"], time: str = "ts",
             tie: str = "frame_id", bucket_s: float = 3600.0) -> DataFrame:
    """Keep a row iff at least ``interval`` seconds passed since the last kept row of its key.

    Keys are cut into buckets of ``bucket_s`` seconds, at least four intervals. What a bucket does to the time of
    the last kept row is a step function of it with one step for each time in the bucket's first interval; the
    functions are applied along the buckets, then every bucket is walked by itself. A task holds the times of one
    bucket. Rows without a time are left out.
    """
    if interval <= 0:
        return df
    gap = int(round(interval * 1e6))
    width = max(int(round(bucket_s * 1e6)), 4 * gap)
    rows = df.withColumn("_us", micros(F.col(time))).filter(F.col("_us").isNotNull())
    rows = rows.withColumn("_b", bucket_of("_us", width))

    def describe(part: dict) -> list[int]:
        us = part["_us"]
        us = us[np.append(True, us[1:] != us[:-1])]
        follow = np.searchsorted(us, us + gap)
        last = np.where(follow < len(us), follow, np.arange(len(us)))
        while not np.array_equal(further := last[last], last):
            last = further
        # a row that the bucket before can make the next one lies less than an interval behind the bucket's begin
        entries = 1 + int(np.searchsorted(us, us[0] // width * width + gap))
        return [*us[:entries].tolist(), *us[last[:entries]].tolist()]

    def advance(state: int, effect: list[int]) -> int:
        half = len(effect) // 2
        at = int(np.searchsorted(effect[:half], state + gap))
        return int(effect[half + at]) if at < half else state

    def step(last: int, part: dict):
        us = part["_us"]
        keep, i = [], int(np.searchsorted(us, last + gap))
        while i < len(us):
            keep.append(i)
            last = int(us[i])
            i = int(np.searchsorted(us, last + gap))
        return last, keep, {}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return bucketed_fold(rows, keys, "_b", ["_us", tie], ["_us"], describe, advance, step, schema, NEVER)


def latest_per_slot(df: DataFrame, tick: float) -> DataFrame:
    """The newest frame of each slot in each tick, with the number of frames it replaced."""
    t = F.floor(F.col("ts") / tick).cast("long")
    return (df.withColumn("tick", t).groupBy("slot_id", "tick")
            .agg(F.max_by(F.struct("frame_id", "ts"), F.struct("ts", "frame_id")).alias("f"),
                 (F.count("*") - 1).alias("dropped"))
            .select("slot_id", "tick", "f.frame_id", "f.ts", "dropped"))


def slot_cache(det: DataFrame, cols: list[str], frames: DataFrame | None = None) -> DataFrame:
    """Detections of the newest frame of each slot, in order, and its time.

    ``frames`` is the frame clock: a newest frame without detections gives an empty list. Without it the newest frame
    with a detection counts.
    """
    last = (det if frames is None else frames).groupBy("slot_id").agg(F.max(F.struct("ts", "frame_id")).alias("m"))
    last = last.select("slot_id", F.col("m.ts").alias("ts"), F.col("m.frame_id").alias("frame_id"))
    item = F.struct("det_idx", *cols)
    rows = det.select("slot_id", "frame_id", item.alias("_item"))
    return (last.join(rows, ["slot_id", "frame_id"], "left").groupBy("slot_id", "ts", "frame_id")
            .agg(F.array_sort(F.collect_list("_item")).alias("detections")))


def frame_signature(det: DataFrame, bucket: int = 4096) -> DataFrame:
    """Hash of a frame's detections rounded to 3 places, and whether it differs from the frame before."""
    def r3(c: str) -> Column:
        return F.round(F.col(c), 3)

    have = set(det.columns)
    poly = (F.transform("polygon", lambda p: F.struct(F.round(p["x"], 3), F.round(p["y"], 3)))
            if "polygon" in have else F.lit(None))
    track = F.coalesce(F.col("track_id"), F.col("det_idx").cast("long")) if "track_id" in have else F.col("det_idx").cast("long")
    n_kpt = F.coalesce(F.size("keypoints"), F.lit(0)) if "keypoints" in have else F.lit(0)
    item = F.struct("det_idx", track.alias("t"), "label", r3("confidence").alias("c"), r3("x1").alias("x1"),
                    r3("y1").alias("y1"), r3("x2").alias("x2"), r3("y2").alias("y2"), n_kpt.alias("k"), poly.alias("p"))
    per = det.groupBy("slot_id", "frame_id").agg(
        F.xxhash64(F.array_sort(F.collect_list(item))).alias("signature"), F.count("*").alias("n_det"))
    per = cut_lineage(per)
    out = (Timeline(per, ["slot_id"], ["frame_id"], bucket_of("frame_id", bucket))
           .lag(_prev=F.col("signature")).apply())
    return out.withColumn("changed", ~F.col("signature").eqNullSafe(F.col("_prev"))).drop("_prev")


def attr_carry(df: DataFrame, stride: int, value: str, keys: list[str] = ["slot_id", "track_id"],
               order: str = "frame_id", bucket: int = 262144) -> DataFrame:
    """Reuse an attribute until ``stride`` frames have passed since it was computed.

    Adds ``refreshed`` and ``carried``; rows with a null value never refresh, and from ``stride`` frames on a value no
    longer counts, so such a row has none.
    """
    ready = df.filter(F.col(value).isNotNull())
    marks = (throttle(ready.withColumn("_t", F.col(order) / 1.0), float(stride), keys, "_t", order,
                      bucket_s=float(bucket))
             .select(*keys, order, F.lit(True).alias("refreshed")))
    rows = (df.join(marks, [*keys, order], "left")
            .withColumn("refreshed", F.coalesce("refreshed", F.lit(False))))
    return (Timeline(rows, keys, [order], bucket_of(order, bucket))
            .ffill(_value=F.when(F.col("refreshed"), F.col(value)), _at=F.when(F.col("refreshed"), F.col(order))).apply()
            .withColumn("carried", F.when(F.col(order) - F.col("_at") < stride, F.col("_value"))).drop("_value", "_at"))


# --- counters and timing ---------------------------------------------------------------

def counters(log: DataFrame, names: list[str]) -> DataFrame:
    """Sum per counter name; names without rows give 0."""
    wanted = log.sparkSession.createDataFrame([(n,) for n in names], "name string")
    total = log.groupBy("name").agg(F.sum("amount").alias("total"))
    return wanted.join(total, "name", "left").withColumn("total", F.coalesce("total", F.lit(0)))


def refine_stats(log: DataFrame) -> DataFrame:
    """Totals of second-look attempts (attempted, refined, person_hit, conf_gain, skipped)."""
    tried, done = F.count_if("attempted"), F.count_if("refined")
    one = F.lit(1)
    return log.agg(
        F.count("*").alias("candidates_total"), tried.alias("attempts_total"), done.alias("refined_total"),
        (F.coalesce(F.sum(F.when(F.col("refined"), F.col("conf_gain"))), F.lit(0.0)) / F.greatest(done, one)).alias("conf_gain_avg"),
        (F.count_if(F.col("refined") & F.col("person_hit")) / F.greatest(tried, one)).alias("person_hit_rate"),
        F.count_if(F.col("attempted") & ~F.col("refined")).alias("failed_count"),
        F.count_if(~F.col("attempted")).alias("skipped_total"))


def stage_stats(log: DataFrame) -> DataFrame:
    """Calls, times and errors per stage of a log (stage, frame_id, seconds, error_type)."""
    err = F.col("error_type").isNotNull()
    return log.groupBy("stage").agg(
        F.count("*").alias("calls"), F.sum("seconds").alias("total_time"), F.min("seconds").alias("min_time"),
        F.max("seconds").alias("max_time"), F.avg("seconds").alias("avg_time"),
        F.count_if(err).alias("errors"), (F.count_if(err) / F.count("*")).alias("error_rate"),
        F.max_by("error_type", F.when(err, F.col("frame_id"))).alias("last_error"))


def exceptions_by_type(log: DataFrame) -> DataFrame:
    return (log.filter(F.col("error_type").isNotNull()).groupBy("stage", "error_type")
            .agg(F.count("*").alias("n")))


def run_stats(log: DataFrame, stop_rate: float | None = None, min_frames: int = 10) -> DataFrame:
    """Totals of a run over rows (frame_id, seconds, skipped, failed), cut at the first early stop.

    A run stops after the first frame at which, with ``min_frames`` or more frames done, failures
    exceed ``stop_rate`` of them.
    """
    rows = log
    if stop_rate is not None:
        rows = running_totals(log, ["frame_id"], _done=(~F.col("skipped")).cast("int"),
                              _bad=(~F.col("skipped") & F.col("failed")).cast("int"))
        breach = (F.col("_done") >= min_frames) & (F.col("_bad") / F.col("_done") > stop_rate)
        end = rows.agg(F.min(F.when(breach, F.col("frame_id"))).alias("_end"))
        rows = rows.join(F.broadcast(end), F.col("_end").isNull() | (F.col("frame_id") <= F.col("_end")))
    run, bad = ~F.col("skipped"), F.col("failed") & ~F.col("skipped")
    n, t = F.count_if(run), F.coalesce(F.sum(F.when(run, F.col("seconds"))), F.lit(0.0))
    return rows.agg(
        n.alias("frames"), F.count_if(F.col("skipped")).alias("skips"), F.count_if(bad).alias("error_frames"),
        t.alias("total_time"),
        F.when(t > 0, n / t).otherwise(0.0).alias("fps"),
        F.when(n > 0, t / n).otherwise(0.0).alias("avg_frame_time"),
        F.when(n > 0, F.count_if(bad) / n).otherwise(0.0).alias("error_rate"))


def publish_metrics(log: DataFrame) -> DataFrame:
    """Summary of publishing (event_id, ts, duration_ns, success, conversion_failed)."""
    sent = ~F.col("conversion_failed")
    n, ok = F.count_if(sent), F.count_if(sent & F.col("success"))
    span = F.max("ts") - F.min("ts")
    return log.agg(
        F.count("*").alias("total_events"), n.alias("total_publishes"), ok.alias("successful"),
        (n - ok).alias("failed"), F.count_if(F.col("conversion_failed")).alias("conversion_failures"),
        F.round(span, 6).alias("elapsed_seconds"),
        F.round(F.when(span > 1e-6, n / span).otherwise(0.0), 2).alias("states_per_second"),
        F.round(F.when(n > 0, ok / n).otherwise(1.0), 4).alias("success_rate"),
        F.round(F.when(n > 0, F.sum(F.when(sent, F.col("duration_ns"))) / n / 1000.0).otherwise(0.0), 2).alias("avg_latency_us"))


def failure_runs(log: DataFrame, every: int = 30, keys: list[str] = ["slot_id"], order: str = "frame_id",
                 bucket: int = 65536) -> DataFrame:
    """Reports of consecutive failures: the 1st, each ``every``-th, and the recovery with the run length."""
    bucketed = bucket_of(order, bucket)
    good = (~F.col("failed")).cast("int")
    rows = (Timeline(log.select(*keys, order, "failed"), keys, [order], bucketed)
            .running_sum(_run_id=good).lead(_next=F.col(order), _next_failed=F.col("failed")).apply())
    # a run is what follows the same good row
    rows = (Timeline(rows, [*keys, "_run_id"], [order], bucketed)
            .running_sum(run_length=F.col("failed").cast("int")).apply().filter("failed"))
    n = F.col("run_length")
    report = F.when((n == 1) | (n % every == 0), F.struct(F.col(order).alias("at"), F.lit("failure").alias("event")))
    over = F.when(~F.col("_next_failed"), F.struct(F.col("_next").alias("at"), F.lit("recovered").alias("event")))
    return (rows.select(*keys, "run_length", F.inline(F.array_compact(F.array(report, over))))
            .select(*keys, F.col("at").alias(order), "event", "run_length"))
