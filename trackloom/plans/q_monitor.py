"""Filters, health, sampling, caches, counters and timing."""

from pyspark.sql import functions as F

from ..operators import monitor as mn
from ..sources.detections import frames_of
from . import fixtures as fx
from .catalog import query

KEY = ["slot_id", "frame_id", "det_idx"]
K = "slot_id, frame_id, det_idx"


@query("p01_filter_detections", f"""WITH {fx.KPT_CTE} SELECT {K}, label, CASE WHEN label = 'person' THEN 0 END AS n_points FROM kd WHERE confidence >= 5e-1""")
def p01(spark, sf):
    df = mn.filter_detections(fx.keypoints(fx.detections(spark, sf)), 0.5)
    return df.select(*KEY, "label", F.when(F.col("label") == "person", F.size("keypoints")).alias("n_points"))


@query("p01_without_persons", f"WITH {fx.DET_CTE} SELECT {K}, label FROM det WHERE confidence >= 5e-1 AND label <> 'person'")
def p01b(spark, sf):
    return mn.filter_detections(fx.detections(spark, sf), 0.5, person=False).select(*KEY, "label")


@query("p02_filter_snapshots", f"WITH {fx.DET_CTE} SELECT slot_id, count(*) AS n FROM det WHERE NOT (confidence < 4e-1) GROUP BY slot_id")
def p02(spark, sf):
    kept, _ = mn.filter_snapshots(fx.detections(spark, sf), F.col("confidence") < 0.4, dry_run=False)
    return kept.groupBy("slot_id").agg(F.count("*").alias("n"))


@query("p02_would_drop", f"WITH {fx.DET_CTE} SELECT count(*) AS total, count(*) FILTER (confidence < 0) AS would_drop FROM det")
def p02b(spark, sf):
    return mn.filter_snapshots(fx.detections(spark, sf))[1]


@query("p06_fresh_only", f"""WITH {fx.DET_CTE}, s AS (SELECT *, ts + 1e0 - l_linenumber / 1e1 AS source_ts, ts + 1e0 - (l_partkey % 30) / 1e1 AS last_update FROM det)
SELECT {K} FROM s WHERE NOT ((source_ts > 0 AND ts + 1e0 - source_ts > 28e-2) OR ts + 1e0 - last_update > 2)""")
def p06(spark, sf):
    df = fx.detections(spark, sf).withColumn("source_ts", F.col("ts") + 1.0 - F.col("l_linenumber") / 10.0)
    return mn.fresh_only(df, F.col("ts") + 1.0, F.col("ts") + 1.0 - (F.col("l_partkey") % 30) / 10.0).select(*KEY)


HEALTH_SQL = f"""{fx.DET_CTE}, fr AS (SELECT DISTINCT slot_id, frame_id FROM det),
pm AS (SELECT slot_id, frame_id, avg(confidence) AS m FROM det WHERE label = 'person' GROUP BY slot_id, frame_id),
fm AS (SELECT fr.slot_id, fr.frame_id, coalesce(m, 0e0) AS m FROM fr LEFT JOIN pm ON pm.slot_id = fr.slot_id AND pm.frame_id = fr.frame_id),
hl AS (SELECT slot_id, frame_id, m, avg(m) OVER w AS recent, row_number() OVER (PARTITION BY slot_id ORDER BY frame_id) AS n FROM fm
  WINDOW w AS (PARTITION BY slot_id ORDER BY frame_id ROWS BETWEEN 89 PRECEDING AND CURRENT ROW))"""


def monitored(spark, sf, threshold=0.35, block=8192):
    det = fx.detections(spark, sf)
    return mn.health(mn.frame_confidence(frames_of(det), det), threshold=threshold, block=block)


@query("a03_health", f"WITH {HEALTH_SQL} SELECT slot_id, frame_id, round(m + 1e-11, 9) AS mean_conf, round(recent + 1e-11, 9) AS recent_mean, n < 90 OR round(recent, 9) >= 35e-2 AS healthy FROM hl")
def a03(spark, sf):
    return monitored(spark, sf, block=1024).select(
        "slot_id", "frame_id", F.round(F.col("mean_conf") + 1e-11, 9).alias("mean_conf"),
        F.round(F.col("recent_mean") + 1e-11, 9).alias("recent_mean"), "healthy")


@query("a04_health_episodes", f"""WITH RECURSIVE {HEALTH_SQL},
ep AS (SELECT slot_id, frame_id, n, recent, round(recent, 9) AS r9, CASE WHEN n < 90 OR round(recent, 9) >= 41e-2 THEN true ELSE false END AS ok FROM hl),
w AS (SELECT slot_id, frame_id, n, recent, NOT ok AS active, 0 AS good, CASE WHEN NOT ok THEN 'fallback' END AS event FROM ep WHERE n = 1
  UNION ALL SELECT e.slot_id, e.frame_id, e.n, e.recent,
    CASE WHEN NOT e.ok THEN true WHEN w.active AND (CASE WHEN e.r9 >= 45e-2 THEN w.good + 1 ELSE 0 END) >= 60 THEN false ELSE w.active END,
    CASE WHEN NOT e.ok THEN CASE WHEN w.active THEN w.good ELSE 0 END WHEN w.active THEN CASE WHEN e.r9 >= 45e-2 THEN CASE WHEN w.good + 1 >= 60 THEN 0 ELSE w.good + 1 END ELSE 0 END ELSE w.good END,
    CASE WHEN NOT e.ok AND NOT w.active THEN 'fallback' WHEN e.ok AND w.active AND e.r9 >= 45e-2 AND w.good + 1 >= 60 THEN 'restore' END
  FROM w JOIN ep e ON e.slot_id = w.slot_id AND e.n = w.n + 1)
SELECT slot_id, frame_id, event, round(recent, 6) AS recent_mean FROM w WHERE event IS NOT NULL""")
def a04(spark, sf):
    out = mn.health_episodes(monitored(spark, sf, threshold=0.41), recovery=0.45)
    return out.select("slot_id", "frame_id", "event", F.round("recent_mean", 6).alias("recent_mean"))


THROTTLE_SQL = f"""{fx.TRACK_LOG_CTE}, o AS (SELECT slot_id, track_id, frame_id, us, row_number() OVER (PARTITION BY slot_id, track_id ORDER BY us, frame_id) AS k FROM tl),
w AS (SELECT slot_id, track_id, k, us AS last, frame_id, true AS keep FROM o WHERE k = 1
  UNION ALL SELECT o.slot_id, o.track_id, o.k, CASE WHEN o.us - w.last >= 28800000000 THEN o.us ELSE w.last END, o.frame_id, o.us - w.last >= 28800000000
  FROM w JOIN o ON o.slot_id = w.slot_id AND o.track_id = w.track_id AND o.k = w.k + 1)"""


@query("a05_throttle", f"WITH RECURSIVE {THROTTLE_SQL} SELECT slot_id, track_id, frame_id FROM w WHERE keep")
def a05(spark, sf):
    log = fx.track_log(spark, sf)
    return mn.throttle(log, 28800.0, ["slot_id", "track_id"], bucket_s=86400.0).select("slot_id", "track_id", "frame_id")


@query("a06_latest_per_slot", f"""WITH {fx.TRACK_LOG_CTE} SELECT slot_id, CAST(floor(us / 1e6 / 36e2) AS BIGINT) AS tick, max(frame_id) AS frame_id, count(*) - 1 AS dropped FROM tl GROUP BY 1, 2""")
def a06(spark, sf):
    return mn.latest_per_slot(fx.track_log(spark, sf), 3600.0).select("slot_id", "tick", "frame_id", "dropped")


@query("a07_slot_cache", f"""WITH {fx.DET_CTE}, m AS (SELECT slot_id, max(frame_id) AS frame_id FROM det GROUP BY slot_id)
SELECT det.slot_id, det.frame_id, any_value(ts) AS ts, count(*) AS n, string_agg(label, ',' ORDER BY det_idx) AS labels FROM det JOIN m ON m.slot_id = det.slot_id AND m.frame_id = det.frame_id GROUP BY det.slot_id, det.frame_id""")
def a07(spark, sf):
    c = mn.slot_cache(fx.detections(spark, sf), ["label"])
    return c.select("slot_id", "frame_id", "ts", F.size("detections").cast("long").alias("n"),
                    F.concat_ws(",", F.transform("detections", lambda d: d["label"])).alias("labels"))


@query("a07_quiet_newest_frame", f"""WITH {fx.DET_CTE}, fr AS (SELECT CAST(o_orderkey % 4 AS INT) AS slot_id, max(CAST(floor(o_orderkey / 4e0) AS BIGINT)) + 1 AS frame_id FROM orders GROUP BY 1)
SELECT fr.slot_id, fr.frame_id, fr.frame_id / 1e1 AS ts, count(det_idx) AS n, coalesce(string_agg(label, ',' ORDER BY det_idx), '') AS labels
FROM fr LEFT JOIN det ON det.slot_id = fr.slot_id AND det.frame_id = fr.frame_id GROUP BY fr.slot_id, fr.frame_id""")
def a07_quiet(spark, sf):
    """A clock that goes one frame beyond the last order: the newest frame is empty."""
    key = fx.table(spark, sf, "orders").select((F.col("o_orderkey") % 4).cast("int").alias("slot_id"), F.floor(F.col("o_orderkey") / 4).cast("long").alias("f"))
    clock = key.groupBy("slot_id").agg((F.max("f") + 1).alias("frame_id")).unionByName(key.select("slot_id", F.col("f").alias("frame_id")))
    c = mn.slot_cache(fx.detections(spark, sf), ["label"], clock.withColumn("ts", F.col("frame_id") / 10.0))
    return c.select("slot_id", "frame_id", "ts", F.size("detections").cast("long").alias("n"),
                    F.concat_ws(",", F.transform("detections", lambda d: d["label"])).alias("labels"))


SMALL_SQL = f"""{fx.DET_CTE}, s AS (SELECT {K}, label, confidence - 2e-1 AS confidence, (x2 - x1) * 2e-1 AS w, (y2 - y1) * 2e-1 AS h FROM det),
c AS (SELECT *, row_number() OVER (PARTITION BY slot_id, frame_id ORDER BY confidence DESC, w * h, det_idx) AS rank FROM s WHERE label = 'person' AND w < 35e-3 AND h < 35e-3 AND confidence >= 18e-2 AND confidence < 42e-2)"""


def small(spark, sf):
    det = fx.detections(spark, sf)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return det.select(*KEY, "label", (F.col("confidence") - 0.2).alias("confidence"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"),
                      (w * 0.2).alias("x2"), (h * 0.2).alias("y2"))


@query("a08_small_candidates", f"WITH {SMALL_SQL} SELECT {K}, CAST(rank AS INT) AS rank FROM c WHERE rank <= 1")
def a08(spark, sf):
    return mn.small_candidates(small(spark, sf), 1)[0].select(*KEY, "rank")


@query("a08_budget_counts", f"WITH {SMALL_SQL} SELECT slot_id, frame_id, count(*) AS candidates, least(count(*), 1) AS attempts, greatest(count(*) - 1, 0) AS skipped FROM c GROUP BY slot_id, frame_id")
def a08c(spark, sf):
    return mn.small_candidates(small(spark, sf), 1)[1]


@query("a09_refine_stats", f"""WITH {fx.DET_CTE}, l AS (SELECT l_linenumber <= 5 AS attempted, l_linenumber <= 5 AND l_partkey % 3 = 0 AS refined, l_partkey % 2 = 0 AS hit, confidence - 3e-1 AS gain FROM det)
SELECT count(*) AS candidates_total, count(*) FILTER (attempted) AS attempts_total, count(*) FILTER (refined) AS refined_total,
  round(sum(gain) FILTER (refined) / greatest(count(*) FILTER (refined), 1), 6) AS conf_gain_avg, round(CAST(count(*) FILTER (refined AND hit) AS DOUBLE) / greatest(count(*) FILTER (attempted), 1), 6) AS person_hit_rate,
  count(*) FILTER (attempted AND NOT refined) AS failed_count, count(*) FILTER (NOT attempted) AS skipped_total FROM l""")
def a09(spark, sf):
    det = fx.detections(spark, sf)
    tried = F.col("l_linenumber") <= 5
    log = det.select(tried.alias("attempted"), (tried & (F.col("l_partkey") % 3 == 0)).alias("refined"),
                     (F.col("l_partkey") % 2 == 0).alias("person_hit"), (F.col("confidence") - 0.3).alias("conf_gain"))
    out = mn.refine_stats(log)
    return out.withColumns({c: F.round(c, 6) for c in ("conf_gain_avg", "person_hit_rate")})


@query("a10_counters", """WITH n AS (SELECT unnest(['click','error','purchase','view','frames_skipped']) AS name)
SELECT n.name, coalesce(sum(CAST(floor(value) AS BIGINT)), 0) AS total FROM n LEFT JOIN events e ON e.event_type = n.name GROUP BY n.name""")
def a10(spark, sf):
    log = fx.table(spark, sf, "events").select(F.col("event_type").alias("name"), F.floor("value").cast("long").alias("amount"))
    return mn.counters(log, ["click", "error", "purchase", "view", "frames_skipped"])


STAGE_CTE = """sl AS (SELECT event_type AS stage, event_id AS frame_id, value / 1e3 AS seconds, CASE WHEN user_id % 17 = 0 THEN ['ValueError','TypeError','KeyError'][CAST(event_id % 3 AS INT) + 1] END AS error_type FROM events)"""


def stage_log(spark, sf):
    kinds = F.array(F.lit("ValueError"), F.lit("TypeError"), F.lit("KeyError"))
    return fx.table(spark, sf, "events").select(
        F.col("event_type").alias("stage"), F.col("event_id").alias("frame_id"), (F.col("value") / 1000.0).alias("seconds"),
        F.when(F.col("user_id") % 17 == 0, F.element_at(kinds, (F.col("event_id") % 3 + 1).cast("int"))).alias("error_type"))


@query("a11_stage_stats", f"""WITH {STAGE_CTE} SELECT stage, count(*) AS calls, round(sum(seconds), 6) AS total_time, round(min(seconds), 9) AS min_time, round(max(seconds), 9) AS max_time, round(avg(seconds), 6) AS avg_time,
  count(error_type) AS errors, round(count(error_type) / CAST(count(*) AS DOUBLE), 6) AS error_rate, arg_max(error_type, frame_id) FILTER (error_type IS NOT NULL) AS last_error FROM sl GROUP BY stage""")
def a11(spark, sf):
    out = mn.stage_stats(stage_log(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("total_time", "avg_time", "error_rate")}).withColumns(
        {c: F.round(c, 9) for c in ("min_time", "max_time")})


@query("a11_exceptions_by_type", f"WITH {STAGE_CTE} SELECT stage, error_type, count(*) AS n FROM sl WHERE error_type IS NOT NULL GROUP BY stage, error_type")
def a11e(spark, sf):
    return mn.exceptions_by_type(stage_log(spark, sf))


RUN_CTE = """rl AS (SELECT event_id AS frame_id, value / 1e3 AS seconds, event_type = 'click' AS skipped, event_type = 'error' AND user_id % 2 = 0 AS failed FROM events)"""
RUN_OUT = """SELECT count(*) FILTER (NOT skipped) AS frames, count(*) FILTER (skipped) AS skips, count(*) FILTER (failed AND NOT skipped) AS error_frames,
  round(sum(seconds) FILTER (NOT skipped), 6) AS total_time, round(count(*) FILTER (NOT skipped) / sum(seconds) FILTER (NOT skipped), 6) AS fps, round(sum(seconds) FILTER (NOT skipped) / count(*) FILTER (NOT skipped), 6) AS avg_frame_time,
  round(count(*) FILTER (failed AND NOT skipped) / CAST(count(*) FILTER (NOT skipped) AS DOUBLE), 6) AS error_rate FROM """


def run_log(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("frame_id"), (F.col("value") / 1000.0).alias("seconds"),
                    (F.col("event_type") == "click").alias("skipped"),
                    ((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0)).alias("failed"))


def _round6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("a12_run_stats", f"WITH {RUN_CTE} {RUN_OUT} rl")
def a12(spark, sf):
    return _round6(mn.run_stats(run_log(spark, sf)), "total_time", "fps", "avg_frame_time", "error_rate")


@query("a12_early_stop", f"""WITH {RUN_CTE}, c AS (SELECT *, sum(CASE WHEN NOT skipped THEN 1 ELSE 0 END) OVER w AS done, sum(CASE WHEN failed AND NOT skipped THEN 1 ELSE 0 END) OVER w AS bad FROM rl WINDOW w AS (ORDER BY frame_id)),
e AS (SELECT min(frame_id) AS f FROM c WHERE done >= 10 AND bad / CAST(done AS DOUBLE) > 14e-2), cut AS (SELECT rl.* FROM rl, e WHERE e.f IS NULL OR rl.frame_id <= e.f) {RUN_OUT} cut""")
def a12s(spark, sf):
    return _round6(mn.run_stats(run_log(spark, sf), stop_rate=0.14), "total_time", "fps", "avg_frame_time", "error_rate")


@query("a13_publish_metrics", """WITH p AS (SELECT event_id, epoch_us(ts) / 1e6 AS ts, value * 1e3 AS d, event_type <> 'error' AS ok, user_id % 23 = 0 AS cf FROM events)
SELECT count(*) AS total_events, count(*) FILTER (NOT cf) AS total_publishes, count(*) FILTER (NOT cf AND ok) AS successful, count(*) FILTER (NOT cf AND NOT ok) AS failed, count(*) FILTER (cf) AS conversion_failures,
  round(max(ts) - min(ts), 6) AS elapsed_seconds, round(count(*) FILTER (NOT cf) / (max(ts) - min(ts)), 2) AS states_per_second, round(count(*) FILTER (NOT cf AND ok) / CAST(count(*) FILTER (NOT cf) AS DOUBLE), 4) AS success_rate,
  round(sum(d) FILTER (NOT cf) / count(*) FILTER (NOT cf) / 1e3, 2) AS avg_latency_us FROM p""")
def a13(spark, sf):
    log = fx.track_log(spark, sf).select(
        F.col("frame_id").alias("event_id"), "ts", (F.col("value") * 1000.0).alias("duration_ns"),
        (F.col("event_type") != "error").alias("success"), (F.col("track_id") % 23 == 0).alias("conversion_failed"))
    return mn.publish_metrics(log)


@query("a14_failure_runs", """WITH f AS (SELECT CAST(user_id % 4 AS INT) AS slot_id, event_id AS frame_id, event_type <> 'click' AS failed FROM events),
g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY slot_id ORDER BY frame_id) AS grp FROM f),
r AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY slot_id, grp ORDER BY frame_id) AS run FROM g),
l AS (SELECT *, lag(failed) OVER (PARTITION BY slot_id ORDER BY frame_id) AS was, lag(run) OVER (PARTITION BY slot_id ORDER BY frame_id) AS prun FROM r)
SELECT slot_id, frame_id, 'failure' AS event, run AS run_length FROM l WHERE failed AND (run = 1 OR run % 5 = 0) UNION ALL SELECT slot_id, frame_id, 'recovered', prun FROM l WHERE NOT failed AND was""")
def a14(spark, sf):
    log = fx.track_log(spark, sf).select("slot_id", "frame_id", (F.col("event_type") != "click").alias("failed"))
    return mn.failure_runs(log, every=5, bucket=2048)


@query("a15_rect_output", f"""WITH {fx.HITS_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY slot_id, frame_id ORDER BY track_hits DESC, track_misses, confidence DESC, det_idx) AS rn FROM dh WHERE label = 'rectangle' AND confidence >= 55e-2)
SELECT {K} FROM r WHERE rn <= 2""")
def a15(spark, sf):
    return mn.rect_output(fx.hits(fx.detections(spark, sf)), "medium").select(*KEY)


@query("c22_frame_signature", f"""WITH {fx.DET_CTE}, s AS (SELECT slot_id, frame_id, count(*) AS n, string_agg(concat_ws('|', label, round(confidence, 3), round(x1, 3), round(y1, 3), round(x2, 3), round(y2, 3)), ';' ORDER BY det_idx) AS sig FROM det GROUP BY slot_id, frame_id)
SELECT slot_id, frame_id, n AS n_det, sig IS DISTINCT FROM lag(sig) OVER (PARTITION BY slot_id ORDER BY frame_id) AS changed FROM s""")
def c22(spark, sf):
    return mn.frame_signature(fx.detections(spark, sf), 512).select("slot_id", "frame_id", "n_det", "changed")
