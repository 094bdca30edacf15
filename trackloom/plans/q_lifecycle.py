"""Target lifecycle, events and the target store."""

from pyspark.sql import functions as F

from ..operators import events as ev, joins as jn, lifecycle as lc
from . import fixtures as fx
from .catalog import query

STALE_US, REMOVAL_US = int(fx.STALE_S * 1e6), int(fx.REMOVAL_S * 1e6)

# Every loss and removal by look-up in the slot clock, written as correlated subqueries over sorted lists.
LIFE_SQL = f"""{fx.TRACK_LOG_CTE},
ob AS (SELECT *, lead(us) OVER w AS nus, lead(frame_id) OVER w AS nf FROM tl WINDOW w AS (PARTITION BY slot_id, track_id ORDER BY us, frame_id)),
ck AS (SELECT slot_id, us, min(frame_id) AS frame_id FROM tl GROUP BY slot_id, us),
l1 AS (SELECT o.*, c.us AS lus0, c.frame_id AS lf0 FROM (SELECT *, us + {STALE_US} AS at FROM ob) o ASOF LEFT JOIN ck c ON c.slot_id = o.slot_id AND c.us >= o.at),
l2 AS (SELECT *, CASE WHEN lus0 IS NOT NULL AND (nus IS NULL OR lus0 < nus OR (lus0 = nus AND lf0 < nf)) THEN lus0 END AS lus FROM l1),
l3 AS (SELECT *, CASE WHEN lus IS NOT NULL THEN lf0 END AS lf, coalesce(lus + {REMOVAL_US}, 9000000000000000000) AS rat FROM l2),
r1 AS (SELECT o.*, c.us AS rus0, c.frame_id AS rf0 FROM l3 o ASOF LEFT JOIN ck c ON c.slot_id = o.slot_id AND c.us >= o.rat),
r2 AS (SELECT *, CASE WHEN rus0 IS NOT NULL AND (nus IS NULL OR rus0 < nus OR (rus0 = nus AND rf0 < nf)) THEN rus0 END AS rus FROM r1),
r3 AS (SELECT *, lag(CASE WHEN lus IS NOT NULL THEN 1 ELSE 0 END) OVER w AS pl, lag(CASE WHEN rus IS NOT NULL THEN 1 ELSE 0 END) OVER w AS pr,
  coalesce(sum(CASE WHEN rus IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY slot_id, track_id ORDER BY us, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS generation
  FROM r2 WINDOW w AS (PARTITION BY slot_id, track_id ORDER BY us, frame_id)),
le AS (SELECT slot_id, track_id, generation, CASE WHEN pl IS NULL OR pr = 1 THEN 'created' WHEN pl = 1 THEN 'recovered' ELSE 'updated' END AS event, frame_id, us, us AS seen FROM r3
  UNION ALL SELECT slot_id, track_id, generation, 'lost', lf, lus, lus FROM r3 WHERE lus IS NOT NULL
  UNION ALL SELECT slot_id, track_id, generation, 'removed', rf0, rus, lus FROM r3 WHERE rus IS NOT NULL)"""

NUMBER_SQL = LIFE_SQL + """, nb AS (SELECT slot_id, track_id, generation, row_number() OVER (ORDER BY us, slot_id, frame_id, track_id) AS num FROM le WHERE event = 'created'),
ln AS (SELECT le.*, num, 'S' || le.slot_id || '-T' || CASE WHEN num < 10000 THEN lpad(CAST(num AS VARCHAR), 4, '0') ELSE CAST(num AS VARCHAR) END AS target_id
  FROM le JOIN nb ON nb.slot_id = le.slot_id AND nb.track_id = le.track_id AND nb.generation = le.generation)"""


def life(spark, sf):
    log = fx.track_log(spark, sf)
    return lc.lifecycle(log, log.select("slot_id", "frame_id", "ts"), fx.STALE_S, fx.REMOVAL_S, bucket_s=86400.0)


def numbered(spark, sf):
    return lc.number_targets(life(spark, sf))


@query("l01_lifecycle", f"WITH {LIFE_SQL} SELECT slot_id, track_id, CAST(generation AS BIGINT) AS generation, event, frame_id, us, seen AS last_seen_us FROM le")
def l01(spark, sf):
    return life(spark, sf).select("slot_id", "track_id", "generation", "event", "frame_id", "us",
                                  lc.micros(F.col("last_seen")).alias("last_seen_us"))


@query("l01_target_numbers", f"WITH {NUMBER_SQL} SELECT slot_id, track_id, CAST(generation AS BIGINT) AS generation, event, frame_id, target_id FROM ln")
def l01n(spark, sf):
    return numbered(spark, sf).select("slot_id", "track_id", "generation", "event", "frame_id", "target_id")


def _fsm(spark, sf, commands):
    log = fx.track_log(spark, sf)
    return lc.lifecycle_fsm(log, commands(log), log.select("slot_id", "frame_id", "ts"), fx.STALE_S, fx.REMOVAL_S, bucket_s=86400.0)


# One row of a track after the other; a last row sweeps what is still open. d: the frame of the loss, g: of the removal.
FSM_SQL = f"""{fx.TRACK_LOG_CTE},
ck AS (SELECT slot_id, us, min(frame_id) AS frame_id FROM tl GROUP BY slot_id, us),
r0 AS (SELECT slot_id, track_id, frame_id, us, 'seen' AS what, 0 AS aft, frame_id AS f, us + {STALE_US} AS at FROM tl
  UNION ALL SELECT slot_id, track_id, -1, us, CASE event_type WHEN 'purchase' THEN 'lock' ELSE 'unlock' END, 1, 9000000000000000000, us + 1 FROM tl WHERE event_type IN ('purchase', 'signup')
  UNION ALL SELECT DISTINCT slot_id, track_id, -1, 9000000000000000000, 'end', 2, 9000000000000000000, 9000000000000000000 FROM tl),
r1 AS (SELECT r.*, c.us AS dus, c.frame_id AS df, coalesce(c.us + {REMOVAL_US}, 9000000000000000000) AS rat FROM r0 r ASOF LEFT JOIN ck c ON c.slot_id = r.slot_id AND c.us >= r.at),
r2 AS MATERIALIZED (SELECT r.*, c.us AS gus, c.frame_id AS gf, row_number() OVER (PARTITION BY r.slot_id, r.track_id ORDER BY r.us, r.aft, r.frame_id, r.what) AS n
  FROM r1 r ASOF LEFT JOIN ck c ON c.slot_id = r.slot_id AND c.us >= r.rat),
w AS (SELECT slot_id, track_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS state, CAST(0 AS BIGINT) AS gen, [CAST(NULL AS BIGINT), NULL, NULL, NULL] AS d,
    CAST(NULL AS VARCHAR) AS ev, CAST(0 AS BIGINT) AS frame_id, CAST(0 AS BIGINT) AS us, false AS lost, false AS gone, [CAST(NULL AS BIGINT), NULL, NULL, NULL] AS od FROM r0 WHERE what = 'end'
  UNION ALL SELECT slot_id, track_id, n, CASE WHEN ev = 'locked' OR ev = 'kept' THEN 'LOCKED' WHEN ev IS NOT NULL THEN 'ACTIVE' ELSE st END, gen,
    CASE WHEN what = 'seen' THEN nd WHEN ev = 'unlocked' THEN CASE WHEN d[1] IS NULL OR nd[1] IS NULL THEN [CAST(NULL AS BIGINT), NULL, NULL, NULL] WHEN nd[1] > d[1] OR (nd[1] = d[1] AND nd[2] > d[2]) THEN nd ELSE d END ELSE d END,
    ev, frame_id, us, lost, gone, d FROM (
    SELECT *, CASE WHEN what = 'seen' THEN CASE st WHEN 'ACTIVE' THEN 'updated' WHEN 'LOST' THEN 'recovered' WHEN 'LOCKED' THEN 'kept' ELSE 'created' END
        WHEN what = 'lock' AND st = 'ACTIVE' THEN 'locked' WHEN what = 'unlock' AND st = 'LOCKED' THEN 'unlocked' END AS ev FROM (
      SELECT *, CASE WHEN gone THEN NULL WHEN lost THEN 'LOST' ELSE state END AS st, g0 + CAST(gone AS BIGINT) AS gen FROM (
        SELECT *, (lost OR coalesce(state = 'LOST', false)) AND coalesce(d[3] < us OR (d[3] = us AND d[4] < f), false) AS gone FROM (
          SELECT r.slot_id, r.track_id, r.n, r.what, r.us, r.frame_id, r.f, w.state, w.gen AS g0, w.d, [r.dus, r.df, r.gus, r.gf] AS nd,
            coalesce(w.state = 'ACTIVE' AND (w.d[1] < r.us OR (w.d[1] = r.us AND w.d[2] < r.f)), false) AS lost
          FROM w JOIN r2 r ON r.slot_id = w.slot_id AND r.track_id = w.track_id AND r.n = w.n + 1))))),
fe AS (SELECT slot_id, track_id, gen AS generation, ev AS event, frame_id, us, state FROM w WHERE ev IS NOT NULL
  UNION ALL SELECT slot_id, track_id, gen - CAST(gone AS BIGINT), 'lost', od[2], od[1], 'LOST' FROM w WHERE lost
  UNION ALL SELECT slot_id, track_id, gen - 1, 'removed', od[4], od[3], 'REMOVED' FROM w WHERE gone)"""


@query("l02_lifecycle_commands", f"WITH RECURSIVE {FSM_SQL} SELECT slot_id, track_id, generation, event, frame_id, us, state FROM fe")
def l02(spark, sf):
    return _fsm(spark, sf, fx.lock_commands).select("slot_id", "track_id", "generation", "event", "frame_id", "us", "state")


@query("l02_no_commands", f"WITH {LIFE_SQL} SELECT slot_id, track_id, CAST(generation AS BIGINT) AS generation, event, frame_id, us, seen AS last_seen_us FROM le")
def l02_plain(spark, sf):
    """Commands of an unknown kind do nothing: the fold has to agree with the relational form."""
    out = _fsm(spark, sf, lambda log: fx.lock_commands(log).withColumn("command", F.lit("none")))
    return out.select("slot_id", "track_id", "generation", "event", "frame_id", "us", lc.micros(F.col("last_seen")).alias("last_seen_us"))


@query("l03_validate_transitions", """WITH s AS (SELECT event_id, ['ACTIVE','LOST','LOCKED','RECOVERED','REMOVED'][CAST(user_id % 5 AS INT) + 1] AS from_state,
  ['ACTIVE','LOST','LOCKED','RECOVERED','REMOVED'][CAST(event_id % 5 AS INT) + 1] AS to_state FROM events),
a AS (SELECT *, CASE from_state WHEN 'ACTIVE' THEN ['LOCKED','LOST'] WHEN 'LOST' THEN ['RECOVERED','REMOVED'] WHEN 'RECOVERED' THEN ['ACTIVE'] WHEN 'LOCKED' THEN ['ACTIVE'] ELSE CAST([] AS VARCHAR[]) END AS nx FROM s)
SELECT event_id, from_state, to_state, list_contains(nx, to_state) AS legal, len(nx) = 0 AS terminal, array_to_string(nx, ',') AS allowed FROM a""")
def l03(spark, sf):
    names = F.array(*[F.lit(s) for s in lc.STATES])
    t = fx.table(spark, sf, "events").select(
        "event_id", F.element_at(names, (F.col("user_id") % 5 + 1).cast("int")).alias("from_state"),
        F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("to_state"))
    return lc.validate_transitions(t).withColumn("allowed", F.concat_ws(",", "allowed"))


@query("l04_lifecycle_counts", f"""WITH {LIFE_SQL} SELECT slot_id, frame_id, count(*) FILTER (event = 'created') AS created, count(*) FILTER (event = 'updated') AS updated,
  count(*) FILTER (event = 'recovered') AS recovered, count(*) FILTER (event = 'lost') AS lost, count(*) FILTER (event = 'removed') AS removed FROM le GROUP BY slot_id, frame_id""")
def l04(spark, sf):
    return lc.lifecycle_counts(life(spark, sf))


SOME_SQL = LIFE_SQL.replace("FROM tl WINDOW", "FROM tl WHERE event_type = 'purchase' WINDOW", 1)


@query("l04_quiet_frames", f"""WITH {SOME_SQL}, fr AS (SELECT DISTINCT slot_id, frame_id FROM tl)
SELECT fr.slot_id, fr.frame_id, count(*) FILTER (event = 'created') AS created, count(*) FILTER (event = 'updated') AS updated,
  count(*) FILTER (event = 'recovered') AS recovered, count(*) FILTER (event = 'lost') AS lost, count(*) FILTER (event = 'removed') AS removed
FROM fr LEFT JOIN le ON le.slot_id = fr.slot_id AND le.frame_id = fr.frame_id GROUP BY fr.slot_id, fr.frame_id""")
def l04_quiet(spark, sf):
    """Observations in some frames only, counted on every frame of the clock."""
    log = fx.track_log(spark, sf)
    clock = log.select("slot_id", "frame_id", "ts")
    events = lc.lifecycle(log.filter("event_type = 'purchase'"), clock, fx.STALE_S, fx.REMOVAL_S, bucket_s=86400.0)
    return lc.lifecycle_counts(events, clock)


EVENTS_SQL = NUMBER_SQL + """, ev AS (SELECT *, row_number() OVER (ORDER BY us, slot_id, frame_id, track_id, event) AS n FROM ln WHERE event <> 'updated'),
ty AS (SELECT 'evt-' || CASE WHEN n < 1000000 THEN lpad(CAST(n AS VARCHAR), 6, '0') ELSE CAST(n AS VARCHAR) END AS event_id, 'target.' || event AS event_type, us, target_id, slot_id,
  CASE event WHEN 'created' THEN CAST(track_id AS VARCHAR) WHEN 'recovered' THEN CAST(track_id AS VARCHAR) END AS payload_track,
  CASE event WHEN 'removed' THEN 'lifecycle' END AS reason, CASE event WHEN 'created' THEN 3 WHEN 'lost' THEN 1 ELSE 2 END AS n_payload FROM ev)"""


def typed_events(spark, sf):
    return lc.to_events(numbered(spark, sf))


@query("l05_typed_events", f"WITH {EVENTS_SQL} SELECT * FROM ty")
def l05(spark, sf):
    p = F.col("payload")
    return typed_events(spark, sf).select(
        "event_id", "event_type", lc.micros(F.col("timestamp")).alias("us"), "target_id", "slot_id",
        F.coalesce(p["track_id"], p["new_track_id"]).alias("payload_track"), p["reason"].alias("reason"), F.size(p).alias("n_payload"))


@query("l06_snapshot_events", f"""WITH {fx.DET_CTE} SELECT 'target.snapshot' AS event_type, ts AS "timestamp", slot_id, l_partkey AS target_id, round(confidence, 9) AS confidence FROM det""")
def l06(spark, sf):
    snaps = fx.detections(spark, sf).select(F.col("l_partkey").alias("target_id"), F.col("ts").alias("timestamp"), "slot_id", "confidence")
    e = lc.snapshot_events(snaps)
    return e.select("event_type", "timestamp", "snapshot.slot_id", "snapshot.target_id", F.round("snapshot.confidence", 9).alias("confidence"))


def raw_events(spark, sf):
    """Lifecycle rows and untyped rows of the event log that use the same type texts."""
    names = F.create_map(*[F.lit(x) for kv in RAW.items() for x in kv])
    return fx.table(spark, sf, "events").select("event_id", F.coalesce(names[F.col("event_type")], F.col("event_type")).alias("event_type"),
                                                (F.col("user_id") % 3 != 0).alias("typed"))


RAW = {"purchase": "target.locked", "signup": "target.created", "error": "target.lost"}
RAW_CTE = """rw AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'target.locked' WHEN 'signup' THEN 'target.created' WHEN 'error' THEN 'target.lost' ELSE event_type END AS event_type,
  user_id % 3 <> 0 AS typed FROM events)"""
KEYS = ["*", "target.lost", "TargetLostEvent", "TargetCreatedEvent", "click"]


@query("p07_subscribe", f"WITH {RAW_CTE} SELECT event_id, event_type FROM rw WHERE typed AND event_type = 'target.lost'")
def p07(spark, sf):
    return ev.subscribe(raw_events(spark, sf), "TargetLostEvent").select("event_id", "event_type")


@query("p07_subscribe_type", f"WITH {RAW_CTE} SELECT event_id, event_type FROM rw WHERE event_type = 'target.lost'")
def p07t(spark, sf):
    return ev.subscribe(raw_events(spark, sf), "target.lost").select("event_id", "event_type")


@query("l07_delivered_counts", f"""WITH {RAW_CTE} SELECT event_id, 1 + CAST(event_type = 'target.lost' AS INT) + CAST(typed AND event_type = 'target.lost' AS INT)
  + CAST(typed AND event_type = 'target.created' AS INT) + CAST(event_type = 'click' AS INT) AS delivered FROM rw""")
def l07(spark, sf):
    return ev.delivered_counts(raw_events(spark, sf), KEYS).select("event_id", "delivered")


STATE_SQL = NUMBER_SQL + """, sx AS (SELECT slot_id, track_id, target_id, arg_max(event, us * 10 + CASE event WHEN 'removed' THEN 2 WHEN 'lost' THEN 1 ELSE 0 END) AS last_event, max(seen) AS seen FROM ln GROUP BY slot_id, track_id, target_id),
ss AS (SELECT slot_id, track_id, target_id, CASE last_event WHEN 'lost' THEN 'LOST' ELSE 'ACTIVE' END AS state, seen FROM sx WHERE last_event <> 'removed')"""


@query("l08_targets_by_state", f"WITH {STATE_SQL} SELECT target_id, slot_id, track_id, seen AS last_seen_us FROM ss WHERE state = 'LOST'")
def l08(spark, sf):
    t = lc.targets_by_state(lc.target_states(numbered(spark, sf)), "LOST")
    return t.select("target_id", "slot_id", "track_id", lc.micros(F.col("last_seen")).alias("last_seen_us"))


@query("l08_state_counts", f"WITH {STATE_SQL} SELECT slot_id, state, count(*) AS n FROM ss GROUP BY slot_id, state")
def l08c(spark, sf):
    return lc.target_states(numbered(spark, sf)).groupBy("slot_id", "state").agg(F.count("*").alias("n"))


RECON_SQL = f"""{fx.TRACK_LOG_CTE}, cut AS (SELECT slot_id, CAST(floor(max(frame_id) * 99 / 1e2) AS BIGINT) AS f FROM tl GROUP BY slot_id),
op AS (SELECT t.slot_id, t.track_id, max(t.us) / 1e6 AS last_seen, arg_max(t.event_type, t.frame_id) AS le FROM tl t JOIN cut ON cut.slot_id = t.slot_id AND t.frame_id <= cut.f GROUP BY t.slot_id, t.track_id),
og AS (SELECT *, CASE WHEN track_id % 3 = 0 THEN 'LOST' WHEN track_id % 7 = 0 THEN 'LOCKED' ELSE 'ACTIVE' END AS state FROM op WHERE le <> 'error'),
nx AS (SELECT t.slot_id, t.track_id, max(t.us) OVER (PARTITION BY t.slot_id) / 1e6 AS ts FROM tl t JOIN cut ON cut.slot_id = t.slot_id AND t.frame_id > cut.f),
nw AS (SELECT DISTINCT slot_id, track_id, ts FROM nx), nn AS (SELECT slot_id, max(ts) AS now FROM nw GROUP BY slot_id),
j AS (SELECT coalesce(n.slot_id, o.slot_id) AS slot_id, coalesce(n.track_id, o.track_id) AS track_id, n.ts, o.state, o.last_seen FROM nw n FULL OUTER JOIN og o ON o.slot_id = n.slot_id AND o.track_id = n.track_id)
SELECT j.slot_id, track_id, CASE WHEN ts IS NOT NULL AND state IS NULL THEN 'created' WHEN ts IS NOT NULL AND state = 'ACTIVE' THEN 'updated' WHEN ts IS NOT NULL AND state = 'LOST' THEN 'recovered'
  WHEN ts IS NOT NULL THEN 'kept' WHEN state = 'ACTIVE' AND now - last_seen >= 21600 THEN 'lost' WHEN state = 'LOST' AND now - last_seen >= 86400 THEN 'removed' ELSE 'none' END AS action FROM j LEFT JOIN nn USING (slot_id)"""


RECON_SQL = RECON_SQL.replace("SELECT j.slot_id, track_id, CASE", "SELECT j.slot_id, track_id, state AS was, now, last_seen, CASE")


@query("j06_reconcile", f"""SELECT slot_id, track_id, action,
  CASE WHEN action IN ('created', 'updated', 'recovered') THEN 'ACTIVE' WHEN action = 'lost' THEN 'LOST' WHEN action = 'removed' THEN 'REMOVED' ELSE was END AS state,
  CAST(round(1e6 * CASE WHEN was IS NULL OR action IN ('created', 'updated', 'recovered', 'kept', 'lost') THEN now ELSE last_seen END) AS BIGINT) AS last_seen_us
FROM (WITH {RECON_SQL})""")
def j06(spark, sf):
    log = fx.track_log(spark, sf)
    cut = log.groupBy("slot_id").agg(F.floor(F.max("frame_id") * 99 / 100.0).cast("long").alias("f"))
    j = log.join(cut, "slot_id")
    state = F.when(F.col("track_id") % 3 == 0, "LOST").when(F.col("track_id") % 7 == 0, "LOCKED").otherwise("ACTIVE")
    open_ = (j.filter("frame_id <= f").groupBy("slot_id", "track_id").agg(F.max("ts").alias("last_seen"), F.max_by("event_type", "frame_id").alias("last"))
             .filter("last <> 'error'").drop("last").withColumn("state", state))
    now = j.filter("frame_id > f")
    last = now.groupBy("slot_id").agg(F.max("ts").alias("ts"))
    frame = now.select("slot_id", "track_id").distinct().join(last, "slot_id")
    return jn.reconcile(frame, open_, fx.STALE_S, fx.REMOVAL_S).select("slot_id", "track_id", "action", "state", F.round(F.col("last_seen") * 1e6).cast("long").alias("last_seen_us"))


@query("j07_apply_changes", """WITH st AS (SELECT c_custkey, c_acctbal AS v FROM customer), ch AS (SELECT o_custkey AS c_custkey, o_totalprice AS v,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn, o_orderstatus = 'F' AS del FROM orders), la AS (SELECT * FROM ch WHERE rn = 1)
SELECT c_custkey, v FROM st WHERE c_custkey NOT IN (SELECT c_custkey FROM la) UNION ALL SELECT c_custkey, v FROM la WHERE NOT del""")
def j07(spark, sf):
    store = fx.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    changes = fx.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("version"),
        F.when(F.col("o_orderstatus") == "F", "delete").otherwise("put").alias("op"))
    return jn.apply_changes(store, changes, "c_custkey", "version")


@query("j08_asof_forward", f"""WITH {fx.TRACK_LOG_CTE}, ck AS (SELECT slot_id, us, min(frame_id) AS frame_id FROM tl GROUP BY slot_id, us), o AS (SELECT slot_id, frame_id, us + {STALE_US} AS at FROM tl)
SELECT o.slot_id, o.frame_id, c.frame_id AS hit_frame, c.us AS hit_us FROM o ASOF LEFT JOIN ck c ON c.slot_id = o.slot_id AND c.us >= o.at""")
def j08(spark, sf):
    from ..operators.timeline import asof_forward
    log = fx.track_log(spark, sf).withColumn("us", lc.micros(F.col("ts")))
    left = log.select("slot_id", "frame_id", (F.col("us") + STALE_US).alias("at"))
    out = asof_forward(left, log.select("slot_id", "us", "frame_id"), ["slot_id"], "at", "us", 86400e6)
    return out.select("slot_id", "frame_id", F.col("hit.frame_id").alias("hit_frame"), F.col("hit.us").alias("hit_us"))
