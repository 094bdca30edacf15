"""Gesture, hand, head and attribute rules."""

from pyspark.sql import functions as F

from ..functions import gestures as gs
from ..functions.geometry import box
from ..operators.monitor import attr_carry
from . import fixtures as fx
from .catalog import query

KEY = ["slot_id", "frame_id", "det_idx"]
K = "slot_id, frame_id, det_idx"

# k(i) is the i-th body point; points count from 1 in the oracle.
_P = {n: f"keypoints[{i + 1}]" for n, i in dict(
    nose=0, ls=5, rs=6, le=7, re=8, lw=9, rw=10, lh=11, rh=12, lk=13, rk=14).items()}


def _seen(limit: str, *names: str) -> str:
    return "(" + " AND ".join(f"{n}.conf >= {limit}" for n in names) + ")"


def _dist(a: str, b: str) -> str:
    return f"sqrt(({a}.x - {b}.x) ** 2 + ({a}.y - {b}.y) ** 2)"


TRUNK = ("ls", "rs", "lh", "rh")
GESTURE_CTE = f"""{fx.KPT_CTE}, gp AS (SELECT {K}, x1, y1, x2, y2, {', '.join(f'{e} AS {n}' for n, e in _P.items())} FROM kd WHERE label = 'person'),
gt AS (SELECT *, (ls.x + rs.x) * 5e-1 AS sx, (ls.y + rs.y) * 5e-1 AS sy, (lh.x + rh.x) * 5e-1 AS hx, (lh.y + rh.y) * 5e-1 AS hy, (lk.y + rk.y) * 5e-1 AS ky FROM gp WHERE {_seen('25e-2', *TRUNK)}),
gu AS (SELECT *, greatest(sqrt((sx - hx) ** 2 + (sy - hy) ** 2), 1e-6) AS t FROM gt),
gv AS (SELECT *, {_seen('3e-1', 'lw', 'ls')} AND lw.y < ls.y - t * 16e-2 AS lup, {_seen('3e-1', 'rw', 'rs')} AND rw.y < rs.y - t * 16e-2 AS rup,
  {_seen('32e-2', *TRUNK)} AND y2 - y1 > 1e-6 AND greatest(0e0, x2 - x1) / greatest(0e0, y2 - y1) >= 115e-2
    AND (abs(degrees(atan2(hy - sy, hx - sx))) < 35 OR abs(degrees(atan2(hy - sy, hx - sx))) > 145) AS fallen,
  {_seen('32e-2', *TRUNK, 'lk', 'rk')} AND abs(ky - hy) < t * 34e-2 AND abs(hy - sy) < t * 108e-2 AS squat,
  {_seen('3e-1', 'lw', 'rw', 'ls', 'rs')} AND lw.x < ls.x - t * 18e-2 AND rw.x > rs.x + t * 18e-2 AND abs(lw.y - sy) < t * 32e-2 AND abs(rw.y - sy) < t * 32e-2 AS spread,
  {_seen('35e-2', 'lw', 'rw', *TRUNK)} AND lw.x > (ls.x + rs.x + lh.x + rh.x) * 25e-2 AND rw.x < (ls.x + rs.x + lh.x + rh.x) * 25e-2
    AND lw.y > least(ls.y, rs.y) - t * 1e-1 AND lw.y < greatest(lh.y, rh.y) + t * 8e-2 AND rw.y > least(ls.y, rs.y) - t * 1e-1 AND rw.y < greatest(lh.y, rh.y) + t * 8e-2
    AND {_dist('lw', 'rw')} < t * 75e-2 AS crossed,
  {_seen('35e-2', 'nose', 'lw')} AND {_dist('lw', 'nose')} < t * 52e-2 AS nl, {_seen('35e-2', 'nose', 'rw')} AND {_dist('rw', 'nose')} < t * 52e-2 AS nr,
  {_seen('25e-2', *TRUNK)} AND abs(hy - sy) > 1e-6 AND ((abs(ls.x - rs.x) < abs(hy - sy) * 36e-2 AND abs(lh.x - rh.x) < abs(hy - sy) * 34e-2) OR abs(ls.conf - rs.conf) > 35e-2) AS side FROM gu),
gw AS (SELECT {K}, list_filter([
  CASE WHEN lup AND rup THEN {{'p': 70, 'code': 'hands_up', 'side': 'both'}} WHEN lup THEN {{'p': 62, 'code': 'left_hand_up', 'side': 'left'}} WHEN rup THEN {{'p': 62, 'code': 'right_hand_up', 'side': 'right'}} END,
  CASE WHEN fallen THEN {{'p': 100, 'code': 'fallen', 'side': 'body'}} WHEN squat THEN {{'p': 92, 'code': 'squat', 'side': 'body'}} END,
  CASE WHEN spread THEN {{'p': 58, 'code': 'arms_spread', 'side': 'both'}} WHEN crossed THEN {{'p': 56, 'code': 'arms_crossed', 'side': 'both'}} END,
  CASE WHEN (nl OR nr) AND NOT lup AND NOT rup THEN {{'p': 48, 'code': 'hand_near_head', 'side': CASE WHEN nl AND nr THEN 'both' WHEN nl THEN 'left' ELSE 'right' END}} END,
  CASE WHEN side THEN {{'p': 36, 'code': 'sideways', 'side': 'body'}} END], lambda z: z IS NOT NULL) AS g FROM gv),
gx AS (SELECT {K}, list_reverse_sort(g)[1:2] AS g FROM gw)"""


def with_gestures(spark, sf):
    return gs.with_body_gestures(fx.keypoints(fx.detections(spark, sf)))


@query("g01_body_gestures", f"WITH {GESTURE_CTE} SELECT {K}, list_aggregate(list_transform(g, lambda z: z.code || ':' || z.side || ':' || z.p), 'string_agg', ',') AS gestures FROM gx WHERE len(g) > 0")
def g01(spark, sf):
    df = with_gestures(spark, sf).filter(F.size("gestures") > 0)
    text = F.transform("gestures", lambda z: F.concat_ws(":", z["code"], z["side"], z["priority"].cast("string")))
    return df.select(*KEY, F.concat_ws(",", text).alias("gestures"))


_H = {"w": 1, "tt": 5, "im": 6, "ip": 7, "it": 9, "mm": 10, "mp": 11, "mt": 13, "rm": 14, "rp": 15, "rt": 17, "pm": 18, "pp": 19, "pt": 21}
HAND_SQL = f"""{fx.HAND_CTE}, ha AS (SELECT {K}, hand, {', '.join(f'hand_landmarks[{i}] AS {n}' for n, i in _H.items())} FROM hd),
hb AS (SELECT *, CASE hand WHEN 'left' THEN tt.x > im.x WHEN 'right' THEN tt.x < im.x ELSE abs(tt.x - w.x) > abs(im.x - w.x) * 55e-2 END AS th,
  it.y < ip.y AND ip.y < im.y AS fi, mt.y < mp.y AND mp.y < mm.y AS fm, rt.y < rp.y AND rp.y < rm.y AS fr, pt.y < pp.y AND pp.y < pm.y AS fp,
  {_dist('tt', 'it')} < greatest({_dist('w', 'mm')}, 1e-6) * 42e-2 AS pinch FROM ha),
hc AS (SELECT *, CAST(th AS INT) + CAST(fi AS INT) + CAST(fm AS INT) + CAST(fr AS INT) + CAST(fp AS INT) AS n FROM hb),
hg AS (SELECT {K}, hand, CASE WHEN pinch AND fm AND fr THEN 'ok' WHEN th AND n = 1 AND tt.y < im.y AND tt.y < w.y THEN 'thumbs_up' WHEN n >= 5 THEN 'five'
  WHEN fi AND n = 1 THEN 'one' WHEN fi AND fm AND n = 2 THEN 'two' WHEN fi AND fm AND fr AND n = 3 THEN 'three' WHEN n = 0 THEN 'fist' WHEN n >= 4 THEN 'open_palm' ELSE 'hand' END AS code FROM hc)"""


@query("g02_hand_gestures", f"""WITH {HAND_SQL} SELECT {K}, hand, code, CASE code WHEN 'ok' THEN 86e-2 WHEN 'thumbs_up' THEN 84e-2 WHEN 'five' THEN 82e-2 WHEN 'one' THEN 8e-1
  WHEN 'two' THEN 8e-1 WHEN 'three' THEN 78e-2 WHEN 'fist' THEN 78e-2 WHEN 'open_palm' THEN 76e-2 ELSE 55e-2 END AS confidence FROM hg""")
def g02(spark, sf):
    df = fx.landmarks(fx.detections(spark, sf))
    return df.select(*KEY, "hand", gs.hand_gesture(F.col("hand_landmarks"), F.col("hand")).alias("g")).select(*KEY, "hand", "g.*")


@query("g03_hand_box", f"""WITH {fx.HAND_CTE}, m AS (SELECT {K}, list_transform(hand_landmarks, lambda p: p.x) AS xs, list_transform(hand_landmarks, lambda p: p.y) AS ys FROM hd)
SELECT {K}, round({fx.sql_clamp('list_min(xs) - 35e-3')}, 9) AS x1, round({fx.sql_clamp('list_min(ys) - 35e-3')}, 9) AS y1,
  round({fx.sql_clamp('list_max(xs) + 35e-3')}, 9) AS x2, round({fx.sql_clamp('list_max(ys) + 35e-3')}, 9) AS y2 FROM m""")
def g03(spark, sf):
    df = fx.landmarks(fx.detections(spark, sf)).withColumn("b", gs.hand_box(F.col("hand_landmarks")))
    return df.select(*KEY, *[F.round(F.col("b")[c], 9).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("g05_attach_gestures", f"""WITH {GESTURE_CTE}, {HAND_SQL[len(fx.DET_CTE) + 2:]},
ga AS (SELECT {K}, 'person' AS label, len(g) AS n_gestures, CAST(NULL AS VARCHAR) AS gesture_code FROM gx UNION ALL
  SELECT {K}, 'person', 0, NULL FROM kd WHERE label = 'person' AND ({K}) NOT IN (SELECT ({K}) FROM gx)),
gb AS (SELECT {K}, 'hand_gesture' AS label, CAST(NULL AS INT) AS n_gestures, code AS gesture_code FROM hg)
SELECT * FROM ga UNION ALL SELECT * FROM gb""")
def g05(spark, sf):
    det = fx.detections(spark, sf)
    out = gs.attach_gestures(fx.keypoints(det).filter("label = 'person'"), fx.landmarks(det), "all")
    return out.select(*KEY, "label", F.when(F.col("label") == "person", F.size("gestures")).alias("n_gestures"), "gesture_code")


@query("g06_head_regions", f"""WITH {fx.DET_CTE}, p AS (SELECT {K}, CAST(trunc(x1 * 1280) AS INT) AS x1, CAST(trunc(y1 * 720) AS INT) AS y1, CAST(trunc(x2 * 1280) AS INT) AS x2, CAST(trunc(y2 * 720) AS INT) AS y2 FROM det WHERE label = 'person'),
h AS (SELECT *, CAST(trunc((y2 - y1) * 45e-2) AS INT) AS hh, x2 - x1 AS w FROM p WHERE x2 - x1 >= 8 AND y2 - y1 >= 8)
SELECT {K}, y1 + hh AS head_bottom, x1 + CAST(trunc(w * 15e-2) AS INT) AS eye_left, y1 + CAST(trunc(hh * 30e-2) AS INT) AS eye_top, x1 + CAST(trunc(w * 85e-2) AS INT) AS eye_right,
  y1 + CAST(trunc(hh * 60e-2) AS INT) AS mouth_top, y1 + CAST(trunc(hh * 95e-2) AS INT) AS mouth_bottom FROM h""")
def g06(spark, sf):
    df = fx.detections(spark, sf).filter("label = 'person'")
    r = df.withColumn("r", gs.head_regions(box(), F.lit(1280), F.lit(720))).filter("r IS NOT NULL")
    return r.select(*KEY, F.col("r.head.y2").alias("head_bottom"), F.col("r.eyes.x1").alias("eye_left"),
                    F.col("r.eyes.y1").alias("eye_top"), F.col("r.eyes.x2").alias("eye_right"),
                    F.col("r.mouth.y1").alias("mouth_top"), F.col("r.mouth.y2").alias("mouth_bottom"))


@query("g07_attribute_carry", f"""WITH RECURSIVE {fx.TRACK_LOG_CTE}, v AS (SELECT slot_id, track_id, frame_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM tl),
o AS (SELECT *, row_number() OVER (PARTITION BY slot_id, track_id ORDER BY frame_id) AS k FROM v),
w AS (SELECT slot_id, track_id, k, frame_id, CASE WHEN value IS NOT NULL THEN frame_id END AS fa, value AS carried FROM o WHERE k = 1
  UNION ALL SELECT o.slot_id, o.track_id, o.k, o.frame_id, CASE WHEN o.value IS NOT NULL AND (w.fa IS NULL OR o.frame_id - w.fa >= 500) THEN o.frame_id ELSE w.fa END,
    CASE WHEN o.value IS NOT NULL AND (w.fa IS NULL OR o.frame_id - w.fa >= 500) THEN o.value ELSE w.carried END
  FROM w JOIN o ON o.slot_id = w.slot_id AND o.track_id = w.track_id AND o.k = w.k + 1)
SELECT slot_id, track_id, frame_id, coalesce(fa = frame_id, false) AS refreshed, CASE WHEN frame_id - fa < 500 THEN carried END AS carried FROM w""")
def g07(spark, sf):
    log = fx.track_log(spark, sf).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return attr_carry(log, 500, "value").select("slot_id", "track_id", "frame_id", "refreshed", "carried")


@query("g08_attribute_tags", f"""WITH {fx.DET_CTE}, a AS (SELECT {K}, (l_partkey % 10) / 9e0 AS hat, (l_partkey % 7) / 6e0 AS sun, (l_partkey % 5) / 4e0 AS mask,
  (l_partkey % 4) / 3e0 AS e1, (l_linenumber % 3) / 2e0 AS e2, (l_partkey % 3) / 2e0 AS mouth FROM det WHERE label = 'person')
SELECT {K}, array_to_string(list_filter([CASE WHEN hat > 5e-1 THEN 'hat' END, CASE WHEN sun > 5e-1 THEN 'sunglass' END, CASE WHEN mask > 5e-1 THEN 'mask' END,
  CASE WHEN e1 > 5e-1 AND e2 > 5e-1 THEN 'eye_open' WHEN e1 <= 5e-1 AND e2 <= 5e-1 THEN 'eye_closed' END, CASE WHEN mouth > 5e-1 THEN 'mouth_open' END], lambda z: z IS NOT NULL), ',') AS tags FROM a""")
def g08(spark, sf):
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    attrs = F.struct(((part % 10) / 9.0).alias("hat"), ((part % 7) / 6.0).alias("sunglass"), ((part % 5) / 4.0).alias("masked"),
                     F.array((part % 4) / 3.0, (line % 3) / 2.0).alias("eye_open"), ((part % 3) / 2.0).alias("mouth_open"))
    df = fx.detections(spark, sf).filter("label = 'person'").withColumn("a", attrs)
    return df.select(*KEY, F.concat_ws(",", gs.attribute_tags(F.col("a"))).alias("tags"))
