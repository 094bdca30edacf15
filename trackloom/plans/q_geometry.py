"""Geometry, identifiers and row conversions over the detection table."""

from pyspark.sql import functions as F

from ..functions import geometry as g, targets as tg, vectors as v
from . import fixtures as fx
from .catalog import query

KEY = ["slot_id", "frame_id", "det_idx"]
K = "slot_id, frame_id, det_idx"


def r9(**cols):
    return [F.round(c, 9).alias(n) for n, c in cols.items()]


@query("c01_to_centre", f"""WITH {fx.DET_CTE}
SELECT {K}, round((x1 + x2) * 5e-1, 9) AS cx, round((y1 + y2) * 5e-1, 9) AS cy, round(x2 - x1, 9) AS width,
  round(y2 - y1, 9) AS height FROM det""")
def c01(spark, sf):
    df = g.to_centre(fx.detections(spark, sf))
    return df.select(*KEY, *r9(cx=F.col("cx"), cy=F.col("cy"), width=F.col("width"), height=F.col("height")))


@query("c02_with_rect", f"""WITH {fx.DET_CTE}, c AS (SELECT {K}, (x1 + x2) * 5e-1 AS cx, (y1 + y2) * 5e-1 AS cy, x2 - x1 AS w, y2 - y1 AS h FROM det)
SELECT {K}, round(cx - w / 2e0, 9) AS x1, round(cy - h / 2e0, 9) AS y1, round(cx + w / 2e0, 9) AS x2, round(cy + h / 2e0, 9) AS y2 FROM c""")
def c02(spark, sf):
    df = g.with_rect(g.to_centre(fx.detections(spark, sf)))
    return df.select(*KEY, *[F.round(F.col("rect")[c], 9).alias(c) for c in ("x1", "y1", "x2", "y2")])


BOX = ["x1", "y1", "x2", "y2"]


@query("c03_box_iou", f"""WITH {fx.DET_CTE}{fx.pair_cte('det', BOX)}
SELECT {K}, round({fx.sql_iou('a_', 'b_')}, 9) AS iou_tracker, round({fx.sql_iou('a_', 'b_', 'clamped')}, 9) AS iou_clamped,
  round({fx.sql_iou('a_', 'b_', 'eval')}, 9) AS iou_eval FROM pr""")
def c03(spark, sf):
    p = fx.pairs(fx.detections(spark, sf), BOX)
    a, b = g.box("a_"), g.box("b_")
    return p.select(*KEY, *r9(iou_tracker=g.box_iou(a, b), iou_clamped=g.box_iou(a, b, "clamped"),
                              iou_eval=g.box_iou(a, b, "eval")))


@query("c04_polygon_measures", f"""WITH {fx.POLY_CTE}
SELECT {K}, round(abs((polygon[1].x * polygon[2].y - polygon[2].x * polygon[1].y) + (polygon[2].x * polygon[3].y - polygon[3].x * polygon[2].y)
  + (polygon[3].x * polygon[4].y - polygon[4].x * polygon[3].y) + (polygon[4].x * polygon[1].y - polygon[1].x * polygon[4].y)) * 5e-1, 9) AS area,
  round((polygon[1].x + polygon[2].x + polygon[3].x + polygon[4].x) / 4e0, 9) AS cx,
  round((polygon[1].y + polygon[2].y + polygon[3].y + polygon[4].y) / 4e0, 9) AS cy,
  round(list_min(list_transform(polygon, lambda p: p.x)), 9) AS x1, round(list_min(list_transform(polygon, lambda p: p.y)), 9) AS y1,
  round(list_max(list_transform(polygon, lambda p: p.x)), 9) AS x2, round(list_max(list_transform(polygon, lambda p: p.y)), 9) AS y2
FROM pd WHERE polygon IS NOT NULL""")
def c04(spark, sf):
    df = fx.polygons(fx.detections(spark, sf)).filter("polygon IS NOT NULL")
    p = F.col("polygon")
    c, b = g.poly_centre(p), g.poly_bbox(p)
    return df.select(*KEY, *r9(area=g.poly_area(p), cx=c["x"], cy=c["y"], x1=b["x1"], y1=b["y1"], x2=b["x2"], y2=b["y2"]))


def _poly_box(p: str) -> str:
    return (f"CASE WHEN len({p}polygon) = 4 THEN {{'x1': list_min(list_transform({p}polygon, lambda q: q.x)), 'y1': list_min(list_transform({p}polygon, lambda q: q.y)), "
            f"'x2': list_max(list_transform({p}polygon, lambda q: q.x)), 'y2': list_max(list_transform({p}polygon, lambda q: q.y))}} END")


@query("c05_shape_iou", f"""WITH {fx.POLY_CTE}{fx.pair_cte('pd', [*BOX, 'polygon'])},
s AS (SELECT *, {_poly_box('a_')} AS pa, {_poly_box('b_')} AS pb FROM pr)
SELECT {K}, round(CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN {fx.sql_iou('pa.', 'pb.')} ELSE {fx.sql_iou('a_', 'b_')} END, 9) AS iou FROM s""")
def c05(spark, sf):
    p = fx.pairs(fx.polygons(fx.detections(spark, sf)), [*BOX, "polygon"])
    return p.select(*KEY, *r9(iou=g.shape_iou(g.box("a_"), F.col("a_polygon"), g.box("b_"), F.col("b_polygon"))))


@query("c06_shape_centre", f"""WITH {fx.POLY_CTE}
SELECT {K}, round(CASE WHEN len(polygon) >= 3 THEN (polygon[1].x + polygon[2].x + polygon[3].x + polygon[4].x) / 4e0 ELSE (x1 + x2) * 5e-1 END, 9) AS cx,
  round(CASE WHEN len(polygon) >= 3 THEN (polygon[1].y + polygon[2].y + polygon[3].y + polygon[4].y) / 4e0 ELSE (y1 + y2) * 5e-1 END, 9) AS cy FROM pd""")
def c06(spark, sf):
    c = g.shape_centre(g.box(), F.col("polygon"))
    return fx.polygons(fx.detections(spark, sf)).select(*KEY, *r9(cx=c["x"], cy=c["y"]))


@query("c07_clamp01", f"""WITH {fx.DET_CTE}
SELECT {K}, round({fx.sql_clamp('x1 * 3e0 - 1e0')}, 9) AS x1, round({fx.sql_clamp('y2 * 3e0 - 1e0')}, 9) AS y2 FROM det""")
def c07(spark, sf):
    return fx.detections(spark, sf).select(*KEY, *r9(x1=g.clamp01(F.col("x1") * 3.0 - 1.0), y2=g.clamp01(F.col("y2") * 3.0 - 1.0)))


ROI_SQL = """roi AS (SELECT *, greatest(0, CAST(trunc((x1 + x2) * 5e-1 * 1280 - (x2 - x1) * 1280 * 5e-1 - (x2 - x1) * 1280 * 15e-2) AS INT)) AS rx1,
  greatest(0, CAST(trunc((y1 + y2) * 5e-1 * 720 - (y2 - y1) * 720 * 5e-1 - (y2 - y1) * 720 * 15e-2) AS INT)) AS ry1,
  least(1280, CAST(trunc((x1 + x2) * 5e-1 * 1280 + (x2 - x1) * 1280 * 5e-1 + (x2 - x1) * 1280 * 15e-2) AS INT)) AS rx2,
  least(720, CAST(trunc((y1 + y2) * 5e-1 * 720 + (y2 - y1) * 720 * 5e-1 + (y2 - y1) * 720 * 15e-2) AS INT)) AS ry2 FROM det)"""


def _roi(spark, sf):
    return fx.detections(spark, sf).withColumn("roi", g.compute_roi(g.box(), F.lit(1280), F.lit(720), 0.15))


@query("c08_compute_roi", f"WITH {fx.DET_CTE}, {ROI_SQL} SELECT {K}, rx1 AS x1, ry1 AS y1, rx2 AS x2, ry2 AS y2 FROM roi")
def c08(spark, sf):
    return _roi(spark, sf).select(*KEY, "roi.*")


def _back(e: str, start: str, size: str, frame: int) -> str:
    return "round(" + fx.sql_clamp(f"({start} + {e} * ({size})) / {frame}e0") + ", 9)"


@query("c09_map_roi", f"""WITH {fx.HAND_CTE}, {ROI_SQL.replace('FROM det', 'FROM hd')}
SELECT {K}, {_back('x1', 'rx1', 'rx2 - rx1', 1280)} AS x1, {_back('y1', 'ry1', 'ry2 - ry1', 720)} AS y1,
  {_back('x2', 'rx1', 'rx2 - rx1', 1280)} AS x2, {_back('y2', 'ry1', 'ry2 - ry1', 720)} AS y2,
  {_back('hand_landmarks[9].x', 'rx1', 'rx2 - rx1', 1280)} AS lx, {_back('hand_landmarks[9].y', 'ry1', 'ry2 - ry1', 720)} AS ly,
  len(hand_landmarks) AS n FROM roi""")
def c09(spark, sf):
    w, h = F.lit(1280), F.lit(720)
    df = fx.landmarks(fx.detections(spark, sf)).withColumn("roi", g.compute_roi(g.box(), w, h, 0.15))
    m = df.withColumns({"m": g.map_roi_box(g.box(), F.col("roi"), w, h),
                        "lm": g.map_roi_landmarks(F.col("hand_landmarks"), F.col("roi"), w, h)})
    return m.select(*KEY, *r9(**{c: F.col("m")[c] for c in BOX}, lx=F.col("lm")[8]["x"], ly=F.col("lm")[8]["y"]),
                    F.size("lm").alias("n"))


def _moved(e: str, ax: str, floored: bool) -> str:
    a1, a2 = (f"{ax}1", f"{ax}2")
    size = f"(b_{a2} - b_{a1})"
    size = f"greatest(1e-5, {size})" if floored else size
    scale = f"({size} / greatest(1e-5, a_{a2} - a_{a1}))"
    return fx.sql_clamp(f"(b_{a1} + b_{a2}) * 5e-1 + ({e} - (a_{a1} + a_{a2}) * 5e-1) * {scale}")


@query("c10_warp_keypoints", f"""WITH {fx.KPT_CTE}{fx.pair_cte('kd', [*BOX, 'keypoints'])}
SELECT {K}, round(list_sum(list_transform(a_keypoints, lambda p: {_moved('p.x', 'x', False)})), 6) AS sx,
  round(list_sum(list_transform(a_keypoints, lambda p: {_moved('p.y', 'y', False)})), 6) AS sy,
  round(list_sum(list_transform(a_keypoints, lambda p: p.conf)), 6) AS sc FROM pr WHERE label = 'person'""")
def c10(spark, sf):
    p = fx.pairs(fx.keypoints(fx.detections(spark, sf)), [*BOX, "keypoints"]).filter("label = 'person'")
    moved = g.warp_keypoints(F.col("a_keypoints"), g.box("a_"), g.box("b_"))

    def total(c):
        return F.round(F.aggregate(moved, F.lit(0.0), lambda s, k: s + k[c]), 6)

    return p.select(*KEY, total("x").alias("sx"), total("y").alias("sy"), total("conf").alias("sc"))


@query("c10_warp_polygon", f"""WITH {fx.POLY_CTE}{fx.pair_cte('pd', [*BOX, 'polygon'])}
SELECT {K}, round({_moved('a_polygon[1].x', 'x', True)}, 9) AS x1, round({_moved('a_polygon[3].y', 'y', True)}, 9) AS y3,
  round({fx.sql_clamp('b_x1 + (a_polygon[1].x - a_x1) / greatest(1e-6, a_x2 - a_x1) * greatest(1e-6, b_x2 - b_x1)')}, 9) AS cx1
FROM pr WHERE a_polygon IS NOT NULL""")
def c10p(spark, sf):
    p = fx.pairs(fx.polygons(fx.detections(spark, sf)), [*BOX, "polygon"]).filter("a_polygon IS NOT NULL")
    a, b, q = g.box("a_"), g.box("b_"), F.col("a_polygon")
    m, c = g.warp_polygon(q, a, b), g.warp_polygon_corner(q, a, b)
    return p.select(*KEY, *r9(x1=m[0]["x"], y3=m[2]["y"], cx1=c[0]["x"]))


@query("c11_order_quad", f"""WITH {fx.POLY_CTE}, q AS (SELECT {K}, list_concat(polygon[3:4], polygon[1:2]) AS p FROM pd WHERE polygon IS NOT NULL),
s AS (SELECT *, list_transform(p, lambda t: t.x + t.y) AS a, list_transform(p, lambda t: t.y - t.x) AS d FROM q),
o AS (SELECT {K}, p[list_position(a, list_min(a))] AS p1, p[list_position(d, list_min(d))] AS p2, p[list_position(a, list_max(a))] AS p3, p[list_position(d, list_max(d))] AS p4 FROM s)
SELECT {K}, round(p1.x, 9) AS x1, round(p2.x, 9) AS x2, round(p3.x, 9) AS x3, round(p4.x, 9) AS x4, round(p1.y, 9) AS y1, round(p3.y, 9) AS y3 FROM o""")
def c11(spark, sf):
    df = fx.polygons(fx.detections(spark, sf)).filter("polygon IS NOT NULL")
    df = df.withColumn("o", g.order_quad(F.concat(F.slice("polygon", 3, 2), F.slice("polygon", 1, 2))))
    o = F.col("o")
    return df.select(*KEY, *r9(x1=o[0]["x"], x2=o[1]["x"], x3=o[2]["x"], x4=o[3]["x"], y1=o[0]["y"], y3=o[2]["y"]))


EMB_CTE = """e AS (SELECT vec_id, list_transform(embedding, lambda v: round(CAST(v AS DOUBLE), 6)) AS v, label FROM embeddings),
ep AS (SELECT vec_id, v AS a, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM e)"""
NORM = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda t: t[1] * t[2]))"


def embeddings(spark, sf):
    return fx.table(spark, sf, "embeddings").withColumn(
        "v", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)))


def embedding_pairs(spark, sf):
    from pyspark.sql import Window as W
    e = embeddings(spark, sf)
    return e.select("vec_id", F.col("v").alias("a"),
                    F.lead("v").over(W.partitionBy("label").orderBy("vec_id")).alias("b")).filter("b IS NOT NULL")


@query("c12_cosine", f"""WITH {EMB_CTE} SELECT vec_id, round(CASE WHEN {NORM.format('a')} < 1e-6 OR {NORM.format('b')} < 1e-6 THEN 0e0
  ELSE {DOT.format('a', 'b')} / ({NORM.format('a')} * {NORM.format('b')}) END, 6) AS similarity FROM ep WHERE b IS NOT NULL""")
def c12(spark, sf):
    return embedding_pairs(spark, sf).select("vec_id", F.round(v.cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("c13_bhattacharyya", f"""WITH {EMB_CTE}, h AS (SELECT vec_id, list_transform(a, lambda x: x * x) AS a,
  CASE WHEN vec_id % 7 = 0 THEN NULL ELSE list_transform(b, lambda x: x * x) END AS b FROM ep WHERE b IS NOT NULL)
SELECT vec_id, round(CASE WHEN b IS NULL THEN 5e-1 ELSE greatest(0e0, least(1e0, 1e0 - sqrt(greatest(0e0,
  1e0 - list_sum(list_transform(list_zip(a, b), lambda t: sqrt(t[1] * t[2]))) / sqrt(list_sum(a) * list_sum(b)))))) END, 6) AS similarity FROM h""")
def c13(spark, sf):
    sq = lambda c: F.transform(c, lambda x: x * x)
    h = embedding_pairs(spark, sf).select("vec_id", sq("a").alias("a"), F.when(F.col("vec_id") % 7 != 0, sq("b")).alias("b"))
    return h.select("vec_id", F.round(v.bhattacharyya(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("c14_l2_normalize", f"""WITH {EMB_CTE} SELECT vec_id, array_to_string(list_transform(v, lambda z: CAST(round(z / {NORM.format('v')} * 1e6) AS BIGINT)), ',') AS millionths FROM e""")
def c14(spark, sf):
    n = embeddings(spark, sf).withColumn("n", v.l2_normalize(F.col("v")))
    return n.select("vec_id", F.concat_ws(",", F.transform("n", lambda x: F.round(x * 1e6).cast("long").cast("string"))).alias("millionths"))


@query("c15_target_ids", """WITH i AS (SELECT o_orderkey, CAST(o_custkey % 4 AS INT) AS slot, CASE WHEN o_orderkey % 11 = 0 THEN 'bad-' || o_orderkey
  ELSE 'S' || (o_custkey % 4) || '-T' || CASE WHEN o_orderkey < 10000 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE CAST(o_orderkey AS VARCHAR) END END AS id FROM orders)
SELECT o_orderkey, id AS target_id, CASE WHEN regexp_full_match(id, 'S(\\d+)-T(\\d+)') THEN slot END AS slot,
  CASE WHEN regexp_full_match(id, 'S(\\d+)-T(\\d+)') THEN o_orderkey END AS number FROM i""")
def c15(spark, sf):
    o = fx.table(spark, sf, "orders")
    slot = (F.col("o_custkey") % 4).cast("int")
    text = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("bad-"), F.col("o_orderkey").cast("string"))).otherwise(
        tg.format_target_id(slot, F.col("o_orderkey")))
    p = o.select("o_orderkey", text.alias("target_id")).withColumn("p", tg.parse_target_id(F.col("target_id")))
    return p.select("o_orderkey", "target_id", "p.slot", "p.number")


TRK = "l_partkey % 9 AS track_id0"


def tracked(spark, sf):
    """Detections with a track id on most rows."""
    return fx.detections(spark, sf).withColumns({
        "track_id": F.when(F.col("l_partkey") % 9 != 0, F.col("l_partkey")),
        "class_id": (F.col("l_linenumber") % 3).cast("int")})


TRACKED_CTE = fx.DET_CTE + """, tk AS (SELECT *, CASE WHEN l_partkey % 9 <> 0 THEN l_partkey END AS track_id, CAST(l_linenumber % 3 AS INT) AS class_id FROM det),
tr AS (SELECT slot_id, frame_id, ts, track_id, (x1 + x2) * 5e-1 AS cx, (y1 + y2) * 5e-1 AS cy, x2 - x1 AS width, y2 - y1 AS height,
  confidence AS score, class_id, label AS class_name, l_linenumber % 4 AS lost_frames, l_partkey % 50 AS age FROM tk WHERE track_id IS NOT NULL)"""


@query("c17_detections_to_tracks", f"""WITH {TRACKED_CTE} SELECT slot_id, frame_id, track_id, class_id, class_name,
  round(cx, 9) AS cx, round(cy, 9) AS cy, round(width, 9) AS width, round(height, 9) AS height, round(score, 9) AS score, 0 AS age, 0 AS lost_frames FROM tr""")
def c17(spark, sf):
    t = tg.detections_to_tracks(tracked(spark, sf))
    return t.select("slot_id", "frame_id", "track_id", "class_id", "class_name", "age", "lost_frames",
                    *r9(**{c: F.col(c) for c in ("cx", "cy", "width", "height", "score")}))


def target_rows(spark, sf):
    det = tracked(spark, sf)
    t = tg.detections_to_tracks(det.withColumn("label", F.concat_ws("|", "label", "l_linenumber")))
    line = F.element_at(F.split("class_name", r"\|"), 2).cast("int")
    return t.withColumns({"lost_frames": line % 4, "age": (F.col("track_id") % 50).cast("int"),
                          "class_name": F.element_at(F.split("class_name", r"\|"), 1)})


ID4 = "'S' || slot_id || '-T' || CASE WHEN track_id < 10000 THEN lpad(CAST(track_id AS VARCHAR), 4, '0') ELSE CAST(track_id AS VARCHAR) END"


@query("c16_tracks_to_targets", f"""WITH {TRACKED_CTE} SELECT {ID4} AS target_id, slot_id, track_id, 3 AS priority,
  CASE WHEN lost_frames = 0 THEN 'ACTIVE' ELSE 'LOST' END AS state, CAST(age AS VARCHAR) AS age, CAST(lost_frames AS VARCHAR) AS lost_frames, ts AS last_seen FROM tr""")
def c16(spark, sf):
    t = tg.tracks_to_targets(target_rows(spark, sf), priority=3)
    return t.select("target_id", "slot_id", "track_id", "priority", "state", F.col("attributes")["age"].alias("age"),
                    F.col("attributes")["lost_frames"].alias("lost_frames"), "last_seen")


@query("c19_project_snapshots", f"""WITH {TRACKED_CTE} SELECT track_id AS target_id, track_id AS local_id, class_name AS label, round(cx, 9) AS cx,
  round(cy, 9) AS cy, round(score, 9) AS confidence, ts AS "timestamp", slot_id AS camera_id FROM tr WHERE lost_frames = 0""")
def c19(spark, sf):
    rows = target_rows(spark, sf).withColumns({
        "target_id": tg.format_target_id(F.col("slot_id"), F.col("track_id")),
        "state": F.when(F.col("lost_frames") == 0, "ACTIVE").otherwise("LOST")})
    return tg.project_snapshots(rows).select("target_id", "local_id", "label", "timestamp", "camera_id",
                                             *r9(cx=F.col("cx"), cy=F.col("cy"), confidence=F.col("confidence")))


def event_rows(spark, sf):
    """Person detections as target events; some payloads lack the detection or the track id."""
    det = fx.detections(spark, sf)
    part = F.col("l_partkey")
    bbox = F.struct(((F.col("x1") + F.col("x2")) * 0.5).alias("x"), ((F.col("y1") + F.col("y2")) * 0.5).alias("y"),
                    (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    return det.select(
        "slot_id", F.col("ts").alias("timestamp"),
        F.concat_ws("-", F.lit("evt"), "slot_id", "frame_id", "det_idx").alias("event_id"),
        F.when(part % 2 == 0, "target.created").otherwise("target.lost").alias("event_type"),
        F.when(part % 13 != 0, tg.format_target_id(F.col("slot_id"), part)).otherwise("?").alias("target_id"),
        F.when(part % 3 != 0, F.create_map(F.lit("track_id"), (part * 2).cast("string"), F.lit("priority"), F.lit("0")))
        .otherwise(F.create_map(F.lit("priority"), F.lit("1"))).alias("payload"),
        F.when(part % 5 != 0, F.struct(F.col("label").alias("class_name"), F.col("confidence").alias("score"),
                                       bbox.alias("bbox"))).alias("detection"))


@query("c18_events_to_snapshots", f"""WITH {fx.DET_CTE}
SELECT 'evt-' || slot_id || '-' || frame_id || '-' || det_idx AS event_id, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey * 2 ELSE l_partkey END AS target_id,
  CASE WHEN l_partkey % 5 <> 0 THEN label ELSE 'unknown' END AS label, round(CASE WHEN l_partkey % 5 <> 0 THEN confidence ELSE 0e0 END, 9) AS confidence,
  round(CASE WHEN l_partkey % 5 <> 0 THEN (x1 + x2) * 5e-1 ELSE 0e0 END, 9) AS cx, round(CASE WHEN l_partkey % 5 <> 0 THEN y2 - y1 ELSE 0e0 END, 9) AS height,
  ts AS "timestamp", slot_id AS camera_id, CASE WHEN l_partkey % 3 <> 0 THEN '0' ELSE '1' END AS priority,
  CASE WHEN l_partkey % 2 = 0 THEN 'target.created' ELSE 'target.lost' END AS event_type FROM det WHERE l_partkey % 13 <> 0""")
def c18(spark, sf):
    ok, _ = tg.events_to_snapshots(event_rows(spark, sf))
    m = F.col("metadata")
    return ok.select(m["event_id"].alias("event_id"), "target_id", "label", "timestamp", "camera_id",
                     m["priority"].alias("priority"), m["event_type"].alias("event_type"),
                     *r9(confidence=F.col("confidence"), cx=F.col("cx"), height=F.col("height")))


@query("c18_unreadable_events", f"""WITH {fx.DET_CTE} SELECT slot_id, count(*) AS n FROM det WHERE l_partkey % 13 = 0 GROUP BY slot_id""")
def c18bad(spark, sf):
    _, bad = tg.events_to_snapshots(event_rows(spark, sf))
    return bad.groupBy("slot_id").agg(F.count("*").alias("n"))


@query("c20_enrich", f"""WITH {fx.DET_CTE} SELECT {K}, 0 AS n_attributes, CAST(NULL AS VARCHAR) AS gesture, round(1e0 - confidence, 9) AS health FROM det""")
def c20(spark, sf):
    df = tg.enrich(fx.detections(spark, sf), health=1.0 - F.col("confidence"))
    return df.select(*KEY, F.size("attributes").alias("n_attributes"), "gesture", *r9(health=F.col("health")))


@query("c21_stamp", f"""WITH {fx.DET_CTE} SELECT {K}, frame_id AS source_frame_id, ts AS source_ts, round((ts + l_linenumber / 1e2 - ts) * 1e3, 6) AS latency_ms FROM det""")
def c21(spark, sf):
    df = tg.stamp(fx.detections(spark, sf), F.col("ts") + F.col("l_linenumber") / 100.0)
    return df.select(*KEY, "source_frame_id", "source_ts", F.round("latency_ms", 6).alias("latency_ms"))
