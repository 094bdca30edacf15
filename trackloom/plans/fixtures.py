"""Detection, track and monitoring tables derived from the given test tables.

Each table exists twice: as DataFrame code for Spark and as SQL text for the oracle engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.geometry import box

STALE_S, REMOVAL_S = 21600.0, 86400.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as detections: one order is one frame."""
    line = table(spark, sf, "lineitem")
    rank = W.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_shipdate", "l_discount", "l_tax")
    base = line.withColumn("rn", F.row_number().over(rank) - 1).select(
        F.expr("CAST(l_orderkey % 4 AS INT)").alias("slot_id"),
        F.expr("CAST(floor(l_orderkey / 4e0) AS BIGINT)").alias("frame_id"),
        F.col("rn").cast("int").alias("det_idx"), "l_partkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "A", "person").when(F.col("l_returnflag") == "R", "rectangle")
        .otherwise("hand_gesture").alias("label"),
        F.expr("3e-1 + (CAST(floor(l_extendedprice * 1e2 + 5e-1) AS BIGINT) % 65) / 1e2").alias("confidence"),
        F.expr("15e-2 + 2e-1 * (l_suppkey % 4) + 1e-2 * (l_partkey % 8)").alias("cx"),
        F.expr("15e-2 + 2e-1 * (l_linenumber % 4) + 1e-2 * (l_partkey % 5)").alias("cy"),
        F.expr("1e-1 + 1e-2 * (CAST(floor(l_quantity) AS BIGINT) % 10)").alias("w"),
        F.expr("12e-2 + 1e-2 * (l_partkey % 12)").alias("h"))
    return base.select(
        "slot_id", "frame_id", F.expr("frame_id / 1e1").alias("ts"), "det_idx", "label", "confidence",
        F.expr("cx - w / 2e0").alias("x1"), F.expr("cy - h / 2e0").alias("y1"),
        F.expr("cx + w / 2e0").alias("x2"), F.expr("cy + h / 2e0").alias("y2"),
        "l_partkey", "l_linenumber")


DET_CTE = """
b0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
             l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) - 1 AS rn FROM lineitem),
c0 AS (SELECT CAST(l_orderkey % 4 AS INT) AS slot_id, CAST(floor(l_orderkey / 4e0) AS BIGINT) AS frame_id,
        CAST(rn AS INT) AS det_idx, l_partkey, l_linenumber,
        CASE l_returnflag WHEN 'A' THEN 'person' WHEN 'R' THEN 'rectangle' ELSE 'hand_gesture' END AS label,
        3e-1 + (CAST(floor(l_extendedprice * 1e2 + 5e-1) AS BIGINT) % 65) / 1e2 AS confidence,
        15e-2 + 2e-1 * (l_suppkey % 4) + 1e-2 * (l_partkey % 8) AS cx,
        15e-2 + 2e-1 * (l_linenumber % 4) + 1e-2 * (l_partkey % 5) AS cy,
        1e-1 + 1e-2 * (CAST(floor(l_quantity) AS BIGINT) % 10) AS w, 12e-2 + 1e-2 * (l_partkey % 12) AS h FROM b0),
det AS (SELECT slot_id, frame_id, frame_id / 1e1 AS ts, det_idx, label, confidence, cx - w / 2e0 AS x1,
        cy - h / 2e0 AS y1, cx + w / 2e0 AS x2, cy + h / 2e0 AS y2, l_partkey, l_linenumber FROM c0)"""


def hits(df: DataFrame) -> DataFrame:
    """Tracker counters on the detections, as a rectangle tracker would leave them."""
    return df.withColumns({"track_hits": F.expr("CAST(l_partkey % 7 AS INT)"),
                           "track_misses": F.expr("CAST(l_linenumber % 3 AS INT)")})


HITS_CTE = DET_CTE + """,
dh AS (SELECT *, CAST(l_partkey % 7 AS INT) AS track_hits, CAST(l_linenumber % 3 AS INT) AS track_misses FROM det)"""


def polygons(df: DataFrame) -> DataFrame:
    """A skewed quad inside each box; every fifth part has no polygon."""
    b = box()
    w, h = b.x2 - b.x1, b.y2 - b.y1

    def pt(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    quad = F.array(pt(b.x1 + w * 0.1, b.y1 + h * 0.2), pt(b.x2 - w * 0.2, b.y1 + h * 0.1),
                   pt(b.x2 - w * 0.1, b.y2 - h * 0.2), pt(b.x1 + w * 0.2, b.y2 - h * 0.1))
    return df.withColumn("polygon", F.when(F.col("l_partkey") % 5 != 0, quad))


POLY_CTE = DET_CTE + """,
pd AS (SELECT *, CASE WHEN l_partkey % 5 <> 0 THEN [
    {'x': x1 + (x2 - x1) * 1e-1, 'y': y1 + (y2 - y1) * 2e-1}, {'x': x2 - (x2 - x1) * 2e-1, 'y': y1 + (y2 - y1) * 1e-1},
    {'x': x2 - (x2 - x1) * 1e-1, 'y': y2 - (y2 - y1) * 2e-1}, {'x': x1 + (x2 - x1) * 2e-1, 'y': y2 - (y2 - y1) * 1e-1}
    ] END AS polygon FROM det)"""


def keypoints(df: DataFrame) -> DataFrame:
    """17 body points on the person rows."""
    cx, cy = F.expr("(x1 + x2) * 5e-1"), F.expr("(y1 + y2) * 5e-1")
    w, h = F.expr("x2 - x1"), F.expr("y2 - y1")
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    pts = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: F.struct(
        (cx + ((j * 7 + part) % 5 - 2) / 2.0 * w * 0.4).alias("x"),
        (cy + ((j * 11 + part + line) % 5 - 2) / 2.0 * h * 0.4).alias("y"),
        (F.lit(0.2) + ((j * 13 + part) % 8) / 10.0).alias("conf")))
    return df.withColumn("keypoints", F.when(F.col("label") == "person", pts))


KPT_CTE = DET_CTE + """,
kd AS (SELECT *, CASE WHEN label = 'person' THEN list_transform(range(17), lambda j: {
    'x': (x1 + x2) * 5e-1 + ((j * 7 + l_partkey) % 5 - 2) / 2e0 * (x2 - x1) * 4e-1,
    'y': (y1 + y2) * 5e-1 + ((j * 11 + l_partkey + l_linenumber) % 5 - 2) / 2e0 * (y2 - y1) * 4e-1,
    'conf': 2e-1 + ((j * 13 + l_partkey) % 8) / 1e1}) END AS keypoints FROM det)"""


def landmarks(df: DataFrame) -> DataFrame:
    """21 hand points on the hand rows, plus the side of the hand."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    w, h = F.expr("x2 - x1"), F.expr("y2 - y1")
    pts = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.struct(
        (F.col("x1") + ((j * 5 + part) % 11) / 10.0 * w).alias("x"),
        (F.col("y2") - ((j * 3 + part + line * 2) % 13) / 12.0 * h).alias("y"),
        F.lit(0.0).alias("z"), F.lit(1.0).alias("conf")))
    hand = F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("unknown")), (part % 3 + 1).cast("int"))
    return (df.filter("label = 'hand_gesture'")
            .withColumns({"hand_landmarks": pts, "hand": hand}))


HAND_CTE = DET_CTE + """,
hd AS (SELECT *, ['left', 'right', 'unknown'][CAST(l_partkey % 3 + 1 AS INT)] AS hand,
    list_transform(range(21), lambda j: {
    'x': x1 + ((j * 5 + l_partkey) % 11) / 1e1 * (x2 - x1),
    'y': y2 - ((j * 3 + l_partkey + l_linenumber * 2) % 13) / 12e0 * (y2 - y1),
    'z': 0e0, 'conf': 1e0}) AS hand_landmarks FROM det WHERE label = 'hand_gesture')"""


def track_log(spark: SparkSession, sf: str) -> DataFrame:
    """events as track observations: one event is one frame."""
    ev = table(spark, sf, "events")
    return ev.select(
        (F.col("user_id") % 4).cast("int").alias("slot_id"), F.col("user_id").alias("track_id"),
        F.col("event_id").alias("frame_id"),
        # the stored time has no zone: read it as UTC whatever the session zone is
        (F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp"))
         / 1e6).alias("ts"), "event_type", "value")


TRACK_LOG_CTE = """
tl AS (SELECT CAST(user_id % 4 AS INT) AS slot_id, user_id AS track_id, event_id AS frame_id,
    epoch_us(ts) / 1e6 AS ts, epoch_us(ts) AS us, event_type, value FROM events)"""


def lock_commands(log: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "lock").when(F.col("event_type") == "signup", "unlock")
    return (log.withColumn("command", kind).filter("command IS NOT NULL")
            .select("slot_id", "track_id", "ts", "command"))


def short_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Person rows as a table of short tracks whose ends meet."""
    det = detections(spark, sf).filter("label = 'person'")
    tid = F.expr("slot_id * 1000000 + CAST(floor(frame_id / 6e0) AS BIGINT) * 4 + l_linenumber % 4")
    rows = det.withColumn("track_id", tid)
    return (rows.groupBy("slot_id", "frame_id", "ts", "track_id")
            .agg(F.min_by(F.struct("x1", "y1", "x2", "y2", "confidence", "det_idx"), "det_idx").alias("d"))
            .select("slot_id", "frame_id", "ts", "track_id", "d.*"))


SHORT_CTE = DET_CTE + """,
st0 AS (SELECT *, slot_id * 1000000 + CAST(floor(frame_id / 6e0) AS BIGINT) * 4 + l_linenumber % 4 AS track_id
    FROM det WHERE label = 'person'),
st AS (SELECT slot_id, frame_id, ts, track_id, det_idx, confidence, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (
    PARTITION BY slot_id, frame_id, track_id ORDER BY det_idx) AS k FROM st0) WHERE k = 1)"""


def pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Consecutive rows of the same frame and label, as a_* and b_* columns."""
    w = W.partitionBy("slot_id", "frame_id", "label").orderBy("det_idx")
    nxt = F.lead(F.struct(*cols)).over(w)
    return (df.withColumn("b", nxt).filter("b IS NOT NULL")
            .select("slot_id", "frame_id", "label", "det_idx", *[F.col(c).alias("a_" + c) for c in cols],
                    *[F.col("b")[c].alias("b_" + c) for c in cols]))


def pair_cte(src: str, cols: list[str]) -> str:
    lead = ", ".join(f"lead({c}) OVER w AS b_{c}" for c in cols)
    own = ", ".join(f"{c} AS a_{c}" for c in cols)
    return f""",
pr AS (SELECT * FROM (SELECT slot_id, frame_id, label, det_idx, {own}, {lead}, lead(det_idx) OVER w AS nx FROM {src}
    WINDOW w AS (PARTITION BY slot_id, frame_id, label ORDER BY det_idx)) WHERE nx IS NOT NULL)"""


def sql_clamp(e: str) -> str:
    return f"greatest(0e0, least(1e0, {e}))"


def sql_iou(a: str, b: str, variant: str = "tracker") -> str:
    """IoU text; ``a`` and ``b`` are prefixes such as ``a_`` or ``p.``."""
    inter = (f"(greatest(0e0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * "
             f"greatest(0e0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))")
    if variant == "tracker":
        area = [f"(({p}x2 - {p}x1) * ({p}y2 - {p}y1))" for p in (a, b)]
    else:
        area = [f"(greatest(0e0, {p}x2 - {p}x1) * greatest(0e0, {p}y2 - {p}y1))" for p in (a, b)]
    union = f"({area[0]} + {area[1]} - {inter})"
    if variant == "eval":
        return (f"(CASE WHEN least({a}x2, {b}x2) <= greatest({a}x1, {b}x1) OR least({a}y2, {b}y2) <= greatest({a}y1, {b}y1) "
                f"THEN 0e0 ELSE {inter} / greatest({union}, 1e-10) END)")
    return f"(CASE WHEN {union} > 1e-8 THEN {inter} / {union} ELSE 0e0 END)"
