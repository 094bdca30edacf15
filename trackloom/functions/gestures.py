"""Body and hand gesture rules, hand regions and head sub-regions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .geometry import Box, box, clamp01, distance

# Index of each body point in the 17-point layout: fixed values.
NOSE, L_SHOULDER, R_SHOULDER, L_ELBOW, R_ELBOW = 0, 5, 6, 7, 8
L_WRIST, R_WRIST, L_HIP, R_HIP, L_KNEE, R_KNEE = 9, 10, 11, 12, 13, 14

# Hand landmark indexes: fixed values.
WRIST, THUMB_TIP = 0, 4
FINGERS = {"index": (5, 6, 8), "middle": (9, 10, 12), "ring": (13, 14, 16), "pinky": (17, 18, 20)}

# Gesture confidence and priority: fixed values.
BODY = {
    "hands_up": (0.86, 70), "left_hand_up": (0.78, 62), "right_hand_up": (0.78, 62),
    "fallen": (0.76, 100), "squat": (0.70, 92), "arms_spread": (0.74, 58),
    "arms_crossed": (0.68, 56), "hand_near_head": (0.66, 48), "sideways": (0.62, 36),
}
HAND = {"ok": 0.86, "thumbs_up": 0.84, "five": 0.82, "one": 0.80, "two": 0.80, "three": 0.78,
        "fist": 0.78, "open_palm": 0.76, "hand": 0.55}

GESTURE_DDL = "array<struct<code:string,side:string,confidence:double,priority:int>>"


class _Pose:
    """Coordinates and confidences of body points that were laid out as columns."""

    def __init__(self, kpts: Column):
        self.k = kpts

    def raw(self, i: int, field: str) -> Column:
        return F.get(self.k, F.lit(i))[field]

    def x(self, i: int) -> Column:
        return F.col(f"_x{i}")

    def y(self, i: int) -> Column:
        return F.col(f"_y{i}")

    def seen(self, limit: float, *points: int) -> Column:
        return F.least(*[F.col(f"_c{i}") for i in points]) >= limit

    def dist(self, i: int, j: int) -> Column:
        return distance(self.x(i), self.y(i), self.x(j), self.y(j))

    def mid(self, i: int, j: int) -> tuple[Column, Column]:
        return (self.x(i) + self.x(j)) * 0.5, (self.y(i) + self.y(j)) * 0.5


def with_body_gestures(df: DataFrame, hand_conf: float = 0.30, name: str = "gestures") -> DataFrame:
    """Add up to two gestures per person, by priority then confidence; empty for all other rows.

    The measures that the rules share are columns of their own, so each is worked out once a row.
    """
    p = _Pose(F.col("keypoints"))
    trunk = (L_SHOULDER, R_SHOULDER, L_HIP, R_HIP)
    used = [NOSE, L_SHOULDER, R_SHOULDER, L_WRIST, R_WRIST, L_HIP, R_HIP, L_KNEE, R_KNEE]
    flat = {f"_{a}{i}": p.raw(i, a) for i in used for a in ("x", "y")}
    flat |= {f"_c{i}": F.coalesce(p.raw(i, "conf"), F.lit(0.0)) for i in used}
    b = box()
    flat |= {"_bw": F.greatest(F.lit(0.0), b.x2 - b.x1), "_bh": F.greatest(F.lit(0.0), b.y2 - b.y1),
             "_use": F.coalesce((F.col("label") == "person") & (F.size("keypoints") == 17), F.lit(False))}
    (sx, sy), (hx, hy), (_, ky) = p.mid(L_SHOULDER, R_SHOULDER), p.mid(L_HIP, R_HIP), p.mid(L_KNEE, R_KNEE)
    mids = {"_sx": sx, "_sy": sy, "_hx": hx, "_hy": hy, "_ky": ky}
    sx, sy, hx, hy, ky = (F.col(c) for c in mids)
    torso = F.col("_torso")

    def hand_up(wrist: int, shoulder: int) -> Column:
        return p.seen(hand_conf, wrist, shoulder) & (p.y(wrist) < p.y(shoulder) - torso * 0.16)

    def near(wrist: int) -> Column:
        return p.seen(0.35, NOSE, wrist) & (p.dist(wrist, NOSE) < torso * 0.52)

    bw, bh = F.col("_bw"), F.col("_bh")
    angle = F.abs(F.degrees(F.atan2(hy - sy, hx - sx)))
    middle_x = (p.x(L_SHOULDER) + p.x(R_SHOULDER) + p.x(L_HIP) + p.x(R_HIP)) * 0.25
    top = F.least(p.y(L_SHOULDER), p.y(R_SHOULDER)) - torso * 0.10
    bottom = F.greatest(p.y(L_HIP), p.y(R_HIP)) + torso * 0.08
    height = F.abs(hy - sy)
    narrow = ((F.abs(p.x(L_SHOULDER) - p.x(R_SHOULDER)) < height * 0.36)
              & (F.abs(p.x(L_HIP) - p.x(R_HIP)) < height * 0.34))
    rules = {
        "_left": hand_up(L_WRIST, L_SHOULDER), "_right": hand_up(R_WRIST, R_SHOULDER),
        "_fallen": p.seen(0.32, *trunk) & (bh > 1e-6) & (bw / F.when(bh > 1e-6, bh) >= 1.15)
        & ((angle < 35.0) | (angle > 145.0)),
        "_squat": p.seen(0.32, *trunk, L_KNEE, R_KNEE) & (F.abs(ky - hy) < torso * 0.34)
        & (F.abs(hy - sy) < torso * 1.08),
        "_spread": p.seen(hand_conf, L_WRIST, R_WRIST, L_SHOULDER, R_SHOULDER)
        & (p.x(L_WRIST) < p.x(L_SHOULDER) - torso * 0.18) & (p.x(R_WRIST) > p.x(R_SHOULDER) + torso * 0.18)
        & (F.abs(p.y(L_WRIST) - sy) < torso * 0.32) & (F.abs(p.y(R_WRIST) - sy) < torso * 0.32),
        "_crossed": p.seen(0.35, L_WRIST, R_WRIST, *trunk)
        & (p.x(L_WRIST) > middle_x) & (p.x(R_WRIST) < middle_x)
        & (top < p.y(L_WRIST)) & (p.y(L_WRIST) < bottom) & (top < p.y(R_WRIST)) & (p.y(R_WRIST) < bottom)
        & (p.dist(L_WRIST, R_WRIST) < torso * 0.75),
        "_nl": near(L_WRIST), "_nr": near(R_WRIST),
        "_sideways": p.seen(0.25, *trunk) & (height > 1e-6)
        & (narrow | (F.abs(F.col(f"_c{L_SHOULDER}") - F.col(f"_c{R_SHOULDER}")) > 0.35)),
    }
    left, right, near_l, near_r = (F.col(c) for c in ("_left", "_right", "_nl", "_nr"))

    def g(code: str, side: str | Column) -> Column:
        conf, prio = BODY[code]
        s = F.lit(side) if isinstance(side, str) else side
        # negated sort fields first, so that a plain array sort gives priority then confidence
        return F.struct(F.lit(-prio).alias("np"), F.lit(-conf).alias("nc"), F.lit(code).alias("code"),
                        s.alias("side"), F.lit(conf).alias("confidence"), F.lit(prio).alias("priority"))

    near_side = F.when(near_l & near_r, "both").when(near_l, "left").otherwise("right")
    found = F.array_compact(F.array(
        F.when(left & right, g("hands_up", "both")).when(left, g("left_hand_up", "left"))
        .when(right, g("right_hand_up", "right")),
        F.when(F.col("_fallen"), g("fallen", "body")).when(F.col("_squat"), g("squat", "body")),
        F.when(F.col("_spread"), g("arms_spread", "both")).when(F.col("_crossed"), g("arms_crossed", "both")),
        F.when((near_l | near_r) & ~left & ~right, g("hand_near_head", near_side)),
        F.when(F.col("_sideways"), g("sideways", "body"))))
    best = F.transform(F.slice(F.array_sort(found), 1, 2), lambda t: F.struct(
        t["code"].alias("code"), t["side"].alias("side"),
        t["confidence"].alias("confidence"), t["priority"].alias("priority")))
    usable = F.col("_use") & p.seen(0.25, *trunk)
    measured = (df.withColumns(flat).withColumns(mids)
                .withColumn("_torso", F.greatest(distance(sx, sy, hx, hy), F.lit(1e-6))))
    # The measures pass through a generator of one row. It keeps later filters on the gestures above
    # this point: pushed below, they would repeat every measure wherever a rule names it.
    work = [*flat, *mids, "_torso"]
    firm = measured.select(*df.columns, F.inline(F.array(F.struct(*work))))
    return (firm.withColumns(rules)
            .withColumn(name, F.when(usable, best).otherwise(F.array().cast(GESTURE_DDL)))
            .drop(*work, *rules))


def hand_gesture(points: Column, hand: Column) -> Column:
    """``struct<code, confidence>`` of a 21-point hand; the first rule that holds wins."""

    def y(i: int) -> Column:
        return points[i]["y"]

    def x(i: int) -> Column:
        return points[i]["x"]

    index_mcp = FINGERS["index"][0]
    thumb = (F.when(hand == "left", x(THUMB_TIP) > x(index_mcp))
             .when(hand == "right", x(THUMB_TIP) < x(index_mcp))
             .otherwise(F.abs(x(THUMB_TIP) - x(WRIST)) > F.abs(x(index_mcp) - x(WRIST)) * 0.55))
    up = {n: (y(tip) < y(pip)) & (y(pip) < y(mcp)) for n, (mcp, pip, tip) in FINGERS.items()}
    index, middle, ring, pinky = (up[n] for n in ("index", "middle", "ring", "pinky"))
    palm = F.greatest(distance(x(WRIST), y(WRIST), x(9), y(9)), F.lit(1e-6))
    pinch = distance(x(THUMB_TIP), y(THUMB_TIP), x(8), y(8)) < palm * 0.42
    count = sum((c.cast("int") for c in (thumb, index, middle, ring, pinky)), F.lit(0))
    thumb_high = (y(THUMB_TIP) < y(index_mcp)) & (y(THUMB_TIP) < y(WRIST))
    code = (F.when(pinch & middle & ring, "ok")
            .when(thumb & (count == 1) & thumb_high, "thumbs_up")
            .when(count >= 5, "five")
            .when(index & (count == 1), "one")
            .when(index & middle & (count == 2), "two")
            .when(index & middle & ring & (count == 3), "three")
            .when(count == 0, "fist")
            .when(count >= 4, "open_palm")
            .otherwise("hand"))
    conf = F.create_map(*[F.lit(v) for kv in HAND.items() for v in kv])[code]
    return F.when(F.size(points) == 21, F.struct(code.alias("code"), conf.alias("confidence")))


def hand_box(points: Column, pad: float = 0.035) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        clamp01(F.array_min(xs) - pad).alias("x1"), clamp01(F.array_min(ys) - pad).alias("y1"),
        clamp01(F.array_max(xs) + pad).alias("x2"), clamp01(F.array_max(ys) + pad).alias("y2"))


def hand_rois(label: Column, kpts: Column, b: Box, frame_w: Column, frame_h: Column) -> Column:
    """``array<struct<wrist,x1,y1,x2,y2>>``: square regions about the visible wrists of a person."""
    side = F.greatest(F.greatest(F.lit(0.0), b.x2 - b.x1), F.greatest(F.lit(0.0), b.y2 - b.y1)) * 0.32
    least = F.greatest(F.lit(64.0) / F.greatest(frame_w, F.lit(1)), F.lit(64.0) / F.greatest(frame_h, F.lit(1)))
    used = F.greatest(F.lit(0.12), F.least(side, F.lit(0.35)))

    def roi(wrist: int) -> Column:
        ok = ((F.coalesce(kpts[wrist]["conf"], F.lit(0.0)) >= 0.40)
              & (F.coalesce(kpts[wrist - 2]["conf"], F.lit(0.0)) >= 0.30))
        cx, cy = kpts[wrist]["x"], kpts[wrist]["y"]
        return F.when(ok, F.struct(
            F.lit(wrist).alias("wrist"),
            clamp01(cx - used * 0.5).alias("x1"), clamp01(cy - used * 0.5).alias("y1"),
            clamp01(cx + used * 0.5).alias("x2"), clamp01(cy + used * 0.5).alias("y2")))

    usable = (label == "person") & (F.size(kpts) == 17) & (side > 0.0) & (side >= least)
    none = F.array().cast("array<struct<wrist:int,x1:double,y1:double,x2:double,y2:double>>")
    return F.when(usable, F.array_compact(F.array(roi(L_WRIST), roi(R_WRIST)))).otherwise(none)


def head_regions(b: Box, frame_w: Column, frame_h: Column) -> Column:
    """Head, eye and mouth regions in whole pixels; null when the box is under 8 px."""

    def px(c: Column) -> Column:
        return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("int")

    x1, y1, x2, y2 = px(b.x1 * frame_w), px(b.y1 * frame_h), px(b.x2 * frame_w), px(b.y2 * frame_h)
    head = px((y2 - y1) * 0.45)
    w = x2 - x1

    def region(left, top, right, bottom) -> Column:
        return F.struct(left.alias("x1"), top.alias("y1"), right.alias("x2"), bottom.alias("y2"))

    return F.when((w >= 8) & (y2 - y1 >= 8), F.struct(
        region(x1, y1, x2, y1 + head).alias("head"),
        region(x1 + px(w * 0.15), y1 + px(head * 0.30), x1 + px(w * 0.85), y1 + px(head * 0.60)).alias("eyes"),
        region(x1 + px(w * 0.25), y1 + px(head * 0.60), x1 + px(w * 0.75), y1 + px(head * 0.95)).alias("mouth")))


def attribute_tags(attrs: Column) -> Column:
    """Tags of a head-attribute struct (hat, sunglass, masked, eye_open[2], mouth_open)."""

    def over(name: str) -> Column:
        return F.coalesce(attrs[name], F.lit(0.0)) > 0.5

    left, right = attrs["eye_open"][0], attrs["eye_open"][1]
    eyes = F.when((left > 0.5) & (right > 0.5), "eye_open").when((left <= 0.5) & (right <= 0.5), "eye_closed")
    return F.array_compact(F.array(
        F.when(over("hat"), "hat"), F.when(over("sunglass"), "sunglass"), F.when(over("masked"), "mask"),
        eyes, F.when(over("mouth_open"), "mouth_open")))


def attach_gestures(persons: DataFrame, hands: DataFrame, mode: str) -> DataFrame:
    """Persons with body gestures and hands with hand gestures, by mode off, body, hand or all."""
    if mode in ("body", "all"):
        out = with_body_gestures(persons)
    else:
        out = persons.withColumn("gestures", F.array().cast(GESTURE_DDL))
    if mode not in ("hand", "all"):
        return out
    g = hand_gesture(F.col("hand_landmarks"), F.col("hand"))
    named = (hands.withColumn("_g", g).withColumns({
        "gesture_code": F.col("_g.code"), "confidence": F.col("_g.confidence"), "label": F.lit("hand_gesture")}).drop("_g"))
    return out.unionByName(named, allowMissingColumns=True)
