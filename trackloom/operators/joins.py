"""Joins between detections, poses, tracks and targets.

Every join has equality keys (slot, frame, label or id); geometry is a residual condition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geometry import (area, box, box_centre, box_iou, compute_roi, distance, quality_gate,
                                  roi_gate)
from ..functions.vectors import bhattacharyya, cosine, dot, norm
from .materialize import cut_lineage

FRAME = ["slot_id", "frame_id"]


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keep])


def merge_pose(base: DataFrame, pose: DataFrame) -> DataFrame:
    """Give each detection the keypoints of the best pose whose nose lies in its box.

    Best is the highest mean confidence, the first pose on ties. A frame without any pose row keeps
    its own keypoints if it has any; other frames get an empty list where no pose fits.
    """
    k = F.col("keypoints")
    score = F.aggregate(k, F.lit(0.0), lambda s, p: s + F.coalesce(p["conf"], F.lit(0.0))) / 17
    usable = F.size(k) == 17
    cand = pose.filter(usable).select(*[F.col(c).alias(f"_{c}") for c in FRAME], (-score).alias("_neg"), F.col("det_idx").alias("_i"),
                                      k.alias("_pose"), k[0]["x"].alias("_nx"), k[0]["y"].alias("_ny"))
    inside = F.col("_nx").between(F.col("x1"), F.col("x2")) & F.col("_ny").between(F.col("y1"), F.col("y2"))
    # one exchange by frame: rows meet the poses of their frame and each takes its first one there
    met = (base.withColumn("_row", F.monotonically_increasing_id())
           .join(cand, [*[F.col(c) == F.col(f"_{c}") for c in FRAME], inside], "left"))
    first = F.row_number().over(W.partitionBy(*FRAME, "_row").orderBy("_neg", "_i"))
    best = met.withColumn("_nth", first).filter("_nth = 1").drop("_nth", "_row", "_neg", "_i", "_nx", "_ny", *[f"_{c}" for c in FRAME])
    none = F.array().cast("array<struct<x:double,y:double,conf:double>>")
    if "keypoints" not in base.columns:
        return best.withColumn("keypoints", F.coalesce("_pose", none)).drop("_pose")
    posed = pose.select(*FRAME).distinct().withColumn("_any", F.lit(True))
    return (best.join(posed, FRAME, "left")
            .withColumn("keypoints", F.when(F.col("_any"), F.coalesce("_pose", none)).otherwise(F.col("keypoints")))
            .drop("_pose", "_any"))


def pair_geometry(t, d) -> tuple[Column, Column, Column]:
    """IoU, centre distance and mean side of two boxes."""
    (tx, ty), (dx, dy) = box_centre(t), box_centre(d)
    mean_side = ((t.x2 - t.x1) + (d.x2 - d.x1) + (t.y2 - t.y1) + (d.y2 - d.y1)) * 0.25
    return box_iou(t, d), distance(tx, ty, dx, dy), mean_side


def match_costs(tracks: DataFrame, dets: DataFrame, iou_gate: float = 0.25,
                appearance_weight: float = 0.05, reid: bool = False, looks: DataFrame | None = None) -> DataFrame:
    """Admissible (track, detection) pairs of the same frame and label with score and cost.

    A pair is admissible above the IoU gate, or with IoU over 0.05 and centres closer than half the
    mean side. Appearance counts 0.5 unless both sides carry ``color_hist``; ``reid`` scores pairs
    with embeddings by .4 IoU + .4 cosine + .2 centre. Instead of an embedding both sides may carry a ``vec_id`` of
    ``looks`` (vec_id, embedding): vectors then join the admissible pairs, and only ids travel with the rows.
    """
    key = [*FRAME, "label"]
    t, d = prefixed(tracks, "t_", key), prefixed(dets, "d_", key)
    j = t.join(d, key)
    iou, dist, side = pair_geometry(box("t_"), box("d_"))
    j = j.withColumns({"iou": iou, "dist": dist, "side": side}).filter(
        (F.col("iou") > iou_gate) | ((F.col("iou") > 0.05) & (F.col("side") > 1e-3)
                                     & (F.col("dist") < 0.5 * F.col("side"))))
    centre = 1.0 - F.least(F.lit(1.0), F.col("dist") / F.greatest(F.col("side"), F.lit(1e-3)))
    if "t_color_hist" in j.columns and "d_color_hist" in j.columns:
        look = bhattacharyya(F.col("t_color_hist"), F.col("d_color_hist"))
    else:
        look = F.lit(0.5)
    score = 0.85 * F.col("iou") + 0.10 * F.col("centre") + appearance_weight * look
    j = j.withColumn("centre", centre)
    if looks is not None:
        for side in ("t_", "d_"):
            j = j.join(looks.select(F.col("vec_id").alias(f"{side}vec_id"), F.col("embedding").alias(f"{side}embedding")), f"{side}vec_id", "left")
    if reid:
        sim = F.greatest(F.lit(0.0), cosine(F.col("t_embedding"), F.col("d_embedding")))
        both = F.col("t_embedding").isNotNull() & F.col("d_embedding").isNotNull()
        score = F.when(both, 0.4 * F.col("iou") + 0.4 * sim + 0.2 * F.col("centre")).otherwise(score)
    return j.withColumn("score", score).withColumn("cost", 1.0 - F.col("score"))


def rect_match(tracks: DataFrame, dets: DataFrame, iou_threshold: float) -> DataFrame:
    """Admissible rectangle pairs: score .62 IoU + .26 centre + .12 size."""
    t, d = prefixed(tracks, "t_", FRAME), prefixed(dets, "d_", FRAME)
    a, b = box("t_"), box("d_")
    iou, dist, side = pair_geometry(a, b)
    e = F.lit(1e-6)
    aw, ah, bw, bh = (F.greatest(e, v) for v in (a.x2 - a.x1, a.y2 - a.y1, b.x2 - b.x1, b.y2 - b.y1))
    size = (F.least(aw, bw) / F.greatest(aw, bw) + F.least(ah, bh) / F.greatest(ah, bh)) * 0.5
    centre = F.greatest(F.lit(0.0), 1.0 - dist / F.greatest(side * 1.8, F.lit(0.08)))
    j = t.join(d, FRAME).withColumns({"iou": iou, "centre": centre, "size": size})
    ok = ((F.col("iou") >= iou_threshold) | ((F.col("centre") >= 0.72) & (F.col("size") >= 0.58))
          | ((F.col("iou") >= 0.04) & (F.col("centre") >= 0.58) & (F.col("size") >= 0.45)))
    return j.filter(ok).withColumn(
        "score", F.col("iou") * 0.62 + F.col("centre") * 0.26 + F.col("size") * 0.12)


def redetect(tracks: DataFrame, candidates: DataFrame, frame_w: int, frame_h: int, pad: float = 0.15,
             conf_floor: float = 0.15, conf_ratio: float = 0.6, iou_accept: float = 0.20) -> DataFrame:
    """Refined boxes for unmatched person tracks.

    Per track the strongest person candidate of its frame with its centre in the padded region and
    a confidence of at least max(floor, ratio x track confidence); it then has to pass the region,
    quality and IoU gates. Tracks without a refined box come back with nulls.
    """
    key = [*FRAME, "track_id"]
    w, h = F.lit(frame_w), F.lit(frame_h)
    t = prefixed(tracks.select(*key, "confidence", "x1", "y1", "x2", "y2"), "t_", key)
    t = t.withColumn("roi", compute_roi(box("t_"), w, h, pad))
    c = prefixed(candidates.filter("label = 'person'").select(*FRAME, "det_idx", "confidence", "x1", "y1", "x2", "y2"),
                 "c_", FRAME)
    cx, cy = box_centre(box("c_"))
    floor = F.greatest(F.lit(conf_floor), F.col("t_confidence") * conf_ratio)
    inside = ((cx * w >= F.col("roi.x1")) & (cx * w <= F.col("roi.x2"))
              & (cy * h >= F.col("roi.y1")) & (cy * h <= F.col("roi.y2")))
    best = (t.filter(roi_gate(F.col("roi"), w, h)).join(c, FRAME)
            .filter(inside & (F.col("c_confidence") >= floor))
            .groupBy(*key).agg(F.min_by(F.struct("c_det_idx", "c_confidence", "c_x1", "c_y1", "c_x2", "c_y2"),
                                        F.struct(-F.col("c_confidence"), F.col("c_det_idx"))).alias("c")))
    r = box(of=None, prefix="c_")
    ok = (quality_gate(box("t_"), r, F.col("c_confidence"), F.col("t_confidence"), conf_floor, conf_ratio)
          & (box_iou(box("t_"), r) >= iou_accept))
    found = (t.join(best, key).select(*key, "t_confidence", "t_x1", "t_y1", "t_x2", "t_y2", "c.*")
             .filter(ok).select(*key, *[F.col("c_" + n).alias("r_" + n) for n in
                                        ("det_idx", "confidence", "x1", "y1", "x2", "y2")]))
    return tracks.join(found, key, "left")


def redetect_budget(tracks: DataFrame, budget: int, max_attempts: int) -> DataFrame:
    """Mark which unmatched person tracks may be re-detected: longest missing first, ``budget`` a frame."""
    open_ = (F.col("label") == "person") & (F.col("attempts") < max_attempts)
    w = W.partitionBy(*FRAME, open_).orderBy(F.col("misses").desc(), F.col("track_id"))
    return (tracks.withColumn("_rank", F.row_number().over(w))
            .withColumn("retry", open_ & (F.col("_rank") <= budget)).drop("_rank"))


PIVOTS = 64


def reid_topk(query: DataFrame, gallery: DataFrame, k: int, query_id: str = "query_id",
              gallery_id: str = "gallery_id", vector: str = "embedding", gallery_limit: int = 20000) -> DataFrame:
    """The ``k`` gallery vectors nearest to each query by cosine, the lower id first on ties.

    A gallery of live tracks is small: up to ``gallery_limit`` vectors (counted first) it is met whole by portions of
    ``PORTION`` queries. A larger one is searched cell by cell, see ``_pruned_topk``. Vectors that are missing or
    have no direction are similar to none (0). Both ways give the same rows.
    """
    length = F.coalesce(norm(F.col(vector)), F.lit(-1.0))
    g = gallery.select(F.col(gallery_id), F.col(vector).alias("_gv"), length.alias("_gn"))
    q = query.select(F.col(query_id), F.col(vector).alias("_qv"), length.alias("_qn"))
    q = cut_lineage(q.withColumn("_q", F.monotonically_increasing_id()))
    size = gallery.limit(gallery_limit + 1).count()
    if size <= gallery_limit:
        place = {"_cell": F.lit(0), "_block": F.lit(0).cast("long")}
        best = _merged(_best_of(q.withColumns(place), g.withColumns(place), k, query_id, gallery_id, _portions(q)), query_id, k)
    else:
        best = _pruned_topk(q, g, k, query_id, gallery_id, max(BLOCK, gallery_limit // 8))
    return (best.select(query_id, F.posexplode("_top").alias("p", "t"))
            .select(query_id, F.col("t.i").alias(gallery_id), (-F.col("t.n")).alias("similarity"),
                    (F.col("p") + 1).alias("rank")))


PORTION, BLOCK, CHUNK = 4096, 2048, 256  # queries and gallery vectors that meet in a task, and queries scored at once


def _portions(q: DataFrame) -> int:
    return max(1, -(-q.count() // PORTION))


def _matrix(vectors: pd.Series, lengths: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, their lengths, and which have a direction; the others are zero and of length 1."""
    n = lengths.to_numpy(dtype=float)
    aimed = np.isnan(n) | (n >= 1e-6)
    out = np.zeros((len(n), width))
    for i in np.flatnonzero(aimed):
        out[i, :len(vectors.iat[i])] = vectors.iat[i]
    return out, np.where(aimed, n, 1.0), aimed


def _best_of(visits: DataFrame, rows: DataFrame, k: int, query_id: str, gallery_id: str, portions: int) -> DataFrame:
    """The best ``k`` gallery rows of each visit of a query to a (_cell, _block), one row each.

    A portion of the queries meets a block in one task. A matrix product finds those that can be among the best; their
    similarity is then summed term by term in order, so that equal vectors are equally similar wherever they are met.
    """
    unit = ["_cell", "_block", "_part"]
    types = {**dict(visits.dtypes), **dict(rows.dtypes)}

    def meet(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(g):
            width = max(len(v) for c in (q["_qv"], g["_gv"]) for v in [*c, ()] if v is not None)
            gv, gn, g_aimed = _matrix(g["_gv"], g["_gn"], width)
            place = np.unique(g[gallery_id].to_numpy(), return_inverse=True)[1]
            most = min(k, len(g))
            for at in range(0, len(q), CHUNK):
                some = q.iloc[at:at + CHUNK]
                qv, qn, q_aimed = _matrix(some["_qv"], some["_qn"], width)
                near = qv @ gv.T / np.outer(qn, gn)
                near = np.where(np.isnan(near), -2.0, near)
                least = np.partition(near, len(g) - most, axis=1)[:, len(g) - most]
                i, j = np.nonzero(near >= least[:, None] - 1e-9)
                total = np.zeros(len(i))
                for c in range(width):
                    total += qv[i, c] * gv[j, c]
                n = -np.where(q_aimed[i] & g_aimed[j], total / (qn[i] * gn[j]), 0.0)
                order = np.lexsort((place[j], n, i))
                i, j, n = i[order], j[order], n[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < most
                i, j, n = i[keep], j[keep], n[keep]
                found.append(some[["_q", query_id]].iloc[i].reset_index(drop=True).assign(n=n, i=g[gallery_id].to_numpy()[j]))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in ("_q", query_id, "n", "i")})

    parted = visits.withColumn("_part", F.pmod(F.xxhash64("_q"), F.lit(portions)))
    copies = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(portions - 1).cast("long"))))
    return parted.groupBy(*unit).cogroup(copies.groupBy(*unit)).applyInPandas(
        meet, f"_q bigint, `{query_id}` {types[query_id]}, n double, i {types[gallery_id]}")


def _merged(found: DataFrame, query_id: str, k: int) -> DataFrame:
    top = F.slice(F.array_sort(F.collect_list(F.struct("n", "i"))), 1, k)
    return found.groupBy("_q").agg(F.first(query_id).alias(query_id), top.alias("_top"))


def _pruned_topk(q: DataFrame, g: DataFrame, k: int, query_id: str, gallery_id: str, per: int) -> DataFrame:
    """Exact nearest neighbours by pivots: angles obey the triangle inequality, so far cells cannot hold one of the best.

    Each gallery vector belongs to the nearest of up to ``PIVOTS`` gallery vectors; a cell knows its smallest and largest
    angle to its pivot and lies in blocks of about ``per`` vectors, so no task holds a whole cell. A query first meets its
    own cell; its k-th best angle there then rules out every cell whose bound is larger, and it meets the blocks of the
    others. Of vectors without a direction only the ``k`` lowest ids can be wanted: they are a cell that all queries meet.
    """
    spark = q.sparkSession
    portions = _portions(q)
    aimed = lambda n: F.coalesce(F.col(n) >= 1e-6, F.lit(False))
    unit = lambda v, n: F.transform(v, lambda x: x / F.col(n))
    angle = lambda u, p: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(u, p))))
    straight = g.filter(aimed("_gn")).withColumn("_u", unit("_gv", "_gn"))
    picked = straight.orderBy(F.xxhash64(gallery_id), gallery_id).select("_u").limit(PIVOTS).collect()

    def beside(df: DataFrame, cells: list[tuple]) -> DataFrame:
        """``df`` with one array of the cells, a table of one row and at most ``PIVOTS`` entries."""
        kind = "_one int, _cells array<struct<i:int,u:array<double>,lo:double,hi:double,blocks:int>>"
        return df.withColumn("_one", F.lit(0)).join(F.broadcast(spark.createDataFrame([(0, cells)], kind)), "_one").drop("_one")

    near = F.array_min(F.transform("_cells", lambda c: F.struct(angle(F.col("_u"), c["u"]).alias("d"), c["i"].alias("i"))))
    placed = beside(straight, [(i, r["_u"], 0.0, 0.0, 1) for i, r in enumerate(picked)]).withColumn("_near", near)
    placed = placed.select(gallery_id, "_gv", "_gn", F.col("_near.i").alias("_cell"), F.col("_near.d").alias("_d"))
    found = placed.groupBy("_cell").agg(F.min("_d").alias("lo"), F.max("_d").alias("hi"), F.count(F.lit(1)).alias("c")).collect()  # PIVOTS rows
    cells = [(r["_cell"], picked[r["_cell"]]["_u"], r.lo, r.hi, -(-r.c // per)) for r in found]
    blocks = F.broadcast(spark.createDataFrame([(c[0], c[4]) for c in cells], "_cell int, _blocks int"))
    lowest = lambda df, cell: df.orderBy(gallery_id).limit(k).select(gallery_id, "_gv", "_gn", F.lit(cell).alias("_cell"), F.lit(0).cast("long").alias("_block"))
    rows = placed.join(blocks, "_cell").select(gallery_id, "_gv", "_gn", "_cell", F.pmod(F.xxhash64(gallery_id), F.col("_blocks")).alias("_block"))
    rows = rows.union(lowest(g.filter(~aimed("_gn")), -1)).union(lowest(g, -2))
    rows = cut_lineage(rows)

    def meet(df: DataFrame, visits) -> DataFrame:
        """Best of the blocks of the cells ``visits``: array of struct(i, blocks)."""
        each = df.select("_q", query_id, "_qv", "_qn", F.explode(visits).alias("_v"))
        each = each.select("_q", query_id, "_qv", "_qn", F.col("_v.i").alias("_cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_v.blocks").cast("long") - 1)).alias("_block"))
        return _best_of(each, rows, k, query_id, gallery_id, portions)

    one = lambda i, n: F.struct(i.cast("int").alias("i"), n.cast("int").alias("blocks"))
    q = beside(q.withColumn("_u", F.when(aimed("_qn"), unit("_qv", "_qn"))), cells)
    q = q.withColumn("_cells", F.transform("_cells", lambda c: F.struct(
        angle(F.col("_u"), c["u"]).alias("d"), c["i"].alias("i"), c["lo"].alias("lo"), c["hi"].alias("hi"), c["blocks"].alias("blocks"))))
    home = F.array_min("_cells")
    q = q.withColumn("_home", home).select("_q", query_id, "_qv", "_qn", "_cells", "_home", (F.col("_u").isNotNull() & F.col("_home").isNotNull()).alias("_aimed"))
    first = F.when(F.col("_aimed"), F.array(one(F.col("_home.i"), F.col("_home.blocks")), one(F.lit(-1), F.lit(1)))).otherwise(F.array(one(F.lit(-2), F.lit(1))))
    tops = cut_lineage(_merged(meet(q, first), query_id, k))
    limit = tops.select("_q", F.when(F.size("_top") == k, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -F.element_at("_top", -1)["n"])))).alias("_limit"))
    could = F.transform(F.filter("_cells", lambda c: (c["i"] != F.col("_home.i")) & (F.col("_limit").isNull() | (
        F.greatest(c["d"] - c["hi"], c["lo"] - c["d"]) <= F.col("_limit") + 1e-6))), lambda c: one(c["i"], c["blocks"]))
    more = meet(q.filter("_aimed").join(limit, "_q"), could)
    return _merged(tops.select("_q", query_id, F.inline("_top")).union(more), query_id, k)


def reconcile(tracks: DataFrame, targets: DataFrame, stale: float, removal: float) -> DataFrame:
    """One reconciliation step of the frame tracks of each slot against its targets.

    ``tracks`` holds one frame per slot (slot_id, track_id, ts), ``targets`` the open targets
    (slot_id, track_id, state, last_seen). Targets of slots without a frame stay untouched.
    """
    now = tracks.groupBy("slot_id").agg(F.max("ts").alias("now"))
    seen = tracks.select("slot_id", "track_id", F.lit(True).alias("seen"))
    j = targets.join(seen, ["slot_id", "track_id"], "full_outer").join(now, "slot_id", "left")
    st, old = F.col("state"), F.when(F.col("now") > 0, F.col("now") - F.col("last_seen")).otherwise(0.0)
    action = (F.when(F.col("seen") & st.isNull(), "created")
              .when(F.col("seen") & (st == "ACTIVE"), "updated")
              .when(F.col("seen") & (st == "LOST"), "recovered")
              .when(F.col("seen"), "kept")
              .when((st == "ACTIVE") & (old >= stale), "lost")
              .when((st == "LOST") & (old >= removal), "removed").otherwise("none"))
    after = (F.when(F.col("action").isin("created", "updated", "recovered"), "ACTIVE")
             .when(F.col("action") == "lost", "LOST").when(F.col("action") == "removed", "REMOVED").otherwise(st))
    touched = F.col("action").isin("created", "updated", "recovered", "kept", "lost") & (F.col("now") > 0)
    return (j.withColumn("action", action)
            .select("slot_id", "track_id", "action", after.alias("state"),
                    F.when(touched | st.isNull(), F.col("now")).otherwise(F.col("last_seen")).alias("last_seen")))


def apply_changes(store: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Upserts and deletes by key: the latest change wins, ``op`` is 'put' or 'delete'."""
    cols = [c for c in changes.columns if c not in (key, "op", version)]
    last = (changes.groupBy(key)
            .agg(F.max_by(F.struct("op", version, *cols), version).alias("c")).select(key, "c.*"))
    kept = store.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter("op = 'put'").select(*store.columns))
