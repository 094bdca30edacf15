"""The tracker as a Spark job: sessions, the fold, and track numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ...sources.detections import frames_of
from ..fold import by_key
from ..materialize import cut_lineage, written
from ..timeline import Timeline, bucket_of
from .blocks import BlockRunner, blocks
from .packs import Packed, Records, records_of, unpacked
from .tracker import CANDIDATE, DET, LABELS, TICK, Tracker, TrackerConfig

SESSION = ["slot_id", "grp", "session"]
PART = 8192   # inferred frames of a session that one task walks
AHEAD = 256   # inferred frames before a part with which its walk begins, as its tracks are not known
BORN = ("birth_frame", "birth_det")
ROUNDED = ("confidence", "x1", "y1", "x2", "y2")
LISTS = ("polygon", "keypoints", "color_hist", "embedding")
BASE_DDL = ("slot_id int, frame_id bigint, birth_frame bigint, birth_det int, label string, confidence double, "
            "x1 double, y1 double, x2 double, y2 double, vx double, vy double, hits int, misses int, "
            "attempts int, predicted_only boolean, track_state string, filter string")
EXTRA_DDL = {"polygon": "polygon array<struct<x:double,y:double>>",
             "keypoints": "keypoints array<struct<x:double,y:double,conf:double>>"}


def number_frames(frames: DataFrame, stride: int, bucket: int) -> DataFrame:
    """Per slot ``seq`` over all frames and ``ord`` over the frames that are inferred."""
    inf = F.col("frame_id") % stride == 0
    return (Timeline(frames.select("slot_id", "frame_id").withColumn("is_inf", inf), ["slot_id"], ["frame_id"],
                     bucket_of("frame_id", bucket))
            .running_sum(seq=F.lit(1), ord=F.col("is_inf").cast("int")).apply())


def with_sessions(seen: DataFrame, clock: DataFrame, keys: list[str], max_misses: int, stride: int,
                  bucket: int, linger: int = 0) -> tuple[DataFrame, DataFrame]:
    """Cut the occupied frames of each key into sessions that cannot influence each other.

    After ``max_misses + 1`` inferred frames without an observation no track is alive, so the next
    observation opens a new session. Returns the occupied frames (keys, frame_id, ord, session) and
    the empty frames inside sessions (keys, frame_id, ord, is_inf, session). Frames are listed as
    long as a track can be reported, and ``linger`` inferred frames more.
    """
    b = bucket_of("seq", bucket)
    rows = written(Timeline(seen, keys, ["seq"], b).lead(_ns=F.col("seq"))
                   .run_start(max_misses + 2, session=F.col("ord")).apply(), "sessions")
    reach = F.col("seq") + (max_misses + 1 + linger) * stride - 1
    upto = F.least(F.coalesce(F.col("_ns") - 1, reach), reach)
    ahead = (rows.filter(upto > F.col("seq"))
             .select(*keys, "session", F.col("ord").alias("_from"), F.explode(F.sequence(F.col("seq") + 1, upto)).alias("seq")))
    ticks = (ahead.join(clock, ["slot_id", "seq"]).filter(F.col("ord") <= F.col("_from") + max_misses + linger)
             .select(*keys, "session", "frame_id", "ord", "is_inf"))
    return rows.select(*keys, "frame_id", "ord", "session"), ticks


def _flat(name: str) -> Column:
    c = F.col(name)
    if name == "polygon":
        return F.flatten(F.transform(c, lambda p: F.array(p["x"], p["y"])))
    if name == "keypoints":
        return F.flatten(F.transform(c, lambda p: F.array(p["x"], p["y"], F.coalesce(p["conf"], F.lit(0.5)))))
    return c.cast("array<double>")


def fold_input(det: DataFrame, frames: DataFrame | None, cfg, candidates: DataFrame | None = None,
               by_label: bool = True, extras: tuple[str, ...] = (), bucket: int = 65536,
               split_sessions: bool = True, linger: int = 0, looks: DataFrame | None = None) -> DataFrame:
    """Detections, candidates and empty frames as one flat table ready to be folded by session.

    Frames are numbered and cut into sessions on narrow rows; detections are joined to them once. Appearance vectors count
    on persons and in every ``reid_stride``-th frame only and are left out elsewhere; ``looks`` (vec_id, embedding) gives
    them by the detections' ``vec_id``.
    """
    det = det.withColumn("label", F.coalesce("label", F.lit("")))  # a missing label is a label of its own
    clock = written(number_frames(frames_of(det) if frames is None else frames, cfg.stride, bucket), "clock")
    grp = F.col("label") if by_label else F.lit("")
    vec = [] if looks is None else ["vec_id"]
    extras = [c for c in extras if c in det.columns]

    def rows_of(df: DataFrame, kind: int) -> DataFrame:
        return df.select("slot_id", grp.alias("grp"), "frame_id", F.lit(kind).alias("kind"), "det_idx", "label",
                         "confidence", "x1", "y1", "x2", "y2", *[_flat(c).alias(c) for c in extras], *vec)

    rows = rows_of(det, DET)
    if candidates is not None:
        missing = [c for c in [*extras, *vec] if c not in candidates.columns]
        types = dict(det.dtypes)
        cand = candidates.filter("label = 'person'").withColumns({c: F.lit(None).cast(types[c]) for c in missing})
        rows = rows.unionByName(rows_of(cand, CANDIDATE))
    keys = ["slot_id", "grp"]
    seen = written(rows.select(*keys, "frame_id").distinct().join(clock, ["slot_id", "frame_id"]).filter("is_inf")
                   .select(*keys, "frame_id", "seq", "ord"), "seen")
    cuts, ticks = with_sessions(seen, clock, keys, cfg.max_misses, cfg.stride, bucket, linger)
    if not split_sessions:
        cuts, ticks = (d.withColumn("session", F.lit(0).cast("long")) for d in (cuts, ticks))
    rows = rows.join(cuts, [*keys, "frame_id"]).withColumn("is_inf", F.lit(True))
    due = None if "embedding" not in extras and looks is None else (
        (F.col("label") == "person") & ((F.col("ord") - 1) % max(1, cfg.reid_stride) == 0))
    if "embedding" in extras:
        rows = rows.withColumn("embedding", F.when(due, F.col("embedding")))
    if looks is not None:  # rows that need no vector keep out of the way of those that do
        rows = rows.withColumns({"_due": F.coalesce(due, F.lit(False)), "vec_id": F.when(due, F.col("vec_id")).otherwise(F.col("frame_id"))})
        looks = looks.select("vec_id", F.lit(True).alias("_due"), F.col("embedding").cast("array<double>").alias("embedding"))
        rows = rows.join(looks, ["vec_id", "_due"], "left").drop("vec_id", "_due")
    zero = F.lit(0.0)
    empty = ticks.withColumns({
        "kind": F.lit(TICK), "det_idx": F.lit(0), "label": F.col("grp"), "confidence": zero, "x1": zero,
        "y1": zero, "x2": zero, "y2": zero})
    return rows.unionByName(empty, allowMissingColumns=True)


def in_parts(rows: DataFrame, part: int, ahead: int) -> DataFrame:
    """Rows with the ``part`` of the session they are in; the last ``ahead`` inferred frames of a part go to the next one too."""
    at, n = F.col("ord") - F.col("session"), F.col("part")
    own = F.floor(at / F.lit(float(part))).cast("long")
    rows = rows.withColumn("part", F.explode(F.when(at % part >= part - ahead, F.array(own, own + 1)).otherwise(F.array(own))))
    return rows.withColumns({"warm": at < n * part, "edge": at == (n + 1) * part - 1})


def fold_sessions(rows: DataFrame, make_engines, schema: str, labels: dict[str, int], name: str, by_label: bool = True,
                  columns: list[str] | None = None, part: int | None = None, ahead: int | None = None,
                  packs: Packed | Records | None = None, digits: int | None = None) -> DataFrame:
    """``make_engines()`` gives engines by name; each walks all sessions, its rows have the name as ``run``.

    The rows are written, all columns or those named, or what ``packs`` makes of the rows of a block. With ``digits``, confidence
    and corners are rounded before. Sessions are those of a label (``by_label``) or of a slot.

    Sessions of more than ``part`` inferred frames are walked in parts by several tasks. The walk of a later part begins ``ahead``
    frames earlier without tracks; old tracks die, so when the part begins it nearly always has the true ones. This is
    checked: sessions in which a part began with other tracks than the part before ended with are folded again, with a whole
    part ahead, then, if need be, as one.
    """
    keys = [*SESSION, *(["part"] if part else [])]
    fields = {f.split()[0]: f for f in schema.split(", ")}
    made = [c for c in fields if columns is None or c in columns or c == "slot_id" or c == "label" and by_label]
    wanted = ["run", *(fields if columns is None else columns)]
    shown = {c: fields[c] for c in made} if packs is None else packs.ddl(fields, made)
    if packs is not None:
        wanted = ["run", *[c for c in shown if c in wanted or c not in made]]
    show = ("session", "part") if part and packs is not None else ("session",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runners = {n: BlockRunner(engine, keys, labels, show) for n, engine in make_engines().items()}

        def checked(out: pa.RecordBatch, n: str, grp, edge, tracks) -> pa.RecordBatch:
            more = {"run": pa.array([n] * len(out), pa.string()), "grp": pa.array(grp, pa.string()),
                    "edge": pa.array(edge, pa.int64()), "tracks": pa.array(tracks, pa.binary())}
            for c, v in more.items():
                out = out.append_column(c, v)
            return out.select([*shown, "session", *more])

        def packed(outs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The output of a block, put together if so asked."""
            if packs is None:
                yield from outs
            elif held := [out for out in outs if len(out)]:
                yield packs.pack(pa.Table.from_batches(held), made)

        def marks(n: str, runner: BlockRunner) -> pa.RecordBatch:
            """Rows that tell the tracks at the edges of parts, without any other value."""
            found, runner.marks = runner.marks, []
            none, m = runner.engine.nothing(), len(found)
            for c in show:
                none = none.append_column(c, pa.array([], pa.int64()))
            if packs is not None:
                none = packs.pack(pa.Table.from_batches([none]), made)
            known = {"slot_id": pa.array([k[0] for k, _, _ in found], pa.int32()), "session": pa.array([k[2] for k, _, _ in found], pa.int64())}
            out = pa.RecordBatch.from_arrays([known[c] if c in known else pa.nulls(m, none.schema.field(c).type) for c in none.schema.names],
                                             names=none.schema.names)
            return checked(out, n, [k[1] for k, _, _ in found], [k[3] + at_end for k, at_end, _ in found], [t for _, _, t in found])

        for table, more in blocks(batches, keys):
            for n, runner in runners.items():
                for out in packed(runner.feed(table, keep_open=more)):
                    none = [None] * len(out)
                    yield checked(out, n, none, none, none)
                if runner.marks:
                    yield marks(n, runner)

    ddl = ", ".join([*shown.values(), "session bigint, run string, grp string, edge bigint, tracks binary"])

    def walked(sessions: DataFrame) -> DataFrame:
        out = by_key(sessions, keys, ["frame_id", "kind", "det_idx"]).mapInArrow(run, ddl)
        if digits is not None:
            out = out.withColumns({c: F.round(c, digits) if packs is None else F.transform(c, lambda x: F.round(x, digits))
                                   for c in ROUNDED if c in shown})
        return written(out, name)

    if not part:
        return walked(rows).select(*wanted)
    done = walked(in_parts(rows, part, ahead))
    wrong = (done.filter("edge IS NOT NULL").groupBy("run", *SESSION, "edge").agg(F.min("tracks").alias("a"), F.max("tracks").alias("b"))
             .filter("a <> b OR length(a) = 0").select(*SESSION).distinct())
    told = done.filter("edge IS NULL")
    if wrong.isEmpty():
        return told.select(*wanted)
    wrong = cut_lineage(wrong)
    again = rows.join(wrong, SESSION, "left_semi")
    again = fold_sessions(again, make_engines, schema, labels, name, by_label, columns, *((part, part) if ahead < part else (None, None)), packs, digits)
    told = told.withColumn("grp", F.col("label") if by_label else F.lit(""))
    return told.join(wrong, SESSION, "left_anti").select(*wanted).unionByName(again)


def number_tracks(rows: DataFrame, bucket: int = 65536) -> DataFrame:
    """``track_id`` 1, 2, ... per slot in order of birth (frame, then detection index)."""
    born = rows.filter("frame_id = birth_frame").select("slot_id", *BORN)
    return rows.join(numbered(born, bucket), ["slot_id", *BORN])


def numbered(born: DataFrame, bucket: int = 65536) -> DataFrame:
    """Births (slot_id, birth_frame, birth_det) with the number of their track."""
    return (Timeline(born, ["slot_id"], [*BORN], bucket_of("birth_frame", bucket))
            .running_sum(track_id=F.lit(1).cast("long")).apply())


def track(det: DataFrame, frames: DataFrame | None = None, cfg: TrackerConfig = TrackerConfig(),
          candidates: DataFrame | None = None, bucket: int = 65536, split_sessions: bool = True,
          looks: DataFrame | None = None, columns: tuple[str, ...] | None = None, digits: int | None = None) -> DataFrame:
    """Track every slot of a detection log.

    ``det`` has slot_id, frame_id, det_idx, label, confidence and corners, optionally polygon,
    keypoints, color_hist and embedding; instead of the latter a ``vec_id`` may name a row of ``looks``
    (vec_id, embedding), which is looked up where a vector counts. ``frames`` lists all processed frames (default: those with
    a detection); ``candidates`` are weaker detections for re-detection. One output row per
    reported (track, frame), with all columns and ``track_id``, or the ``columns`` named; with ``digits``, confidence and
    corners are rounded to that many.

    Labels never mix and a quiet spell ends every track, so the work unit is a session of one label
    of one slot. With ``filter="auto"`` the filter choice is shared by a slot and so is the fold.
    The folded table is written to the checkpoint folder: it is the costly part and is read twice
    for numbering. It has one row a track and block, which is also what meets the numbers.
    """
    made = None if columns is None else list(dict.fromkeys(
        [*NUMBERED, *(["hits"] if cfg.min_hits > 1 else []), *(c for c in columns if c != "track_id")]))
    done = _folded(det, frames, {"": cfg}, candidates, bucket, split_sessions, looks, made, Packed(), digits).drop("run")
    if columns is None or "track_id" in columns:
        born = done.filter(F.get("frame_id", F.lit(0)) == F.col("birth_frame")).select("slot_id", *BORN)
        done = done.join(numbered(born, bucket), ["slot_id", *BORN])
    rows = unpacked(done, "track_id")
    rows = rows.filter(F.col("hits") >= cfg.min_hits) if cfg.min_hits > 1 else rows
    return rows if columns is None else rows.select(*columns)


NUMBERED = ("slot_id", "frame_id", "birth_frame", "birth_det")
REPORTED = ("slot_id", "frame_id", "birth_frame", "birth_det", "x1", "y1", "x2", "y2")


def track_runs(det: DataFrame, frames: DataFrame | None, runs: dict[str, TrackerConfig],
               columns: tuple[str, ...] = REPORTED, bucket: int = 65536) -> DataFrame:
    """The rows of :func:`track` under several settings, with the name of the ``run``, from one fold of the same rows.

    Tracks are named by (birth_frame, birth_det), not numbered; only ``columns`` are written. The settings share stride,
    misses and the confirmation at the first hit.
    """
    _alike(runs)
    made = list(dict.fromkeys([*NUMBERED, *columns]))
    return unpacked(_folded(det, frames, runs, None, bucket, columns=made, packs=Packed()), "run").select("run", *columns)


def run_records(det: DataFrame, frames: DataFrame | None, runs: dict[str, TrackerConfig], bucket: int = 65536) -> tuple[DataFrame, DataFrame]:
    """What :func:`track_runs` comes to: one record a track, named by ``BORN``, and the number of tracks in each frame of a slot.

    Tracks are summed up where they are folded, so the rows themselves are neither written nor shuffled.
    """
    _alike(runs)
    return records_of(_folded(det, frames, runs, None, bucket, columns=[*REPORTED, "label"], packs=Records()))


def _alike(runs: dict[str, TrackerConfig]) -> None:
    if len({(c.stride, c.max_misses) for c in runs.values()}) > 1 or any(c.min_hits > 1 or c.redetect or c.filter == "auto" for c in runs.values()):
        raise ValueError("runs must share stride and max_misses, and confirm at once")


def _folded(det: DataFrame, frames: DataFrame | None, runs: dict[str, TrackerConfig], candidates: DataFrame | None,
            bucket: int, split_sessions: bool = True, looks: DataFrame | None = None,
            columns: list[str] | None = None, packs: Packed | Records | None = None, digits: int | None = None) -> DataFrame:
    cfg = next(iter(runs.values()))
    reid = any(c.reid for c in runs.values())
    extras = tuple(c for c in LISTS if (c in det.columns or c == "embedding" and looks is not None) and (reid or c != "embedding"))
    auto = cfg.filter == "auto"
    split = split_sessions and not auto
    # a fold over several sessions has to see the frame in which the last tracks of each one expire
    rows = fold_input(det, frames, cfg, candidates if cfg.redetect else None, not auto, extras, bucket,
                      split, linger=0 if split else 1, looks=looks if reid else None)
    ddl = ", ".join([BASE_DDL, *[EXTRA_DDL[c] for c in extras if c in EXTRA_DDL]])
    return fold_sessions(rows, lambda: {n: Tracker(c, extras, SESSION) for n, c in runs.items()}, ddl, LABELS, "tracks",
                         not auto, columns, *((PART, AHEAD) if split else (None, None)), packs, digits)


def carry_forward(det: DataFrame, frames: DataFrame, stride: int, bucket: int = 65536) -> DataFrame:
    """On frames that are not inferred, the non-person rows of the last inferred frame of the slot, with its ``from_frame``."""
    inferred = F.when(F.col("frame_id") % stride == 0, F.col("frame_id"))
    clock = (Timeline(frames.select("slot_id", "frame_id").distinct(), ["slot_id"], ["frame_id"], bucket_of("frame_id", bucket))
             .ffill(from_frame=inferred).apply().filter("frame_id <> from_frame"))
    rows = det.filter(~F.col("label").eqNullSafe("person")).withColumnRenamed("frame_id", "from_frame")
    return clock.join(rows.drop("ts"), ["slot_id", "from_frame"])


def predict_fill(tracks: DataFrame, det: DataFrame, frames: DataFrame, stride: int) -> DataFrame:
    """What a slot shows on frames that are not inferred: predicted persons and the last rows of everything else."""
    common = ["slot_id", "frame_id", "label", "confidence", "x1", "y1", "x2", "y2"]
    persons = tracks.filter((F.col("frame_id") % stride != 0) & (F.col("label") == "person"))
    return (persons.select(*common, "track_id", F.lit(True).alias("predicted_only"))
            .unionByName(carry_forward(det, frames, stride).select(*common, F.lit(None).cast("long").alias("track_id"), F.lit(False).alias("predicted_only"))))
