"""Target lifecycle: created / updated / recovered / lost / removed, and the events made from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.targets import format_target_id
from ..sources.detections import on_clock
from .fold import ordered_fold
from .materialize import cut_lineage
from .timeline import Timeline, asof_forward, bucket_of, ordinal

STATES = ["ACTIVE", "LOST", "LOCKED", "RECOVERED", "REMOVED"]
# Legal state changes: fixed values.
EDGES = [("ACTIVE", "LOST"), ("ACTIVE", "LOCKED"), ("LOST", "RECOVERED"), ("LOST", "REMOVED"),
         ("RECOVERED", "ACTIVE"), ("LOCKED", "ACTIVE")]
COUNTED = ["created", "updated", "recovered", "lost", "removed"]
KEY = ["slot_id", "track_id"]
HOUR_US = 3_600_000_000


def micros(c: Column) -> Column:
    """Seconds to whole microseconds, in which all time limits are compared."""
    return F.round(c * 1e6).cast("long")


def _asof(rows: DataFrame, clock: DataFrame, at: Column, name: str, width: float) -> DataFrame:
    marked = rows.withColumn("_at", at)
    return asof_forward(marked, clock, ["slot_id"], "_at", "us", width, name).drop("_at")


def lifecycle(tracks: DataFrame, clock: DataFrame, stale: float = 5.0, removal: float = 30.0,
              bucket_s: float = 3600.0) -> DataFrame:
    """Lifecycle of every track from its observations and the frame clock of its slot.

    A target is lost at the first slot frame at or after ``last observation + stale``, removed at
    the first later frame at or after ``lost + removal``, provided the track is not seen before.
    An observation after a loss recovers the target, after a removal it opens a new one
    (``generation``). Times must be positive; one row per (slot, track, frame) is expected.
    """
    if stale <= 0 or removal <= 0:
        raise ValueError("stale and removal must be positive")
    width = bucket_s * 1e6
    stale_us, removal_us = int(round(stale * 1e6)), int(round(removal * 1e6))
    ticks = clock.select("slot_id", micros(F.col("ts")).alias("us"), "frame_id", "ts")
    obs = tracks.select(*KEY, "frame_id", "ts", micros(F.col("ts")).alias("us"))
    obs = (Timeline(obs, KEY, ["us", "frame_id"], bucket_of("us", width))
           .lead(next_us=F.col("us"), next_frame=F.col("frame_id")).apply())
    obs = cut_lineage(obs)

    # Only observations followed by a gap can lead to a loss; the others skip both look-ups.
    gap = F.col("next_us").isNull() | (F.col("next_us") - F.col("us") >= stale_us)

    def before_next(hit: str) -> Column:
        return F.col(hit).isNotNull() & (
            F.col("next_us").isNull() | (F.col(f"{hit}.us") < F.col("next_us"))
            | ((F.col(f"{hit}.us") == F.col("next_us")) & (F.col(f"{hit}.frame_id") < F.col("next_frame"))))

    gone = _asof(obs.filter(gap).select(*KEY, "frame_id", "us", "next_us", "next_frame"),
                 ticks, F.col("us") + stale_us, "lost", width).filter(before_next("lost"))
    gone = cut_lineage(gone)
    gone = _asof(gone, ticks, F.col("lost.us") + removal_us, "removed", width)
    gone = gone.withColumn("removed", F.when(before_next("removed"), F.col("removed")))
    marks = cut_lineage(gone.select(*KEY, "frame_id", "us", "lost", "removed"))

    rows = obs.drop("next_us", "next_frame").join(marks, [*KEY, "frame_id", "us"], "left")
    rows = (Timeline(rows, KEY, ["us", "frame_id"], bucket_of("us", width))
            .lag(prev_lost=F.col("lost").isNotNull(), prev_removed=F.col("removed").isNotNull())
            .running_sum(_gone=F.col("removed").isNotNull().cast("int")).apply())
    event = (F.when(F.col("prev_lost").isNull() | F.col("prev_removed"), "created")
             .when(F.col("prev_lost"), "recovered").otherwise("updated"))
    generation = F.col("_gone") - F.col("removed").isNotNull().cast("int")

    def entry(name: Column, at: str | None) -> Column:
        ts = F.col("ts") if at is None else F.col(f"{at}.ts")
        frame = F.col("frame_id") if at is None else F.col(f"{at}.frame_id")
        us = F.col("us") if at is None else F.col(f"{at}.us")
        last = F.col("ts") if at is None else F.col("lost.ts")
        return F.struct(name.alias("event"), frame.alias("frame_id"), ts.alias("ts"), us.alias("us"),
                        last.alias("last_seen"))

    out = F.array_compact(F.array(
        entry(event, None), F.when(F.col("lost").isNotNull(), entry(F.lit("lost"), "lost")),
        F.when(F.col("removed").isNotNull(), entry(F.lit("removed"), "removed"))))
    return (rows.select(*KEY, generation.cast("long").alias("generation"), F.inline(out)))


def number_targets(events: DataFrame) -> DataFrame:
    """Add ``target_number`` and ``target_id``: one counter over all slots, in order of creation."""
    key = [*KEY, "generation"]
    events = cut_lineage(events)
    born = events.filter("event = 'created'").select(*key, "us", "frame_id")
    born = ordinal(born, [], ["us", "slot_id", "frame_id", "track_id"], name="target_number")
    return (events.join(born.select(*key, "target_number"), key)
            .withColumn("target_id", format_target_id(F.col("slot_id"), F.col("target_number"))))


def lifecycle_counts(events: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Per frame the number of created, updated, recovered, lost and removed targets.

    ``frames`` is the frame clock: its quiet frames are counted with zeros. Without it only frames with an event show.
    """
    counts = (events.groupBy("slot_id", "frame_id").pivot("event", COUNTED).agg(F.count(F.lit(1)))
              .na.fill(0, COUNTED))
    return counts if frames is None else on_clock(counts, frames)


def to_events(numbered: DataFrame) -> DataFrame:
    """Typed target events with payload and a running event id over all slots."""
    kinds = [k for k in COUNTED if k != "updated"] + ["locked"]
    rows = ordinal(numbered.filter(F.col("event").isin(kinds)), [], ["us", "slot_id", "frame_id", "track_id", "event"],
                   name="_n")
    track, seen = F.col("track_id").cast("string"), F.col("last_seen").cast("string")
    payload = (
        F.when(F.col("event") == "created", F.create_map(
            F.lit("initial_state"), F.lit("ACTIVE"), F.lit("track_id"), track, F.lit("priority"), F.lit("0")))
        .when(F.col("event") == "lost", F.create_map(F.lit("last_seen"), seen))
        .when(F.col("event") == "recovered", F.create_map(F.lit("new_track_id"), track, F.lit("last_seen"), seen))
        .when(F.col("event") == "locked", F.create_map(F.lit("locked_by"), F.lit("manager")))
        .otherwise(F.create_map(F.lit("final_state"), F.lit("LOST"), F.lit("reason"), F.lit("lifecycle"))))
    return rows.select(
        F.format_string("evt-%06d", F.col("_n")).alias("event_id"),
        F.concat(F.lit("target."), F.col("event")).alias("event_type"),
        F.col("ts").alias("timestamp"), "target_id", "slot_id", payload.alias("payload"))


def snapshot_events(snapshots: DataFrame, event_type: str = "target.snapshot") -> DataFrame:
    """One event per snapshot, stamped with the time of the snapshot."""
    return snapshots.select(F.lit(event_type).alias("event_type"), F.col("timestamp"),
                            F.struct(*snapshots.columns).alias("snapshot"))


def validate_transitions(df: DataFrame) -> DataFrame:
    """Add ``legal``, the ``allowed`` next states and ``terminal`` to rows of (from_state, to_state)."""
    allowed = {s: sorted(b for a, b in EDGES if a == s) for s in STATES}
    table = F.create_map(*[x for s, nxt in allowed.items() for x in (
        F.lit(s), F.array(*[F.lit(n) for n in nxt]).cast("array<string>"))])
    nxt = table[F.col("from_state")]
    return df.withColumns({"allowed": nxt, "legal": F.coalesce(F.array_contains(nxt, F.col("to_state")), F.lit(False)),
                           "terminal": F.coalesce(F.size(nxt) == 0, F.lit(False))})


def target_states(numbered: DataFrame) -> DataFrame:
    """State of every target after its last event; removed targets are gone."""
    after = F.when(F.col("event") == "lost", "LOST").when(F.col("event") == "removed", "REMOVED").otherwise("ACTIVE")
    step = F.when(F.col("event") == "lost", 1).when(F.col("event") == "removed", 2).otherwise(0)
    return (numbered.groupBy("slot_id", "track_id", "target_id")
            .agg(F.max_by(F.struct(after.alias("state"), F.col("last_seen")),
                          F.struct(F.col("us"), F.col("frame_id"), step)).alias("s"))
            .select("slot_id", "track_id", "target_id", "s.*").filter("state <> 'REMOVED'"))


def targets_by_state(targets: DataFrame, state: str) -> DataFrame:
    return targets.filter(F.col("state") == state)


FSM_DDL = ("slot_id int, track_id bigint, generation bigint, event string, frame_id bigint, ts double, "
           "us bigint, last_seen double, state string")


def lifecycle_fsm(tracks: DataFrame, commands: DataFrame, clock: DataFrame, stale: float = 5.0,
                  removal: float = 30.0, bucket_s: float = 3600.0) -> DataFrame:
    """Lifecycle with lock / unlock / remove commands (slot_id, track_id, ts, command).

    A locked target is never lost; unlocking makes it ACTIVE again, a remove command takes effect
    on a lost target only. A command is handled after the frames of its time, commands of one time in the order of their
    names (lock, remove, unlock); commands without a kind, slot or track are left out. Tracks that get no command go through :func:`lifecycle`; the others are folded, one track after
    the other. The slot frames in which a target would be lost or removed are looked up beforehand, for
    observations followed by a gap and for unlock commands only.
    """
    width, stale_us, removal_us = bucket_s * 1e6, int(round(stale * 1e6)), int(round(removal * 1e6))
    given = commands.select(*KEY, "ts", F.col("command").alias("what")).dropna()
    told = given.select(*KEY).distinct()
    after = F.when(F.col("event") == "lost", "LOST").when(F.col("event") == "removed", "REMOVED").otherwise("ACTIVE")
    names = [c.split()[0] for c in FSM_DDL.split(", ")]
    plain = (lifecycle(tracks.join(told, KEY, "left_anti"), clock, stale, removal, bucket_s)
             .withColumn("state", after).select(*names))

    ticks = clock.select("slot_id", micros(F.col("ts")).alias("us"), "frame_id", "ts")
    obs = tracks.join(told, KEY, "left_semi").select(*KEY, "frame_id", "ts", micros(F.col("ts")).alias("us"))
    obs = Timeline(obs, KEY, ["us", "frame_id"], bucket_of("us", width)).lead(next_us=F.col("us")).apply()
    gap = F.col("next_us").isNull() | (F.col("next_us") - F.col("us") >= stale_us)
    obs = obs.select(*KEY, "frame_id", "ts", "us", F.lit("seen").alias("what"), F.lit(stale_us).alias("wait"), gap.alias("ask"))
    cmd = given.select(*KEY, F.lit(-1).cast("long").alias("frame_id"), "ts", micros(F.col("ts")).alias("us"),
                       "what", F.lit(1).alias("wait"), (F.col("what") == "unlock").alias("ask"))
    rows = cut_lineage(obs.unionByName(cmd))
    asked = cut_lineage(_asof(rows.filter("ask"), ticks, F.col("us") + F.col("wait"), "lost", width))
    asked = _asof(asked, ticks, F.col("lost.us") + removal_us, "removed", width)
    rows = rows.filter("NOT ask").unionByName(asked, allowMissingColumns=True)
    flat = rows.select(
        *KEY, "frame_id", "ts", "us", "what", (F.col("what") != "seen").cast("int").alias("after"),
        *[F.coalesce(F.col(f"{h}.{c}"), F.lit(-1)).alias(f"{h}_{c}") for h in ("lost", "removed")
          for c in ("us", "frame_id", "ts")])
    return plain.unionByName(ordered_fold(flat, KEY, ["us", "after", "frame_id", "what"], _fsm_step, FSM_DDL, _fsm_finish))


class _Target:
    """One track in the fold: its target state and the frames in which it would be lost or removed."""

    def __init__(self, slot: int, track: int):
        self.key, self.state, self.generation, self.last_seen = (slot, track), None, 0, 0.0
        self.due = self.gone = None
        self.out = []

    def emit(self, event: str, us: int, frame: int, ts: float) -> None:
        self.out.append((*self.key, self.generation, event, frame, ts, us, self.last_seen, self.state))

    def sweep(self, us: int, frame: int) -> None:
        """Losses and removals in slot frames before (us, frame)."""
        if self.state == "ACTIVE" and self.due and self.due[:2] < (us, frame):
            at, self.gone = self.due[:3], self.due[3]
            self.state, self.last_seen, self.due = "LOST", at[2], None
            self.emit("lost", *at)
        if self.state == "LOST" and self.gone and self.gone[:2] < (us, frame):
            self.remove(*self.gone)

    def remove(self, us: int, frame: int, ts: float) -> None:
        self.state = "REMOVED"
        self.emit("removed", us, frame, ts)
        self.state, self.due, self.gone, self.generation = None, None, None, self.generation + 1

    def take(self) -> pd.DataFrame:
        rows, self.out = self.out, []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FSM_DDL.split(", ")])


_ON_SEEN = {None: "created", "ACTIVE": "updated", "LOST": "recovered", "LOCKED": "kept"}
_LAST = np.iinfo(np.int64).max


def _fsm_step(t: _Target | None, rows: pd.DataFrame):
    for r in rows.itertuples(index=False):
        t = t or _Target(r.slot_id, r.track_id)
        gone = (r.removed_us, r.removed_frame_id, r.removed_ts) if r.removed_us >= 0 else None
        due = (r.lost_us, r.lost_frame_id, r.lost_ts, gone) if r.lost_us >= 0 else None
        if r.what == "seen":
            t.sweep(r.us, r.frame_id)
            event = _ON_SEEN[t.state]
            t.state = "LOCKED" if t.state == "LOCKED" else "ACTIVE"
            t.last_seen, t.due, t.gone = r.ts, due, None
            t.emit(event, r.us, r.frame_id, r.ts)
            continue
        t.sweep(r.us, _LAST)
        if r.what == "lock" and t.state == "ACTIVE":
            t.state = "LOCKED"
            t.emit("locked", r.us, r.frame_id, r.ts)
        elif r.what == "unlock" and t.state == "LOCKED":
            t.state = "ACTIVE"
            # lost in the first frame that is both after the unlocking and past the stale limit
            t.due = max(t.due, due, key=lambda d: d[:2]) if t.due and due else None
            t.emit("unlocked", r.us, r.frame_id, r.ts)
        elif r.what == "remove" and t.state == "LOST":
            t.remove(r.us, r.frame_id, r.ts)
    return t, t.take()


def _fsm_finish(t: _Target) -> pd.DataFrame:
    t.sweep(_LAST, _LAST)
    return t.take()
