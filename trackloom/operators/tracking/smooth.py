"""Filtering and smoothing along given tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..fold import by_key, ordered_fold
from ..materialize import cut_lineage
from . import filters
from .blocks import Bank, BlockRunner, Engine, Rows, Step

DDL = ("slot_id int, track_id bigint, frame_id bigint, x1 double, y1 double, x2 double, y2 double, "
       "vx double, vy double, nis double")


class _Smoother(Engine):
    """One filter per (slot, track): predict on every row, correct with its box."""

    pieces = False

    def __init__(self, kind: int, clip: float, sigma: float):
        self.kind, self.clip, self.sigma = kind, clip, sigma

    def empty(self) -> Bank:
        x, p, q = filters.start(np.zeros((0, 4)))
        return Bank(g=np.zeros(0, dtype=np.int64), x=x, p=p, q=q)

    def step(self, t: Bank, rows: Rows, s: Step, block_keys: list[tuple]):
        box = rows.box[s.rows]
        at = np.searchsorted(s.row_group, t.g)
        nis = np.full(len(s.rows), np.nan)
        if len(t):
            x, p, _ = filters.predict(t.x, t.p, t.q, self.clip, self.kind == filters.MANIFOLD)
            t.x, t.p, t.q, nis[at], _ = filters.correct(x, p, t.q, box[at], self.clip, self.kind, self.sigma)
        fresh = np.ones(len(s.rows), dtype=bool)
        fresh[at] = False
        if fresh.any():
            x, p, q = filters.start(box[fresh])
            t = t.join(Bank(g=s.row_group[fresh], x=x, p=p, q=q))
            t = t.take(np.argsort(t.g, kind="stable"))
        return t, dict(g=t.g, frame_id=s.frame_id, box=filters.corners(t.x), vel=t.x[:, 4:6].copy(), nis=nis)

    def batch(self, d, block_keys, labels) -> pa.RecordBatch:
        slot = np.array([k[0] for k in block_keys], dtype=np.int32)
        track = np.array([k[1] for k in block_keys], dtype=np.int64)
        cols = {"slot_id": pa.array(slot[d["g"]]), "track_id": pa.array(track[d["g"]]),
                "frame_id": pa.array(d["frame_id"]),
                **{c: pa.array(d["box"][:, i].copy()) for i, c in enumerate(("x1", "y1", "x2", "y2"))},
                "vx": pa.array(d["vel"][:, 0].copy()), "vy": pa.array(d["vel"][:, 1].copy()),
                "nis": pa.array(d["nis"], from_pandas=True)}
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def kalman_smooth(tracks: DataFrame, filter: str = "ukf", velocity_clip: float = 0.30,
                  kernel_sigma: float = 0.25) -> DataFrame:
    """Filtered boxes, velocity and fit of every observation of given tracks."""
    kind = filters.KINDS[filter]
    rows = tracks.select("slot_id", "track_id", "frame_id", F.lit(0).cast("long").alias("ord"),
                         F.lit(True).alias("is_inf"), "x1", "y1", "x2", "y2")
    keys = ["slot_id", "track_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from BlockRunner(_Smoother(kind, velocity_clip, kernel_sigma), keys, {}).run(batches)

    return by_key(rows, keys, ["frame_id"]).mapInArrow(run, DDL)


def _carried(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The value that comes into each row along its key when a row turns m into ``a`` m + ``c``, from the first ``v``."""
    cols = [*keys, *order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, m = None, 0.0
        for pdf in batches:
            if pdf.empty:
                continue
            goes_on = np.ones(len(pdf), dtype=bool)
            for k in keys:
                values = pdf[k].to_numpy()
                goes_on[1:] &= values[1:] == values[:-1]
            goes_on[0] = current == tuple(pdf[k].iat[0] for k in keys)
            into = []
            for a, c, first, same in zip(pdf["a"].tolist(), pdf["c"].tolist(), pdf["v"].tolist(), goes_on.tolist()):
                m = m if same else first
                into.append(m)
                m = a * m + c
            current = tuple(pdf[k].iat[-1] for k in keys)
            yield pdf[cols].assign(_in=into)

    ddl = ", ".join(f"`{n}` {t}" for n, t in rows.select(*cols).dtypes) + ", _in double"
    return by_key(rows, keys, order).mapInPandas(run, ddl)


def ema(df: DataFrame, alpha: float, keys: list[str], order: list[str], value: str, name: str = "ema",
        piece: int = 4096) -> DataFrame:
    """Exponential mean along each key: ``alpha`` x new + (1 - alpha) x old, started by the first value.

    Rows are cut into pieces of ``piece`` values of the leading order column. Over the first i rows of a piece an
    incoming mean m becomes (1 - alpha)^i m + c(i). The c(i) are running sums of values over powers of (1 - alpha),
    taken over short strips in which the powers stay in range; strips are chained inside a piece, and a table with
    one row per piece carries the mean along the key. Null values count as 0.
    """
    b = 1.0 - alpha
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    if b == 0.0:
        return df.withColumn(name, v)
    strip = 64 if b >= 1e-3 else 1
    pieces = df.withColumn("_pc", F.floor(F.col(order[0]) / piece).cast("long"))
    place = F.row_number().over(W.partitionBy(*keys, "_pc").orderBy(*order, value)) - 1
    rows = pieces.withColumn("_i", place).withColumns({
        "_v": v, "_st": F.floor(F.col("_i") / strip), "_r": F.col("_i") % strip})
    upto = W.partitionBy(*keys, "_pc", "_st").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.sum(F.col("_v") * alpha / F.pow(F.lit(b), "_r")).over(upto) * F.pow(F.lit(b), "_r"))

    # a strip of n rows turns m into b^n m + c
    strips = rows.groupBy(*keys, "_pc", "_st").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("_c", "_i").alias("c"), F.min_by("_v", "_i").alias("v"))
    chain = strips.groupBy(*keys, "_pc").agg(F.array_sort(F.collect_list(F.struct("_st", "n", "c", "v"))).alias("_s"))
    own = F.aggregate("_s", F.lit(0.0), lambda acc, q: acc * F.pow(F.lit(b), q["n"]) + q["c"])
    size = F.aggregate("_s", F.lit(0).cast("long"), lambda acc, q: acc + q["n"])
    effects = chain.select(*keys, "_pc", own.alias("c"), F.pow(F.lit(b), size).alias("a"), F.col("_s")[0]["v"].alias("v"))

    into = _carried(effects, [*keys], ["_pc"])
    strips = strips.join(into.withColumnRenamed("_in", "_from"), [*keys, "_pc"])
    entries = _carried(strips.select(*keys, "_pc", "_st", F.pow(F.lit(b), "n").alias("a"), "c", F.col("_from").alias("v")),
                       [*keys, "_pc"], ["_st"])
    return (rows.join(entries, [*keys, "_pc", "_st"])
            .select(*df.columns, (F.col("_in") * F.pow(F.lit(b), F.col("_r") + 1) + F.col("_c")).alias(name)))


def embedding_ema(df: DataFrame, keys: list[str], order: str, vector: str = "embedding",
                  keep: float = 0.8, tail: int = 256) -> DataFrame:
    """Appearance vector of each track: weight ``keep`` on the past, back to unit length each time.

    Rows seen while the track was occluded (``misses`` > 0) are left out. The past fades, so a track longer than
    ``tail`` rows is folded over its last ``tail`` rows, from three unlike starts at once. Where the three ends agree
    to 1e-12 the mean no longer depends on what came before; tracks where they do not are folded whole.
    Only ``tail`` rows a track and input task move.
    """
    rows = df.filter(F.coalesce("misses", F.lit(0)) == 0) if "misses" in df.columns else df
    rows = rows.filter(F.col(vector).isNotNull()).select(*keys, order, vector)
    types = dict(df.dtypes)

    def folded(rows: DataFrame, starts: int) -> DataFrame:
        def step(state, part):
            key, means = state or (tuple(part[k].iat[0] for k in keys), None)
            for v in part[vector]:
                v = np.asarray(v, dtype=np.float64)
                if means is None:
                    means = np.stack([v, -v, np.roll(v, 1)][:starts])
                    continue
                means = keep * means + (1.0 - keep) * v
                norms = np.linalg.norm(means, axis=1, keepdims=True)
                means = means / np.where(norms > 1e-6, norms, 1.0)
            return (key, means), None

        def finish(state) -> pd.DataFrame:
            key, means = state
            return pd.DataFrame([(*key, means[0], bool(np.abs(means - means[0]).max(initial=0.0) <= 1e-12))],
                                columns=[*keys, vector, "_settled"])

        schema = ", ".join([*[f"{k} {types[k]}" for k in keys], f"{vector} array<double>", "_settled boolean"])
        return ordered_fold(rows, keys, [order], step, schema, finish)

    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))
    last = folded(rows.withColumn("_place", place).filter(F.col("_place") <= tail).drop("_place"), 3)
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    known = cut_lineage(counts.alias("c").join(last.alias("t"), same).select("c.*", f"t.{vector}", "t._settled"))

    # the first of the three starts is the first vector of the tail: right as it is for a track without more rows
    long = known.filter((F.col("n") > tail) & ~F.col("_settled")).select(*keys, "n")
    of_long = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    whole = folded(rows.alias("r").join(long.alias("l"), of_long, "left_semi"), 1)
    whole = long.alias("l").join(whole.alias("r"), of_long).select(*[f"l.{k}" for k in keys], f"r.{vector}", "l.n")
    return known.filter((F.col("n") <= tail) | F.col("_settled")).select(*keys, vector, "n").unionByName(whole)
