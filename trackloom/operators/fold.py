"""Keyed ordered folds: per-key sequential rules over a sorted stream of Arrow batches.

Rows are hash-partitioned by key and sorted inside the partition, so a task walks one key after the
other and never holds more than one batch plus the state of the key it is in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def key_slices(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive runs of equal key values."""
    if pdf.empty:
        return
    change = np.zeros(len(pdf), dtype=bool)
    change[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(change)
    for a, b in zip(starts, [*starts[1:], len(pdf)]):
        part = pdf.iloc[a:b]
        yield tuple(part[k].iat[0] for k in keys), part


def by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows hash-partitioned by key and sorted inside the partitions.

    The number of partitions is given outright: Python work per row is heavy for its bytes, so the
    partitions must not be merged by size. Rows are dealt by a hash of the keys, not by the keys: after a join on the same
    keys Spark would leave the exchange out, and the join may be carried out so that a key lies in several partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def _joined(parts: list[pd.DataFrame | None]) -> Iterator[pd.DataFrame]:
    """The outputs of a batch as one frame."""
    parts = [p for p in parts if p is not None and len(p)]
    if parts:
        yield parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)


def ordered_fold(df: DataFrame, keys: list[str], order: list[str],
                 step: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame | None]],
                 schema: str, finish: Callable[[object], pd.DataFrame | None] | None = None) -> DataFrame:
    """``step(state, rows)`` gets the rows of one key in order, possibly in several calls.

    ``state`` is None on the first call of a key; the second value returned is the output.
    ``finish(state)`` may add output after the last row of a key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, out = None, None, []
        for pdf in batches:
            for key, rows in key_slices(pdf, keys):
                if key != current:
                    if finish is not None and state is not None:
                        out.append(finish(state))
                    current, state = key, None
                state, part = step(state, rows)
                out.append(part)
            yield from _joined(out)
            out = []
        if finish is not None and state is not None:
            yield from _joined([finish(state)])

    return by_key(df, keys, order).mapInPandas(run, schema)


def _typed(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def bucketed_fold(rows: DataFrame, keys: list[str], bucket: str, order: list[str], narrow: list[str],
                  describe: Callable[[dict], list[int]], advance: Callable[[int, list[int]], int],
                  step: Callable[[int, dict], tuple[int, list[int], dict]], schema: str, start: int) -> DataFrame:
    """A fold with an integer state whose keys are cut into buckets that are walked in parallel.

    ``describe(columns of a bucket)`` gives what the bucket makes of *any* state that may come in, as a list of
    integers; ``advance(state, description)`` applies it. One row per bucket is carried along its key that way;
    then ``step(state, columns)`` walks every bucket from its own incoming state and gives the new state, the places of
    the rows that come out and columns to add to them. Columns are the ``narrow`` ones as arrays: buckets may be small and
    many, so a batch is taken apart once. A task holds these of one bucket. The key sees ``start`` first. ``rows`` is read twice.
    """
    unit = [*keys, bucket]

    def parts(pdf: pd.DataFrame) -> Iterator[tuple[int, dict]]:
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        for k in unit:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        columns = {c: pdf[c].to_numpy() for c in narrow}
        starts = np.flatnonzero(change).tolist()
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            yield a, {c: v[a:b] for c, v in columns.items()}

    def key_at(pdf: pd.DataFrame, row: int) -> tuple:
        return tuple(pdf[k].iat[row] for k in unit)

    def whole(held: list[dict]) -> dict:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in narrow}

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []  # the last bucket of a batch may go on in the next
        for pdf in batches:
            if pdf.empty:
                continue
            done, effects, at = [], [], None
            if held and key_at(pdf, 0) != key:
                yield pd.DataFrame([(*key, describe(whole(held)))], columns=[*unit, "_map"])
                held = []
            for a, part in parts(pdf):
                if at is not None:
                    done.append(at)
                    effects.append(describe(whole(held)))
                    held = []
                at = a
                held.append(part)
            key = key_at(pdf, len(pdf) - 1)
            if done:
                yield pdf[unit].iloc[done].assign(_map=effects)
        if held:
            yield pd.DataFrame([(*key, describe(whole(held)))], columns=[*unit, "_map"])

    def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, at = None, start
        for pdf in batches:
            into = []
            for key, effect in zip(zip(*[pdf[k].tolist() for k in keys]), pdf["_map"]):
                if key != current:
                    current, at = key, start
                into.append(at)
                at = advance(at, effect)
            yield pdf[unit].assign(_in=into)

    names = [f.split()[0].strip("`") for f in schema.split(", ")]

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, start
        for pdf in batches:
            if pdf.empty:
                continue
            into, at, more = pdf["_in"].to_numpy(), [], {}
            goes_on = key_at(pdf, 0) == current
            for a, part in parts(pdf):
                state, places, added = step(state if a == 0 and goes_on else int(into[a]), part)
                at += [a + int(k) for k in places]
                for c, v in added.items():
                    more.setdefault(c, []).extend(v)
            current = key_at(pdf, len(pdf) - 1)
            if at:  # without rows, added columns would have no type
                yield pdf[[n for n in names if n not in more and n in pdf]].iloc[at].assign(**more)[names]

    wanted = list(dict.fromkeys([*unit, *order, *narrow]))
    effects = by_key(rows.select(*wanted), unit, order).mapInPandas(described, f"{_typed(rows, unit)}, _map array<bigint>")
    into = by_key(effects, keys, [bucket]).mapInPandas(along, f"{_typed(rows, unit)}, _in bigint")
    met = rows.join(into, unit, "left").withColumn("_in", F.coalesce("_in", F.lit(start)))
    return by_key(met, unit, order).mapInPandas(walked, schema)
