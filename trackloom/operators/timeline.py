"""Ordered calculations along a key that may hold a very large share of all rows.

A plain ``Window.partitionBy(key).orderBy(time)`` puts a whole camera or track into one task.
Here each key is cut into time buckets: a window runs inside every (key, bucket) in parallel,
a small table with one row per (key, bucket) is made by an aggregate with map-side combine, and
what one bucket hands to the next is worked out on that small table and joined back. Bucket width
is given in units of the order column, so the rows of a bucket are bounded by the source's rate.

The input is read twice, once for each of the two tables. Jobs that chain time lines therefore put
their narrow intermediate rows into the checkpoint folder in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .materialize import cut_lineage


class Timeline:
    """Collects lag / lead / running / fill columns and computes them in one bucketed pass."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], bucket: Column):
        self.df, self.keys, self.order, self.bucket = df, list(keys), list(order), bucket
        self.specs: list[tuple[str, str, Column]] = []

    def _add(self, kind: str, **cols: Column) -> "Timeline":
        self.specs += [(kind, name, c) for name, c in cols.items()]
        return self

    def lag(self, **cols: Column):
        return self._add("lag", **cols)

    def lead(self, **cols: Column):
        return self._add("lead", **cols)

    def running_sum(self, **cols: Column):
        """Sum over all rows up to and including this one."""
        return self._add("sum", **cols)

    def ffill(self, **cols: Column):
        """Latest non-null value at or before this row."""
        return self._add("ffill", **cols)

    def bfill(self, **cols: Column):
        """Next non-null value at or after this row."""
        return self._add("bfill", **cols)

    def run_start(self, gap: float, **cols: Column):
        """Start value of the run a row is in; a run begins where the value grows by ``gap`` or more.

        The value must not fall along the order.
        """
        (name, c), = cols.items()
        self.specs.append((("run", gap), name, c))
        return self

    def suffix_min(self, **cols: Column):
        """Smallest value at or after this row."""
        return self._add("smin", **cols)

    def apply(self) -> DataFrame:
        order = F.struct(*self.order)
        local = W.partitionBy(*self.keys, "_b").orderBy(*self.order)
        back = W.partitionBy(*self.keys, "_b").orderBy(*[F.col(c).desc() for c in self.order])
        inputs = {f"_v{i}": c for i, (_, _, c) in enumerate(self.specs)}
        rows = self.df.withColumns({"_b": self.bucket, **inputs})

        for i, (kind, _, _) in enumerate(self.specs):
            if kind[0] == "run":
                rows = rows.withColumn(f"_p{i}", F.lag(f"_v{i}").over(local)).withColumn(
                    f"_s{i}", F.when(F.col(f"_v{i}") - F.col(f"_p{i}") >= kind[1], F.col(f"_v{i}")))
        aggs, carry, late, joined = [], [], {}, {}
        steps = W.partitionBy(*self.keys).orderBy("_b")
        before, after = steps.rowsBetween(W.unboundedPreceding, -1), steps.rowsBetween(1, W.unboundedFollowing)
        inner = {}
        for i, (kind, name, _) in enumerate(self.specs):
            v, a, c = F.col(f"_v{i}"), f"_a{i}", f"_c{i}"
            boxed = F.struct(v.alias("v"))
            if kind == "lag":
                aggs.append(F.max_by(boxed, order).alias(a))
                carry.append(F.lag(a).over(steps).alias(c))
                inner[f"_l{i}"] = F.lag(boxed).over(local)
                joined[name] = F.coalesce(F.col(f"_l{i}"), F.col(c))["v"]
            elif kind == "lead":
                aggs.append(F.min_by(boxed, order).alias(a))
                carry.append(F.lead(a).over(steps).alias(c))
                inner[f"_l{i}"] = F.lead(boxed).over(local)
                joined[name] = F.coalesce(F.col(f"_l{i}"), F.col(c))["v"]
            elif kind == "sum":
                aggs.append(F.sum(v).alias(a))
                carry.append(F.sum(a).over(before).alias(c))
                inner[f"_l{i}"] = F.sum(v).over(local.rowsBetween(W.unboundedPreceding, 0))
                zero = F.lit(0)
                joined[name] = F.coalesce(F.col(f"_l{i}"), zero) + F.coalesce(F.col(c), zero)
            elif kind[0] == "run":
                aggs += [F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}"), F.max(f"_s{i}").alias(f"_in{i}")]
                before_it = F.lag(f"_hi{i}").over(steps)
                late[f"_own{i}"] = F.when(before_it.isNull() | (F.col(f"_lo{i}") - before_it >= kind[1]), F.col(f"_lo{i}"))
                carry.append(F.coalesce(F.col(f"_own{i}"), F.last(
                    F.coalesce(F.col(f"_in{i}"), F.col(f"_own{i}")), ignorenulls=True).over(before)).alias(c))
                inner[f"_l{i}"] = F.last(f"_s{i}", ignorenulls=True).over(local.rowsBetween(W.unboundedPreceding, 0))
                joined[name] = F.coalesce(F.col(f"_l{i}"), F.col(c))
            elif kind == "smin":
                aggs.append(F.min(v).alias(a))
                carry.append(F.min(a).over(after).alias(c))
                inner[f"_l{i}"] = F.min(v).over(back.rowsBetween(W.unboundedPreceding, 0))
                joined[name] = F.least(F.col(f"_l{i}"), F.col(c))
            elif kind == "ffill":
                seen = F.when(v.isNotNull(), order)
                aggs.append(F.max_by(v, seen).alias(a))
                carry.append(F.last(a, ignorenulls=True).over(before).alias(c))
                inner[f"_l{i}"] = F.last(v, ignorenulls=True).over(local.rowsBetween(W.unboundedPreceding, 0))
                joined[name] = F.coalesce(F.col(f"_l{i}"), F.col(c))
            else:
                seen = F.when(v.isNotNull(), order)
                aggs.append(F.min_by(v, seen).alias(a))
                carry.append(F.first(a, ignorenulls=True).over(after).alias(c))
                inner[f"_l{i}"] = F.last(v, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0))
                joined[name] = F.coalesce(F.col(f"_l{i}"), F.col(c))

        summary = rows.groupBy(*self.keys, "_b").agg(*aggs).withColumns(late).select(*self.keys, "_b", *carry)
        keep = list(self.df.columns)
        return (rows.withColumns(inner).join(summary, [*self.keys, "_b"], "left")
                .select(*keep, *[c.alias(n) for n, c in joined.items()]))


def bucket_of(col: str | Column, width: float) -> Column:
    return F.floor((F.col(col) if isinstance(col, str) else col) / F.lit(width)).cast("long")


def running_totals(df: DataFrame, order: list[str], **cols: Column) -> DataFrame:
    """Sums over all rows up to and including this one, along an order of the whole table.

    Rows are range-partitioned by the order and written, so that their ranges stay as they are; every range is summed by
    itself, and the totals of the ranges before it (one row per range) are broadcast. Rows of equal order
    share a range; their order among each other is left open.
    """
    ranged = df.repartitionByRange(*order).withColumns({"_range": F.spark_partition_id(), **{f"_t_{n}": c for n, c in cols.items()}})
    ranged = cut_lineage(ranged)
    sums = [F.sum(f"_t_{n}").alias(f"_o_{n}") for n in cols]
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(*sums).select(
        "_range", *[F.coalesce(F.sum(f"_o_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in cols])
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = ranged.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_t_{n}").over(within), F.lit(0)) for n in cols})
    return inner.join(F.broadcast(offsets), "_range").select(
        *df.columns, *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in cols])


def ordinal(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None = None,
            name: str = "ordinal") -> DataFrame:
    """1, 2, ... along ``order`` within each key, or over the whole table when ``keys`` is empty."""
    if not keys:
        return running_totals(df, order, **{name: F.lit(1)})
    return Timeline(df, keys, order, bucket).running_sum(**{name: F.lit(1)}).apply()


def asof_forward(left: DataFrame, clock: DataFrame, keys: list[str], left_time: str, clock_time: str,
                 width: float, name: str = "hit") -> DataFrame:
    """For each left row the first clock row of its key at or after ``left_time``.

    ``name`` becomes ``struct<clock_time, ...other clock columns>``, null when there is none.
    Of clock rows of one time the smallest counts, by the other clock columns in the order given.
    Left rows and clock rows are laid on one time line; no range join takes place.
    """
    extra = [c for c in clock.columns if c not in keys]
    marks = left.select(*keys, F.col(left_time).alias("_t"), F.lit(0).alias("_k"), F.struct("*").alias("_row"))
    ticks = clock.select(*keys, F.col(clock_time).alias("_t"), F.lit(1).alias("_k"),
                         F.struct(clock_time, *[c for c in extra if c != clock_time]).alias("_hit"))
    both = marks.unionByName(ticks, allowMissingColumns=True)
    filled = (Timeline(both, keys, ["_t", "_k", "_hit"], bucket_of("_t", width))
              .bfill(_next=F.col("_hit")).apply())
    return filled.filter("_k = 0").select("_row.*", F.col("_next").alias(name))
