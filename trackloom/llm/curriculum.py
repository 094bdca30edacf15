"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1 (a broken line). The source's share of all words is divided
over time as the schedule says: its demand up to time t is ``target * integral(0..t) / integral(0..1)``. A document
starts where the words of its source before it end, counted over repeated passes; inverting the demand turns this word
offset into a training position, and documents are sorted by position over a range partitioning.

Only columns and windows. Offsets inside a source are prefix sums in two levels: a source is cut into hash buckets of
about ``rows_per_bucket`` rows (a hot source has more buckets), sums per bucket give the bucket's start, a window inside
the bucket the rest. The one un-partitioned window runs over one row per source.

Null text: size 0, nothing taken. A null source is a source of its own, the last. Repeated rows are separate
documents; equal ids are ordered by size. Columns of the input are carried in one struct, so names cannot clash. Empty
input gives an empty plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.materialize import cut_lineage

from .registry import query
from .text import WORD, body, documents

BUCKET_BITS = 16


@dataclass(frozen=True)
class Schedule:
    """A source's weight in the mix and the shape of its demand: (time, density) knots from time 0 to 1."""
    weight: int
    knots: tuple[tuple[float, float], ...] = ((0.0, 1.0), (1.0, 1.0))

    def position(self, share: Column) -> Column:
        """The time at which ``share`` (0..1) of the source's words has been asked for."""
        area, segments = 0.0, []
        for (t0, a), (t1, b) in zip(self.knots, self.knots[1:]):
            segments.append((area, t0, t1 - t0, a, b))
            area += (a + b) / 2 * (t1 - t0)
        y, out = share * area, None
        for start, t0, dt, a, b in segments:
            rest = F.greatest(y - start, F.lit(0.0))
            u = 2 * rest / (a + F.sqrt(F.greatest(F.lit(a * a) + 2 * (b - a) / dt * rest, F.lit(0.0))))
            here = F.least(t0 + F.when(rest > 0, u).otherwise(0.0), F.lit(1.0))
            out = here if out is None else F.when(y >= start, here).otherwise(out)
        return out


# Production parameters: the weights go round over the sources in code-point order; the heaviest class stays level, the
# second grows, the third fades.
SCHEDULES = (Schedule(5), Schedule(2, ((0.0, 0.5), (1.0, 1.5))), Schedule(1, ((0.0, 1.5), (0.6, 1.0), (1.0, 0.25))))
MOST_PASSES = 3
ROWS_PER_BUCKET = 256
MOST_BROADCAST = 50_000  # sources whose targets go to every task; more are joined by a shuffle


def targets(sizes: DataFrame, schedules: tuple[Schedule, ...] = SCHEDULES, most: int = MOST_PASSES) -> DataFrame:
    """Per source its class, size, row count and target words; ``sizes`` has one row per source.

    A target stops at ``most`` times the source's size and the excess goes to the others by weight: with sources sorted
    by cap / weight, the level is the first (words left) / (weight left) that the source at hand can carry.
    """
    weight = F.element_at(F.array(*[F.lit(s.weight) for s in schedules]), F.col("_class") + 1)
    ranked = sizes.withColumn("_class", (F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1) % len(schedules))
    ranked = ranked.withColumn("_weight", weight).withColumn("_cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = ranked.withColumn("_left", F.sum("source_size").over(everything)
                               - F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_cap"))
    ranked = ranked.withColumn("_level", F.col("_left").cast("double") / F.sum("_weight").over(
        by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    holds = F.col("_level") <= F.col("_cap") / F.col("_weight")
    level = F.min(F.when(holds, F.struct(F.col("_cap") / F.col("_weight"), F.col("_level").alias("_level")))).over(everything)
    return ranked.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_weight") * level["_level"])).select(
        "_key", "_class", "source_size", "_rows", "target")


def _key(source: str) -> Column:
    """The source as a join key without nulls."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def plan(docs: DataFrame, schedules: tuple[Schedule, ...] = SCHEDULES, most: int = MOST_PASSES,
         rows_per_bucket: int = ROWS_PER_BUCKET, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the document) with its size, source_size, target, and ``passes``: an array of (position, words).

    ``carry`` names the columns that ``row`` takes along; all of them if not given.
    """
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.col("source").alias("_source"), _key("source").alias("_key"),
                       F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order"),
                       F.col("doc_id").alias("_id"), F.regexp_count(body(), F.lit(WORD)).cast("long").alias("size"))
    sizes = rows.groupBy("_key", "_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sizes = cut_lineage(sizes)
    known = targets(sizes, schedules, most)
    if sizes.count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    bits = F.least(F.ceil(F.log2(F.greatest(F.col("_rows") / rows_per_bucket, F.lit(1.0)))), F.lit(BUCKET_BITS)).cast("int")
    high = F.conv(F.substring("_order", 1, BUCKET_BITS // 4), 16, 10).cast("long")
    rows = rows.join(known, "_key").withColumn("_bucket", F.floor(high / F.pow(F.lit(2.0), BUCKET_BITS - bits)))
    # one column for both, so that rows are never dealt out by the source alone
    rows = rows.withColumn("_place", F.concat_ws(":", "_bucket", "_key"))
    starts = rows.groupBy("_place", "_key", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_place", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_place").orderBy("_order", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, "_place")
    goal = F.floor("target")

    def one(e: int) -> Column:
        at = e * F.col("source_size") + F.col("_start") + F.col("_inside")
        words = F.greatest(F.least(goal - at, F.col("size")), F.lit(0))
        share = at / F.col("target")
        position = schedules[-1].position(share)
        for i, s in enumerate(schedules[:-1]):
            position = F.when(F.col("_class") == i, s.position(share)).otherwise(position)
        return F.when(words > 0, F.struct(position.alias("position"), words.alias("words")))

    passes = F.filter(F.array(*[one(e) for e in range(most)]), lambda p: p.isNotNull())
    return rows.select("row", "size", "source_size", "target", passes.alias("passes"),
                       (F.col("_inside") + F.col("_start")).alias("offset"), "_order")


def taken() -> Column:
    return F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])


def by_position(planned: DataFrame) -> DataFrame:
    """Documents sorted by the position of their first pass; those not taken follow, spread by hash."""
    first = F.coalesce(F.get("passes", 0)["position"],
                       1 + F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / float(1 << 32))
    sort = planned.withColumn("_at", first)
    return sort.repartitionByRange("_at", "_order").sortWithinPartitions("_at", "_order").drop("_at")


def mix(docs: DataFrame, schedules: tuple[Schedule, ...] = SCHEDULES, most: int = MOST_PASSES) -> DataFrame:
    """The training sequence: one row per pass of a document, sorted by position, with the columns of ``docs``.

    A pass that the target ends inside a document holds the words up to there, joined by one space (n_chars follows).
    """
    rows = plan(docs, schedules, most).select("row", "size", "_order", F.explode("passes").alias("p"))
    rows = rows.repartitionByRange(F.col("p.position"), "_order").sortWithinPartitions("p.position", "_order")
    whole = F.col("p.words") == F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.coalesce("row.text", F.lit("")), F.lit(f"({WORD})"), F.lit(1)),
                               F.lit(1), F.col("p.words").cast("int")), " ")
    text = F.when(whole, F.col("row.text")).otherwise(cut)
    put = {"text": text, "n_chars": F.when(whole, F.col("row.n_chars")).otherwise(F.length(cut)).cast(
        docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return rows.select(*[put.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


_CLASS_WEIGHTS = ", ".join(str(s.weight) for s in SCHEDULES)
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS k, md5(doc_id::VARCHAR) AS o,
                  len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
r AS (SELECT k, source, source_size, {MOST_PASSES} * source_size AS cap,
             [{_CLASS_WEIGHTS}][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(SCHEDULES)}] AS w FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM r),
t AS (SELECT k, source_size, least(cap::DOUBLE, w * (SELECT arg_min(lv, cap / w) FROM l WHERE lv <= cap / w)) AS target FROM l),
p AS (SELECT doc_id, size, source_size, target,
             coalesce(sum(size) OVER (PARTITION BY k ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM d JOIN t USING (k))
SELECT doc_id, size, source_size, target,
       (greatest(least(floor(target) - pos, size), 0) + greatest(least(floor(target) - pos - source_size, size), 0)
        + greatest(least(floor(target) - pos - 2 * source_size, size), 0))::BIGINT AS taken
FROM p
"""


@query("op4_source_mix", ORACLE_SQL)
def op4_source_mix(spark, sf_dir: str) -> DataFrame:
    return by_position(plan(documents(spark, sf_dir), carry=["doc_id"])).select(
        "row.doc_id", "size", "source_size", "target", taken().alias("taken"))
