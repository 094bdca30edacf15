"""Rules over very many small buckets."""

import random
import time

from pyspark.sql import functions as F

from trackloom.operators import monitor as mn

from test_bucketed_fold import LOG, kept_by_loop


def test_buckets_that_are_cut_by_batches(spark):
    """Batches of seven rows end inside buckets and between keys."""
    rng = random.Random(5)
    rows = [(s, i, round(rng.uniform(0, 60), 3)) for s in range(9) for i in range(80)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r.slot_id, r.frame_id) for r in mn.throttle(spark.createDataFrame(rows, LOG), 0.5, bucket_s=5.0).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(kept_by_loop(rows, 500_000))


def test_many_small_buckets_take_little_time(spark):
    """Before, every bucket was sliced as a table of its own; 100,000 of them took 76 s on four local cores."""
    rows = spark.range(100_000).select(F.col("id").cast("int").alias("slot_id"), F.col("id").alias("frame_id"), (F.col("id") % 7 * 1.0).alias("ts"))
    mn.throttle(rows.limit(10), 1.0).count()
    begun = time.time()
    assert mn.throttle(rows, 1.0).count() == 100_000
    assert time.time() - begun < 20
