"""Document fingerprints: bottom-k sketches of shingle hashes.

The fingerprint of a text is the k smallest distinct 64-bit hashes of its 5-word shingles (a shorter text is one shingle;
a text without words has an empty fingerprint). Sketches of parts merge into the sketch of the whole, and two sketches
estimate resemblance, containment and the number of distinct shingles. Columns and windows only.

Null text: as empty. Two empty fingerprints are alike (1.0), an empty one and another are not (0.0). Repeated rows get
equal fingerprints. Rows without an id come last in the order of ``neighbours``. Only the id and the text are read, so
other columns of the input cannot clash. Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import query
from .text import body, documents, words

K = 128
WIDTH = 5
ROWS_PER_BUCKET = 1000
SUPER = 4096


def shingles(h: str, width: int = WIDTH) -> Column:
    """Hashes of the runs of ``width`` entries of the word-hash column ``h``; a shorter array is one shingle."""
    a = F.col(h)
    run = F.transform(a, lambda x, i: F.xxhash64(x, *[F.get(a, i + j) for j in range(1, width)]))
    return (F.when(F.size(a) >= width, F.slice(run, F.lit(1), F.size(a) - (width - 1)))
            .when(F.size(a) > 0, F.array(F.xxhash64(a))).otherwise(F.array().cast("array<bigint>")))


def with_sketch(df: DataFrame, text: Column, name: str, k: int = K) -> DataFrame:
    """``df`` with the bottom-k sketch of ``text`` as a sorted array column."""
    h = f"{name}_h"
    return (df.withColumn(h, F.transform(words(text), lambda w: F.xxhash64(w)))
            .withColumn(name, F.slice(F.sort_array(F.array_distinct(shingles(h))), 1, k)).drop(h))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the k smallest of both sketches that lies in both."""
    low = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.when(F.size(low) == 0, 1.0).otherwise(
        F.size(F.array_intersect(low, F.array_intersect(a, b))) / F.size(low))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    span = (F.element_at(a, k).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too."""
    union = distinct_shingles(F.slice(F.sort_array(F.array_union(a, b)), 1, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(resemblance(a, b, k) * union / distinct_shingles(a, k), F.lit(1.0)))


def merge(sketches: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts; each task hands on no more than k hashes of a key."""
    low = sketches.select(*keys, F.explode(sketch).alias("_x")).withColumn(
        "_r", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_x"))).filter(F.col("_r") <= k)
    return low.groupBy(*keys).agg(F.sort_array(F.collect_set("_x")).alias(sketch))


def fingerprint(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.hex(x)), ",")


def neighbours(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, text, its sketch, and the text and sketch of the next document in descending id order (after the last: the first).

    Ids are cut into ranges of about ``rows_per_bucket`` rows; texts move once, to their range. The window runs inside a
    range, and the last row of a range takes the first of the next non-empty one. Ranges are linked on ids only.
    """
    rows = docs.select("doc_id", body().alias("t"))
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    step = 1 if low is None else max(1, (high - low + 1) * rows_per_bucket // max(n, 1))
    bucket = F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / step), F.lit(-1)).cast("long")
    rows = rows.withColumn("_b", bucket)

    links = rows.select("_b").distinct().withColumn("_s", F.floor(F.col("_b") / SUPER))
    below = F.lag("_b").over(Window.partitionBy("_s").orderBy("_b"))
    tops = links.groupBy("_s").agg(F.max("_b").alias("_top"))
    last_top = F.coalesce(F.lag("_top").over(Window.orderBy("_s")), F.max("_top").over(Window.partitionBy()))
    links = links.withColumn("_below", below).join(tops.select("_s", last_top.alias("_before")), "_s")
    links = links.select("_b", F.coalesce("_below", "_before").alias("_next"))

    dealt = rows.repartition("_b").withColumn("_tie", F.xxhash64("t"))
    order = Window.partitionBy("_b").orderBy(F.col("doc_id").desc_nulls_last(), F.col("_tie").desc())
    heads = dealt.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(F.col("_b").alias("_next"), F.col("t").alias("_head"))
    heads = heads.join(links, "_next").select("_b", "_head")
    heads = with_sketch(heads, F.col("_head"), "_head_sketch")
    own = with_sketch(dealt, F.col("t"), "sketch")
    following = own.withColumn("_following", F.lead(F.struct("t", "sketch")).over(order))
    return following.join(heads, "_b").select(
        "doc_id", "t", "sketch", F.coalesce(F.col("_following.t"), F.col("_head")).alias("next_t"),
        F.coalesce(F.col("_following.sketch"), F.col("_head_sketch")).alias("next_sketch"))


@query("op8_fingerprints")
def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    rows = neighbours(documents(spark, sf_dir)).withColumn("n_chars", F.length("t").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr(F.col("t"), F.lit(1), F.col("n_chars").cast("int") - third),
                      F.substr(F.col("next_t"), F.lit(1), third))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", edited.alias("e"))
    rows = with_sketch(rows, F.col("e"), "edited_sketch")
    own, other, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select("doc_id", "n_chars", F.sha2("e", 256).alias("edited_sha256"),
                       fingerprint(own).alias("fingerprint"), fingerprint(other).alias("edited_fingerprint"),
                       resemblance(own, other).alias("near_edited"), resemblance(own, following).alias("near_next"),
                       distinct_shingles(own).alias("n_shingles"), containment(other, own).alias("edited_contained"))
