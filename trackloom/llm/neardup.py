"""Near-duplicate groups: fast similarity sketches, banding, exact verification.

1. A document's set of 5-word shingles (lower-cased A-Z) gives its size, a 128-bit identity, and band keys of its sketch.
2. Documents of equal sets are one class, named by the smallest id; only classes go on.
3. Classes that share a band key are a bucket. A bucket's smallest member is held against the others; pairs are verified on
   the full sets of both texts and verified links join components. This connects groups of copies.
4. Buckets that still hold several components are compared in blocks: the members outside the bucket's largest component
   among themselves and with that component's members. Longer sketches of the same kind, one byte a coordinate, are held
   against each other inside a task; only pairs of different components whose sketches agree in at least ``NEAR`` of ``LONG``
   coordinates leave it (a linked pair falls short with probability 1e-5) and are verified on their full sets. No cap, and no
   list of all pairs of a group of copies.
5. Labels of classes go back to their documents.

Null and empty texts have no shingles and are linked with nothing. Rows without an id take their class's component, or
none, and are kept in the latter case. Rows that share an id are one vertex, and ``groups`` marks them alike;
``deduplicate`` keeps one of those with equal sets, and all columns of the input. Only id and text are compared. Empty
input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trackloom.operators.materialize import cut_lineage

from .graph import components
from .registry import query
from .sketching import bands, fast_sketch
from .text import WordHashes, documents, scramble, shingle_hashes

WIDTH = 5
BANDS, ROWS = 24, 4  # a pair at 0.75 shares no band with probability 1e-4
LINK, OF = 75, 100
LONG, NEAR = 512, 343  # 4.2 standard deviations below 0.75
BLOCK, SLOT_ROWS = 512, 8192


def shingle_set(text: str | None, known: WordHashes) -> np.ndarray:
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(shingle_hashes(known.of(ws), min(WIDTH, len(ws)))) if ws else np.empty(0, np.uint64)


def identity(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's identity (h1, h2) and its band keys (none without shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(1 << 18)
        for batch in batches:
            n, h1, h2, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, known)
                n.append(len(s))
                for h, x in zip((h1, h2), identity(s)):
                    h.append(x)
                keys.append(bands(fast_sketch(s, BANDS * ROWS), ROWS) if len(s) else np.empty(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists],
                ["doc_id", "n_shingles", "h1", "h2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


class _Sets(dict):
    """Shingle sets by document, remembered up to a bound on their elements: a document stands in many pairs."""

    def __init__(self, most: int = 1 << 22):
        super().__init__()
        self.known, self.most, self.held = WordHashes(1 << 18), most, 0

    def of(self, doc: int, text: str) -> np.ndarray:
        s = self.get(doc)
        if s is None:
            s = shingle_set(text, self.known)
            if self.held + len(s) > self.most:
                self.clear()
                self.held = 0
            self[doc] = s
            self.held += len(s)
        return s


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of rows (a, b, text of a, text of b) whose full sets are similar enough."""
    sets = _Sets()
    for batch in (b.slice(s, 500) for b in batches for s in range(0, b.num_rows, 500)):
        keep = []
        for a, b, at, bt in zip(*(c.to_pylist() for c in batch.columns)):
            left, right = sets.of(a, at), sets.of(b, bt)
            both = len(np.intersect1d(left, right, assume_unique=True))
            keep.append(OF * both >= LINK * (len(left) + len(right) - both))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("_ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("_tb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "_ta", "_tb")
    return rows.mapInArrow(_linked, "a long, b long")


def _in_size(n: str, m: str):
    """Sets of these sizes can reach the similarity at all."""
    return OF * F.least(n, m) >= LINK * F.greatest(n, m)


def _long_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The band keys of each text, then a byte of each of ``LONG`` coordinates."""
    known = WordHashes(1 << 18)
    for batch in (b.slice(s, 500) for b in batches for s in range(0, b.num_rows, 500)):
        sets = [shingle_set(t, known) for t in batch.column(1).to_pylist()]
        made = [bands(fast_sketch(s, BANDS * ROWS), ROWS).tobytes() + scramble(fast_sketch(s, LONG)).astype(np.uint8).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "sketch"])


def _near(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components whose long sketches agree often enough, of all groups (key, i, j) of a slot.

    A pair that shares several bands is looked at in the first of them only.
    """
    table = pa.Table.from_batches(list(batches))
    name = table.schema.names
    cols = {c: table.column(c).to_numpy() for c in name if c != "sketch"}
    raw = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, 8 * BANDS + LONG)
    order = np.lexsort((cols["side"], cols["j"], cols["i"], cols["key"]))
    cols, sketch, band = {c: v[order] for c, v in cols.items()}, raw[order, 8 * BANDS:], np.ascontiguousarray(raw[order, :8 * BANDS]).view("<i8")
    new = np.zeros(len(order), bool)
    for c in ("key", "i", "j"):
        new[1:] |= np.diff(cols[c]) != 0
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for part in np.split(np.arange(len(order)), np.flatnonzero(new)):
        left = part[cols["side"][part] == 0]
        for at, x in enumerate(left):
            right = left[at + 1:] if cols["i"][x] == cols["j"][x] else part[len(left):]
            n, m = cols["n"][x], cols["n"][right]
            right = right[(cols["comp"][right] != cols["comp"][x]) & (OF * np.minimum(n, m) >= LINK * np.maximum(n, m))]
            right = right[band[x][(band[right] == band[x]).argmax(1)] == cols["key"][x]]
            right = right[(sketch[right] == sketch[x]).sum(1) >= NEAR]
            a.append(np.minimum(cols["id"][right], cols["id"][x]))
            b.append(np.maximum(cols["id"][right], cols["id"][x]))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, id, n, comp) of buckets of several components, with the largest one (main), its size and that of the rest."""
    known = members.join(labels.withColumnRenamed("v", "id"), "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp"))
    parts = known.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = parts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("_m"), F.sum("c").alias("_c")).filter("_c > _m.c")
    return known.join(main.select("key", F.col("_m.comp").alias("main"), F.col("_m.c").alias("most"), (F.col("_c") - F.col("_m.c")).alias("rest")), "key")


def _blocked(rows: DataFrame) -> DataFrame:
    """The groups (key, i, j) in which a member is compared: i < 0 is a block of the main component, all others are blocks of the rest."""
    most, rest = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("most", "rest"))
    own = F.when(F.col("comp") == F.col("main"), F.pmod(F.xxhash64("id"), most)).otherwise(F.pmod(F.xxhash64("id"), rest)).cast("int")
    group = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    among = F.transform(F.sequence(F.lit(0), rest - 1), lambda o: group(F.least(own, o), F.greatest(own, o), own > o))
    of_main = F.transform(F.sequence(F.lit(0), rest - 1), lambda o: group(-own - 1, o, F.lit(0)))
    with_main = F.transform(F.sequence(F.lit(0), most - 1), lambda o: group(-o - 1, own, F.lit(1)))
    groups = F.when(F.col("comp") == F.col("main"), of_main).otherwise(F.concat(with_main, among))
    return rows.select("key", "id", "n", "comp", "sketch", F.explode(groups).alias("_g")).select("key", "id", "n", "comp", "sketch", "_g.*")


def near_pairs(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``open_buckets`` rows that are worth a look at their full sets."""
    sketches = texts.join(rows.select("id").distinct(), "id", "left_semi").select("id", "text").mapInArrow(_long_sketches, "id long, sketch binary")
    most, rest = F.ceil(F.col("most") / BLOCK), F.ceil(F.col("rest") / BLOCK)
    copies = F.when(F.col("comp") == F.col("main"), rest).otherwise(most + rest)
    slots = 1 + int((rows.agg(F.sum(copies)).first()[0] or 0) // SLOT_ROWS)
    grouped = _blocked(rows.join(sketches, "id")).withColumn("slot", F.pmod(F.xxhash64("key", "i", "j"), F.lit(slots)))
    return grouped.groupBy("slot").applyInArrow(_near, "a long, b long")


def class_components(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, comp) of the classes that are linked with another; ``classes``: id, n, bands."""
    keys = classes.select("id", "n", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("id", "n")).alias("_l")).filter("_c > 1")
    members = cut_lineage(keys.join(buckets, "key").select("key", "id", "n", F.col("_l.id").alias("lead"), F.col("_l.n").alias("lead_n")))
    wanted = members.select("id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi")
    texts = cut_lineage(texts.dropDuplicates(["id"]))

    pairs = members.filter((F.col("id") != F.col("lead")) & _in_size("n", "lead_n")).select(F.col("lead").alias("a"), F.col("id").alias("b"))
    links = cut_lineage(_verified(pairs.distinct(), texts))
    labels = components(links)
    rows = cut_lineage(open_buckets(members.select("key", "id", "n"), labels))
    if not rows.isEmpty():
        more = cut_lineage(_verified(near_pairs(rows, texts), texts))
        if not more.isEmpty():
            labels = components(links.union(more))
    return labels.withColumnRenamed("v", "id")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, h1, h2, component_id, kept for every row."""
    signed = cut_lineage(signatures(docs))
    some = signed.filter("n_shingles > 0")
    classes = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = cut_lineage(classes)
    labels = class_components(classes.filter("id IS NOT NULL").select("id", "n", "bands"), docs)
    named = classes.select("h1", "h2", "id").join(labels, "id", "left").select("h1", "h2", F.coalesce("comp", "id").alias("_comp"))
    rows = signed.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("_comp", "doc_id")
    return rows.select("doc_id", "n_shingles", "h1", "h2", component.alias("component_id"),
                       F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    return _grouped(docs).drop("h1", "h2")


def _identified(docs: DataFrame) -> DataFrame:
    """``docs`` with the identity of each row's set (_h1, _h2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(1 << 18)
        for batch in batches:
            found = [identity(shingle_set(t, known)) for t in batch.column("text").to_pylist()]
            own = [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "_h1", "_h2"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_h1", LongType()), StructField("_h2", LongType())]))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest id, and one row of it where rows of that id have equal sets.

    Rows without an id stay unless their set has a group. Rows that share an id but not a set are no copies: they stay.
    """
    kept = _grouped(docs).filter("kept")
    ids = cut_lineage(kept.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_kept_id")).agg(F.count(F.lit(1)).alias("_n")))
    key = F.col("doc_id").cast("long")
    out = docs.join(ids.filter("_n = 1"), key == F.col("_kept_id"), "left_semi")
    often = ids.filter("_n > 1")
    if not often.isEmpty():
        rows = _identified(docs.join(often, key == F.col("_kept_id"), "left_semi"))
        out = out.unionByName(rows.dropDuplicates(["doc_id", "_h1", "_h2"]).select(*docs.columns))
    free = kept.filter("doc_id IS NULL").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
    bare = _identified(docs.filter(key.isNull())).join(free, ["_h1", "_h2"], "left_semi")
    return out.unionByName(bare.select(*docs.columns))


@query("op10_near_duplicates")
def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir))
