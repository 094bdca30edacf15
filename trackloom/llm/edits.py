"""Edit-aware token counts: a tree of pre-token counts per document, patched where edits touch the text.

``trees`` cuts every text into pre-tokens and keeps their lengths and token counts next to it; ``apply_edits`` rebuilds
the sum tree from these, cuts and encodes only around each edit and keeps sums along the tree, so counting an edited
document costs the edits, not the text. Counts are those of ordinary text in a public byte-level vocabulary.

Null and empty texts have no tokens. Edits beyond the end are cut to it and apply one after the other, in the order
given. An edit of an unknown document is ignored; all edits of one document are handled by the task that has it.
Repeated rows get the same edits each. Only id and text are read. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query
from .segments import Counter, Pieces, Tree, edit
from .text import body, documents
from .tokens import Encoder

EDITS = "array<struct<start:long,end:long,put:string>>"


def _counter(path: str | None) -> Counter:
    encoder = Encoder(path)
    return Counter(encoder.bpe, encoder.bpe._pat_str, 1 << 18)


def trees(docs: DataFrame, vocabulary: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_tokens and the packed pre-token lengths and counts (and the columns ``carry``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(_counter(vocabulary))
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                part = batch.slice(s, 200)
                lengths, counts = zip(*pieces.packed([t or "" for t in part.column(1).to_pylist()]))
                total = [int(np.frombuffer(c, "<u4").sum()) for c in counts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total, pa.int64()), pa.array(lengths, pa.binary()), pa.array(counts, pa.binary())],
                                                 [*part.schema.names, "n_tokens", "lengths", "counts"])

    rows = docs.select("doc_id", "text", *carry)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, n_tokens long, lengths binary, counts binary")


def apply_edits(made: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``made``: the columns of ``trees`` and ``edits``. doc_id, the new text, tree and counts, n_tokens before, and the work done."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in (b.slice(s, 200) for b in batches for s in range(0, b.num_rows, 200)):
            out = []
            for text, before, lengths, counts, todo in zip(*(batch.column(c).to_pylist() for c in ("text", "n_tokens", "lengths", "counts", "edits"))):
                text = text or ""
                tree, work = Tree(np.frombuffer(lengths, "<u4"), np.frombuffer(counts, "<u4")), 0
                for e in todo or ():
                    text, n = edit(text, tree, e["start"] or 0, e["end"] or 0, e["put"] or "", counter)
                    work += n
                a, b = tree.arrays()
                out.append((text, before, tree.tokens, work, a.astype("<u4").tobytes(), b.astype("<u4").tobytes()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]],
                                             ["doc_id", "text", "tokens_before", "n_tokens", "chars_read", "lengths", "counts"])

    kind = made.schema["doc_id"].dataType.simpleString()
    rows = made.select("doc_id", "text", "n_tokens", "lengths", "counts", F.col("edits").cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, f"doc_id {kind}, text string, tokens_before long, n_tokens long, chars_read long, lengths binary, counts binary")


def with_edits(made: DataFrame, edits: DataFrame) -> DataFrame:
    """The rows of ``trees`` with the edits (doc_id, seq, start, end, put) of their document in the order of seq."""
    todo = edits.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end", "put"))).alias("_e"))
    todo = todo.select("doc_id", F.transform("_e", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["put"].alias("put"))).alias("edits"))
    return made.join(todo, "doc_id", "left")


def usual_edits() -> Column:
    """Edits taken from the text itself: a deletion at a quarter, an insertion at the half, a replacement near the end."""
    t = body()
    n = F.length(t)
    one = lambda a, b, put: F.struct(F.floor(a).cast("long").alias("start"), F.floor(b).cast("long").alias("end"), put.alias("put"))
    return F.array(one(n / 4, n / 4 + 20, F.lit("")), one(n / 2, n / 2, F.concat(F.lit(" "), F.substring(t, 1, 60))),
                   one(n * 3 / 4, n * 3 / 4 + 7, F.reverse(F.substring(t, 1, 9))))


@query("op1_edited_tokens")
def op1_edited_tokens(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits."""
    made = trees(documents(spark, sf_dir).withColumn("edits", usual_edits()), carry=("edits",))
    return apply_edits(made).select("doc_id", F.col("tokens_before").alias("n_tokens"), F.length("text").cast("long").alias("edited_chars"),
                                    F.col("n_tokens").alias("edited_tokens"), "chars_read", F.sha2("text", 256).alias("edited_sha256"))
