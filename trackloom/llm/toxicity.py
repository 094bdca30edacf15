"""Toxicity: a subsequence string-kernel machine with Nyström landmarks, learned from labelled documents.

Learning: of the labelled rows that may be learned from, the ``sample`` of each label with the smallest hashes. A
document is a bag of words of which at least one must be at fault if it is toxic: each toxic document names its most
telling word (by its excess in toxic documents), these are held against words of clean documents, and in further rounds
the machine itself names the words. Only bounded tables of words and one margin per sampled document reach the driver.

Scoring: the largest margin of a document's words, made a probability by a logistic curve fitted on the sample and
weighted to the true share of toxic rows. Runs of single letters (``i d i o t``) count as one word. Texts are read
whole, without an exchange; each distinct word of a task is scored once.

Null and empty texts have no words and get the lowest score. With no toxic or no clean row to learn from, the score is
the share of toxic rows (0 without rows). Repeated rows get equal scores. Only id and text are read; ``drop_toxic``
keeps the columns of its input. Empty input gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stringkernel as sk
from .registry import query
from .text import documents, stored

SAMPLE = 4000  # labelled rows of each label that are learned from
TELLING, PLAIN, HARD, LANDMARKS, NAMED = 1000, 2000, 1000, 150, 20
LIMIT, LOWEST, STRONG = 0.3, -3.0, 0.9
SLICE = 256
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#%&$-_=+/\\~`"
RUN = 4  # so many single letters in a row are one word


def spelled(ws: list[str]) -> list[str]:
    """Words spelled out in single letters, joined."""
    out, run = [], []
    for w in [*ws, ""]:
        if len(w) == 1 and w.isalnum():
            run.append(w)
            continue
        if len(run) >= RUN:
            out.append("".join(run))
        run = []
    return out


def text_words(text: str | None) -> list[str]:
    ws = (text or "").split()
    return ws + spelled(ws) if sum(len(w) == 1 for w in ws) >= RUN else ws


@dataclass
class Model:
    table: np.ndarray | None
    bias: float
    curve: list[float]  # weights of the traits and an offset

    def probability(self, traits: list[list[float]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.array(traits).reshape(-1, len(self.curve) - 1) @ self.curve[:-1] + self.curve[-1], -30, 30)))


class Margins(dict):
    """Margins of words met so far, up to a bound on entries."""

    def __init__(self, table: np.ndarray, bias: float, most: int = 1 << 17):
        super().__init__()
        self.table, self.bias, self.most = table, bias, most

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(words)
        if new:
            self.update(zip(new, sk.scores(new, self.table, self.bias).tolist()))


def _traits(margin: list[float]) -> list[float]:
    """The three largest margins; the numbers of words on the toxic side, of those beyond the margin (almost), and of all, as logarithms."""
    top = sorted(margin, reverse=True)[:3] if len(margin) < 64 else heapq.nlargest(3, margin)
    top = [max(LOWEST, m) for m in top] + [LOWEST] * (3 - len(top))
    return [*top, math.log1p(sum(m > 0 for m in margin)), math.log1p(sum(m > STRONG for m in margin)), math.log1p(len(margin))]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a task holds the words of few texts."""
    return (b.slice(s, SLICE) for b in batches for s in range(0, b.num_rows, SLICE))


def _traits_of(texts: list[str | None], known: Margins) -> list[list[float]]:
    docs = [text_words(t) for t in texts]
    known.learn(set().union(*docs))
    return [_traits([known[w] for w in d]) for d in docs]


def _margins(table: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Margins(table, bias)
        for batch in _slices(batches):
            out = _traits_of(batch.column(1).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "traits"])
    return run


def margins(docs: DataFrame, model: Model) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_margins(model.table, model.bias), f"doc_id {kind}, traits array<double>")


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        rows = [(d, y, w) for d, t, y in zip(*(c.to_pylist() for c in batch.columns))
                for w in {x.strip(PUNCTUATION) for x in text_words((t or "").lower())} if 3 <= len(w) <= sk.PIECE]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))],
                                         ["d", "y", "w"])


def _word_margins(table: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sk.scores(batch.column(0).to_pylist(), table, bias), pa.float64())], ["w", "m"])
    return run


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), 0.1 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge @ w
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, g)
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = 3) -> Model:
    """A model from documents with a label; ``labels`` (doc_id, toxic) holds only rows that may be learned from."""
    labels = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long"), F.col("toxic").cast("long"))
    share = {r.toxic: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = share.get(1, 0), share.get(0, 0)
    base = n1 / max(1, n0 + n1)
    flat = Model(None, 0.0, [0.0] * 6 + [math.log(max(base, 1e-13) / max(1 - base, 1e-13))])
    if not n0 or not n1:
        return flat
    first = lambda y: labels.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(stored(first(0).union(first(1)), "chosen"))  # 2 * sample rows at most
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id").select("doc_id", "text", "toxic")
    bags = stored(rows.mapInArrow(_bags, "d long, y long, w string").distinct(), "bags")
    p, q = min(n1, sample), min(n0, sample)
    df = bags.groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    excess = (F.col("a") / p - F.col("b") / q) / F.sqrt((F.col("a") + F.col("b")) / (p * q))
    df = df.withColumn("z", excess)
    telling = df.filter("z > 0").orderBy(F.desc("z"), "w").limit(TELLING)
    clean = df.filter("z <= 0 OR a = 0").orderBy(F.desc("b"), "w").limit(PLAIN // 2).union(
        df.filter("a = 0").orderBy(F.xxhash64("w")).limit(PLAIN // 2)).distinct()
    near = Window.partitionBy("d").orderBy(F.desc("z"), "w")
    named = bags.filter("y = 1").join(telling, "w").withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= NAMED)
    named = named.select("d", "w", "z").orderBy("d", F.desc("z"), "w").collect()  # sample * NAMED rows at most
    plain = {r.w for r in clean.collect()}
    if not named or not plain:
        return flat
    words = sorted({r.w for r in named})
    place, rank = {w: i for i, w in enumerate(words)}, np.zeros(len(words))
    own: dict[int, list[int]] = {}
    for r in named:
        own.setdefault(r.d, []).append(place[r.w])
        rank[place[r.w]] = r.z
    for turn in range(rounds):
        count = np.zeros(len(words))
        for ws in own.values():
            top = max(rank[i] for i in ws)
            for i in ws:
                count[i] += rank[i] >= top / 2 if top > 0 else rank[i] == top
        on = np.flatnonzero(count)
        top = on[np.argsort(-count[on], kind="stable")][:LANDMARKS]
        others = sorted(plain - {words[i] for i in on})
        marks = [words[i] for i in top] + [others[i] for i in np.linspace(0, len(others) - 1, min(LANDMARKS, len(others))).astype(int)]
        y = np.concatenate([np.ones(len(on)), -np.ones(len(others))])
        strength = np.sqrt(count[on])
        weight = np.concatenate([strength / strength.sum(), np.full(len(others), 1 / len(others))]) * len(y) / 2
        table, bias = sk.nystroem_table(marks, [*(words[i] for i in on), *others], y, weight)
        rank = sk.scores(words, table, bias)
        if turn < rounds - 1:  # clean words that the machine takes for toxic join the clean side
            hard = df.filter("a = 0 OR z <= 0").select("w").mapInArrow(_word_margins(table, bias), "w string, m double")
            plain |= {r.w for r in hard.orderBy(F.desc("m"), "w").limit(HARD).collect()}
    model = Model(table, bias, [])
    fit = margins(rows.select("doc_id", "text"), model).join(chosen, "doc_id").select("traits", "toxic").collect()  # 2 * sample rows at most
    y = np.array([r.toxic for r in fit], float)
    weight = np.where(y > 0, n1 / max(1, y.sum()), n0 / max(1, (1 - y).sum()))
    model.curve = _logistic(np.array([r.traits for r in fit]), y, weight / weight.sum() * len(y))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    if model.table is None:
        return docs.select("doc_id", F.lit(float(model.probability([[0.0] * 6])[0])).alias("score"))
    linear = sum((F.get("traits", i) * w for i, w in enumerate(model.curve[:-1])), F.lit(model.curve[-1]))
    p = 1 / (1 + F.exp(-linear))
    return margins(docs, model).select("doc_id", p.alias("score"))


def drop_toxic(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs`` scored below ``limit``, with all their columns; rows are judged where they are read.

    With rows of one label only to learn from, all documents have the share of toxic rows as score: they all stay, or all go.
    """
    if model.table is None:
        return docs if model.probability([[0.0] * 6])[0] < limit else docs.limit(0)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Margins(model.table, model.bias)
        for batch in _slices(batches):
            traits = _traits_of(batch.column("text").to_pylist(), known)
            yield batch.filter(pa.array(model.probability(traits) < limit, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def may_learn() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def learn_from(spark, docs: DataFrame, sf_dir: str) -> Model:
    return learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(may_learn()).select("doc_id", "toxic"))


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = score(docs, learn_from(spark, docs, sf_dir))
    return found.select("doc_id", F.coalesce(~may_learn(), F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= LIMIT).cast("int").alias("predicted"))
