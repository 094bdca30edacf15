"""Secret scan: fixed patterns, and the formats of the credentials they find learned as probabilistic automata.

Training: the credentials that the patterns find are labelled by kind; the ``sample`` values of each kind with the
smallest hashes, and as many ordinary long words, are the only data that reach the driver. Per kind, prefix-tree states
are merged while their frequencies are statistically compatible. Scan: every word-like run of 12 characters or more
outside the pattern spans is scored by every kind's log likelihood, alone and over that of the ordinary words (those of
the sample, with and without digits); above limits learned from the same sample it is a span of the kind ``format``. Runs
that pattern spans touch are cut there: letters and digits that go on without a break from an access key or a hex string
belong to it and are of the kind ``format`` too, what else is left is scored at any length. Credentials are learned
whole; of long ones there are fewer in the sample (``MOST`` characters of a kind, one string at least).

Null and empty texts have no spans. Texts are scanned whole, in the task that reads them, without an exchange. Repeated
rows get equal spans; other columns of the input are not read by ``scan`` and are kept as they are by ``redact``. With no
credential to learn from, only the patterns and what belongs to their finds count. Empty input gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .automata import Automaton
from .registry import query
from .text import documents

KINDS = ("assign", "access", "hex")
FORMAT = "format"
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
NAMES = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of 16 and more are the maximal runs that are long enough
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
UNBROKEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
SAMPLE, MOST, ODD = 400, 1 << 20, 20


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, taken: list[tuple[int, int, str, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Word-like runs that no base span touches; what base spans leave of the others: parts of their credentials, and the rest."""
    free, parts, rest = [], [], []
    for m in CANDIDATE.finditer(text):
        hit = [t for t in taken if t[0] < m.end() and m.start() < t[1]]
        if not hit:
            free.append(m.span())
            continue
        at, ends = m.start(), {t[1] for t in hit if t[2] != "assign"}
        starts = {t[0] for t in hit if t[2] != "assign"}
        for a, b, _, _ in [*hit, (m.end(), m.end(), "", "")]:  # hit is in order of starts
            if a > at:
                x = text[at:a]
                left = len(x) - len(x.lstrip(UNBROKEN)) if at in ends else 0
                right = max(left, len(x.rstrip(UNBROKEN))) if a in starts else len(x)
                parts += [(at + i, at + j) for i, j in ((0, left), (right, len(x))) if i < j]
                rest += [(at + left, at + right)] if left < right else []
            at = max(at, b)
    return free, parts, rest


class Formats:
    """An automaton per kind, one of ordinary words, and the limits learned from the sample.

    A string has a kind's format if its likelihood is not below the first hundredth of the kind's own sample and exceeds
    the likelihood as an ordinary word by more than any ordinary word of the sample does. Words of the sample that a kind
    explains better than the ordinary words do are taken for credentials, unless they are more than one in ``ODD``.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.kinds = {k: Automaton(sorted(v)) for k, v in sorted(samples.items()) if k in KINDS and len(v) >= 10}
        self.least = {}
        for k, a in self.kinds.items():
            own = sorted(a.log_likelihood(x) for x in samples[k])
            self.least[k] = own[len(own) // 100]
        words, self.margin = sorted(samples.get("plain", [])), dict.fromkeys(self.kinds, 0.0)
        self.plain = Automaton(words)
        odd = {x for x in words if self.fits(x)}
        if odd and ODD * len(odd) <= len(words):
            words = [x for x in words if x not in odd]
            self.plain = Automaton(words)
        for k, a in self.kinds.items():
            self.margin[k] = max([0.0, *(a.log_likelihood(x) - self.plain.log_likelihood(x) for x in words)])

    def fits(self, x: str) -> bool:
        plain = self.plain.log_likelihood(x)
        scores = ((k, a.log_likelihood(x)) for k, a in self.kinds.items())
        return any(s >= self.least[k] and s - plain > self.margin[k] for k, s in scores)

    def found(self, text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
        free, parts, rest = candidates(text, taken)
        return [(a, b, FORMAT) for a, b in sorted(parts + [s for s in free + rest if self.fits(text[slice(*s)])])]


def _samples(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[int, str]] = {k: {} for k in (*KINDS, "plain")}

        def cut(kind: str) -> None:
            best[kind] = dict(sorted(best[kind].items())[:size])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                for kind, x in [*((k, x) for _, _, k, x in spans), *(("plain", text[a:b]) for a, b in candidates(text, spans)[0])]:
                    best[kind][xxhash.xxh3_64_intdigest(x) >> 1] = x
                for kind in best:
                    if len(best[kind]) > 8 * size:
                        cut(kind)
        for kind in best:
            cut(kind)
        rows = [(k, h, x) for k, v in best.items() for h, x in v.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))],
                                         ["kind", "h", "x"])
    return run


def learn(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """Formats from the ``sample`` credentials of each kind (and ordinary words) with the smallest hashes."""
    rows = docs.select("text").mapInArrow(_samples(sample), "kind string, h long, x string").distinct()
    order = Window.partitionBy("kind").orderBy("h")
    rows = rows.withColumns({"_n": F.row_number().over(order), "_c": F.sum(F.length("x")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    samples: dict[str, list[str]] = {}
    for r in rows.filter((F.col("_n") <= sample) & ((F.col("_c") <= MOST) | (F.col("_n") == 1))).collect():  # 4 * sample rows at most
        samples.setdefault(r.kind, []).append(r.x)
    return Formats(samples)


def _scanned(text: str, formats: Formats) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted([s[:3] for s in base] + formats.found(text, base), key=lambda s: (s[0], (*KINDS, FORMAT).index(s[2])))


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """doc_id, ``base`` and ``spans``: arrays of (start, end, kind) in code points, the end exclusive."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_scanned(t or "", formats) for t in batch.column(1).to_pylist()]
            cols = [pa.array([[dict(zip(("start", "end", "kind"), s)) for s in g[i]] for g in got], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<start:long,end:long,kind:string>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {spans}, spans {spans}")


def redact(docs: DataFrame, formats: Formats, put: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced; ``n_chars`` follows the text. Texts without a span stay as they are."""
    @F.udf("string")
    def clean(text):
        if text is None:
            return None
        spans = _scanned(text, formats)[1]
        if not spans:
            return text
        out, at = [], 0
        for start, end, _ in spans:
            if start >= at:
                out += [text[at:start], put]
            elif end > at and not out:
                out.append(put)
            at = max(at, end)
        return "".join([*out, text[at:]])

    columns = docs.columns
    made = docs.withColumn("text", clean.asNondeterministic()("text"))
    if "n_chars" in columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*columns)


def _joined(name: str):
    return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op3_secret_scan")
def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = scan(docs, learn(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined("base"), 256).alias("base_sha256"),
                        _joined("spans").alias("spans"))
