"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds to their finds.

Training: spans that the patterns find are the labels. Of windows with a span of each kind, and of windows without one, the
``sample`` with the smallest hashes reach the driver, where the network is trained in numpy. Some copies of the labelled
spans are written as patterns do not know them (other separators, ``[at]``, ``[.]``, no plus sign).

Scan: a span is added only if it holds a digit, an at sign or the word ``at`` (``can_be``). Regions are all places within
``REACH`` characters of one of these; a region with a span at one of its ends is widened there until no span meets an end,
so no span is cut, and what is left out can hold none that would be added. A region is cut into overlapping windows; each
is decoded to tag probabilities over
all of its tag sequences. Probabilities of a place are averaged over its windows, places near a window's middle weighing
more, and one best path through the whole region settles the spans, so a span that a window cuts is found once and whole.
A span that no base span touches is added if its mean probability is at least ``SURE`` and it can be what it is taken for
(digits and check sum of a card, parts of an address, digits of a phone number). Base spans always stay.

Null and empty texts have no spans. Texts are scanned whole, in the task that reads them, without an exchange. Repeated
rows get equal spans; ids may be null or repeat. ``scan`` reads id and text only, ``mask`` keeps all columns. Without a
base span to learn from only the patterns count. Empty input gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm import Tagger, best_path
from .registry import query
from .text import documents, stored

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]++(?:\.([0-9]++)\.([0-9]++)\.([0-9]++))?")  # a run of digits that starts no address is passed over at once
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TRIGGER = re.compile(r"[0-9@]|\bat\b")
REACH, WIDTH, STRIDE = 24, 64, 32
SAMPLE, STEPS, SURE = 400, 300, 0.9
SLICE = 256
OTHER = 127  # of the symbols: beyond ASCII, not a letter; 128: a letter beyond ASCII; 0: nothing
TAGS = 1 + 2 * len(KINDS)  # none; the first place and the further places of each kind
ALLOWED = np.array([[t == 0 or t % 2 == 1 or s in (t, t - 1) for t in range(TAGS)] for s in range(TAGS)])
START = np.array([t == 0 or t % 2 == 1 for t in range(TAGS)])


def passes_check_sum(digits: str) -> bool:
    """Doubling every second digit from the right but one, the digit sum is a multiple of ten."""
    doubled = (2 * int(c) for c in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def _part(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) < 3 or (len(x) == 3 and x <= "255")


def _digits(x: str) -> str:
    return "".join(DIGIT.findall(x))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of a local part, an at sign and a domain; an at sign is looked at once."""
    low = 0
    at = text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out = [(a, b, "email") for a, b in _emails(text)]
    if DIGIT.search(text):
        out += [(*m.span(), "ip") for m in NUMBERS.finditer(text) if m[1] and all(map(_part, m[0].split(".")))]
        for kind, pattern, least, most in (("card", CARD, 12, 19), ("phone", PHONE, 9, 15)):
            for m in pattern.finditer(text):
                d = _digits(m[0])
                if least <= len(d) <= most and (kind == "phone" or passes_check_sum(d)):
                    out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def can_be(kind: str, x: str) -> bool:
    """Whether a found string can be of its kind at all."""
    d = _digits(x)
    if kind == "card":
        return 12 <= len(d) <= 19 and passes_check_sum(d)
    if kind == "ip":
        parts = re.findall("[0-9]+", x)
        return len(parts) == 4 and all(map(_part, parts))
    if kind == "phone":
        return 7 <= len(d) <= 15
    return bool(re.search(r"[A-Za-z0-9].*(@|\bat\b).*[A-Za-z0-9].*(\.|\bdot\b).*[A-Za-z]", x))


def regions(text: str) -> list[tuple[int, int]]:
    """All that lies within reach of a digit, an at sign or the word ``at``, as runs."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _starts(a: int, b: int) -> list[int]:
    """Starts of the windows of a region; the last one ends with it."""
    if b - a <= WIDTH:
        return [a]
    return [*range(a, b - WIDTH, STRIDE), b - WIDTH]


def symbols(text: str) -> np.ndarray:
    """``WIDTH`` symbols of a text of that length or less."""
    out = np.zeros(WIDTH, np.int64)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letters = np.fromiter((c.isalpha() for c in text), bool, len(text))
    out[:len(raw)] = np.where(raw < OTHER, np.maximum(raw, 1), OTHER + letters)
    return out


def tags_of(length: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    """Tags of a text; where spans of several kinds meet, the kind listed first counts."""
    out = np.zeros(length, np.int64)
    for a, b, kind in sorted(spans, key=lambda s: -KINDS.index(s[2])):
        k = 1 + 2 * KINDS.index(kind)
        out[a:b] = k + 1
        out[a] = k
    return out


def disguised(x: str, kind: str, r: random.Random) -> str:
    """A labelled string as patterns do not know it."""
    if kind == "email":
        name, _, host = x.partition("@")
        at, dot = r.choice([("[at]", "."), ("(at)", "."), (" at ", " dot "), (" @ ", "."), ("@", "[.]")])
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return x.replace(".", r.choice(["[.]", " . ", "(.)", ","]))
    d = _digits(x)
    if kind == "card":
        return r.choice([".", "/", "  ", "_"]).join(d[i:i + 4] for i in range(0, len(d), 4))
    tail = r.choice(["-", ".", " "])
    return r.choice(["", "(", "00"]) + r.choice([x.lstrip("+"), x.replace("+", "").replace("(", "").replace(")", "")]) if r.random() < 0.5 else \
        f"({d[-10:-7]}) {d[-7:-4]}{tail}{d[-4:]}" if r.random() < 0.5 else f"{d[-10:-7]}{tail}{d[-7:-4]}{tail}{d[-4:]}"


def _labelled(text: str) -> Iterator[tuple[str, str, str]]:
    """(class, window, tags as digits) of the windows of a text; the class is the kind of the first span in it."""
    spans = base_spans(text)
    tags = None
    for a, b in regions(text):
        for s in _starts(a, b):
            if tags is None:
                tags = tags_of(len(text), spans)
            own = tags[s:min(b, s + WIDTH)]
            hit = own[own > 0]
            yield KINDS[(hit[0] - 1) // 2] if len(hit) else "none", text[s:min(b, s + WIDTH)], "".join(map(str, own))


def _sample(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[int, tuple[str, str]]] = {k: {} for k in (*KINDS, "none")}
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE):
                for text in batch.column(0).slice(s, SLICE).to_pylist():
                    for kind, x, tags in _labelled(text or ""):
                        best[kind][xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1] = x, tags
                    for kind, found in best.items():
                        if len(found) > 4 * size:
                            best[kind] = dict(sorted(found.items())[:size])
        rows = [(k, h, *v) for k, found in best.items() for h, v in sorted(found.items())[:size]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))],
                                         ["kind", "h", "x", "tags"])
    return run


def learn(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Tagger | None:
    """A tagger from the ``sample`` windows of each kind, and without a span, with the smallest hashes; None without a span."""
    rows = stored(docs.select("text").mapInArrow(_sample(sample), "kind string, h long, x string, tags string").distinct(), "windows")
    rows = [r for kind in (*KINDS, "none") for r in rows.filter(F.col("kind") == kind).orderBy("h").limit(sample).collect()]
    if all(r.kind == "none" for r in rows):
        return None
    r = random.Random(7)
    x, y = [], []
    for row in rows:
        tags = np.array(list(map(int, row.tags)))
        x.append(symbols(row.x))
        y.append(np.pad(tags, (0, WIDTH - len(tags))))
        firsts = np.flatnonzero(tags % 2 == 1)
        if len(firsts) == 1 and firsts[0] > 0:  # one whole span: a copy with the span rewritten
            a, k = int(firsts[0]), (int(tags[firsts[0]]) - 1) // 2
            b = a + int((tags[a:] > 0).sum())
            if b < len(tags):
                new = disguised(row.x[a:b], KINDS[k], r)
                text = (row.x[:a] + new + row.x[b:])[:WIDTH]
                x.append(symbols(text))
                y.append(tags_of(WIDTH, [(a, min(a + len(new), WIDTH), KINDS[k])]))
    tagger = Tagger(OTHER + 2, TAGS)
    tagger.train(np.array(x), np.array(y), steps)
    return tagger


def _settled(p: np.ndarray) -> Iterator[tuple[int, int, str, float]]:
    """Spans (start, end, kind, mean probability) of the best path through a region's averaged probabilities."""
    if (p[:, 0] > 0.5).all():
        return  # no path beats that of no span at all
    path = best_path(np.log(np.maximum(p, 1e-9)), ALLOWED, START)
    firsts = [*np.flatnonzero(path % 2 == 1), len(path)]
    for a, following in zip(firsts, firsts[1:]):
        k, b = path[a], a + 1
        while b < following and path[b] == k + 1:
            b += 1
        yield int(a), int(b), KINDS[(k - 1) // 2], float((p[a:b, k] + p[a:b, k + 1]).mean())


WEIGHT = np.minimum(np.arange(WIDTH) + 1, WIDTH - np.arange(WIDTH)).astype(float)


def found_by(tagger: Tagger | None, texts: list[str], most: int = 512) -> list[list[tuple[int, int, str, float]]]:
    """Spans that the network finds in each text; regions that a span reaches the end of are read again, twice as far."""
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    if tagger is None:
        return out
    todo = [(i, a, b) for i, t in enumerate(texts) for a, b in regions(t)]
    while todo:
        again: dict[int, list[list[int]]] = {}
        for (i, a, b), spans in zip(todo, _found_in(tagger, texts, todo, most)):
            left = any(s == a for s, *_ in spans) and a > 0
            right = any(e == b for _, e, *_ in spans) and b < len(texts[i])
            if left or right:
                more = max(WIDTH, b - a)
                a, b = max(0, a - more) if left else a, min(len(texts[i]), b + more) if right else b
                again.setdefault(i, []).append([a, b])
            else:
                out[i] += spans
        todo = []
        for i, wider in again.items():
            runs: list[list[int]] = []
            for a, b in sorted(wider):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            todo += [(i, a, b) for a, b in runs]
    return [_apart(spans) for spans in out]


def _apart(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """In order of starts; of spans that meet, which widened regions can find twice, the surer one stays."""
    kept: list[tuple[int, int, str, float]] = []
    for s in sorted(spans):
        if kept and s[0] < kept[-1][1]:
            kept[-1] = max(kept[-1], s, key=lambda x: x[3])
        else:
            kept.append(s)
    return kept


def _found_in(tagger: Tagger, texts: list[str], todo: list[tuple[int, int, int]], most: int) -> list[list[tuple[int, int, str, float]]]:
    """Spans of each region (text, start, end)."""
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in todo]
    window = [(n, s) for n, (_, a, b) in enumerate(todo) for s in _starts(a, b)]
    total: np.ndarray | None = None
    open_ = -1  # the region whose windows are being added up

    def close() -> None:
        a = todo[open_][1]
        out[open_] += [(a + s, a + e, k, v) for s, e, k, v in _settled(total / total.sum(1, keepdims=True))]

    for at in range(0, len(window), most):
        some = window[at:at + most]
        x = np.array([symbols(texts[todo[n][0]][s:min(s + WIDTH, todo[n][2])]) for n, s in some])
        for (n, s), p in zip(some, tagger.probabilities(x)):
            _, a, b = todo[n]
            if n != open_:
                if total is not None:
                    close()
                open_, total = n, np.zeros((b - a, TAGS))
            length = min(WIDTH, b - s)
            total[s - a:s - a + length] += p[:length] * WEIGHT[:length, None]
    if total is not None:
        close()
    return out


def spans_of(texts: list[str], tagger: Tagger | None, sure: float = SURE) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    out = []
    for text, found in zip(texts, found_by(tagger, texts)):
        base = base_spans(text)
        more, at = [], 0
        for a, b, kind, p in found:  # both lists are in order of starts
            x = text[a:b]
            a, b = b - len(x.lstrip()), a + len(x.rstrip())
            while at < len(base) and base[at][1] <= a:
                at += 1
            if p >= sure and a < b and not any(a < e for _, e, _ in takewhile(lambda t: t[0] < b, islice(base, at, None))) and can_be(kind, text[a:b]):
                more.append((a, b, kind))
        out.append((base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(s, SLICE) for b in batches for s in range(0, b.num_rows, SLICE))


def scan(docs: DataFrame, tagger: Tagger | None, sure: float = SURE) -> DataFrame:
    """doc_id, ``base`` and ``spans``: arrays of (start, end, kind) in code points, the end exclusive."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            got = spans_of([t or "" for t in batch.column(1).to_pylist()], tagger, sure)
            cols = [pa.array([[dict(zip(("start", "end", "kind"), s)) for s in g[i]] for g in got], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<start:long,end:long,kind:string>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {spans}, spans {spans}")


def mask(docs: DataFrame, tagger: Tagger | None, sure: float = SURE) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; texts without a span stay as they are."""
    def clean(text: str, spans: list[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            i = batch.schema.get_field_index("text")
            texts = batch.column(i).to_pylist()
            made = [t if t is None else clean(t, s) for t, (_, s) in zip(texts, spans_of([t or "" for t in texts], tagger, sure))]
            yield batch.set_column(i, batch.schema.field(i), pa.array(made, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def _joined(name: str):
    return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op13_personal_data")
def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = scan(docs, learn(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
