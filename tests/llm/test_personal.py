"""Personal data: patterns against their plain form, the network against enumeration and differences, held-out spans."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from trackloom.llm import bilstm, personal

SCHEMA = "doc_id long, text string, base string, spans int, x string"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 9 <= len(d) <= 15 \
                    or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], personal.KINDS.index(s[2])))


def number(r, n):
    d = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def spans_made(r):
    return r.choice([lambda: f"{r.choice(['ann', 'bob.x', 'cee_d'])}.{r.randrange(99)}@mail{r.randrange(9)}.example.com",
                     lambda: ".".join(str(r.randrange(256)) for _ in range(4)), lambda: number(r, 16),
                     lambda: f"+{r.randrange(1, 9)} ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"])()


def text_made(r, spans):
    words = lambda: " ".join(r.choice(["of", "the", "Éa", "room", "7", "page", "1999", "x,"]) for _ in range(r.randrange(3, 30)))
    return words() + "".join(f" of {spans_made(r)} the {words()}" for _ in range(spans))


@pytest.fixture(scope="module")
def tagger(spark):
    r = random.Random(1)
    docs = spark.createDataFrame([(i, text_made(r, 3), "b", 1, "x") for i in range(300)], SCHEMA).repartition(3)
    return personal.learn(docs, 150, 250)


def test_base_spans_equal_plain_patterns():
    r = random.Random(5)
    for alphabet in ("0123456789. -+", "a1@.-+ %", "19.@a ()+-"):
        for _ in range(3000):
            t = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
            assert personal.base_spans(t) == plain_spans(t), t
    for _ in range(200):
        t = text_made(r, 4)
        assert personal.base_spans(t) == plain_spans(t) and len(plain_spans(t)) >= 4


def test_long_runs_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000, "a@" * 150_000, "+1" + " " * 300_000, "." * 300_000):
        assert personal.base_spans(t) == []


def small():
    t = bilstm.Tagger(6, 3, hidden=4, size=3, seed=3)
    t.p = {k: v.astype(np.float64) + np.random.default_rng(4).normal(size=v.shape) * 0.3 for k, v in t.p.items()}
    r = np.random.default_rng(5)
    return t, r.integers(0, 6, (2, 5)), r.integers(0, 3, (2, 5))


def score(t, u, y):
    return sum(u[i, c] for i, c in enumerate(y)) + sum(t.p["t"][a, b] for a, b in zip(y, y[1:])) + t.p["s"][y[0]]


def test_probabilities_and_loss_equal_enumeration():
    t, x, y = small()
    u = t.unary(x)[0]
    got, loss = t.probabilities(x), 0
    for n in range(2):
        ways = list(itertools.product(range(3), repeat=5))
        w = np.exp([score(t, u[n], v) for v in ways])
        want = np.array([[sum(w[i] for i, v in enumerate(ways) if v[at] == c) for c in range(3)] for at in range(5)]) / w.sum()
        assert np.allclose(got[n], want)
        loss -= score(t, u[n], y[n]) - np.log(w.sum())
    assert np.isclose(t.loss(x, y)[0], loss / 2)


def test_gradients_equal_differences():
    t, x, y = small()
    g = t.loss(x, y)[1]
    r = np.random.default_rng(6)
    for name, value in t.p.items():
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in value.shape)
            was = value[at]
            value[at] = was + 1e-5
            up = t.loss(x, y)[0]
            value[at] = was - 1e-5
            down = t.loss(x, y)[0]
            value[at] = was
            assert np.isclose(g[name][at], (up - down) / 2e-5, atol=1e-7), name


def test_best_path_equals_enumeration():
    r = np.random.default_rng(7)
    for _ in range(20):
        s = r.normal(size=(4, personal.TAGS))
        ways = [v for v in itertools.product(range(personal.TAGS), repeat=4) if personal.START[v[0]] and all(personal.ALLOWED[a, b] for a, b in zip(v, v[1:]))]
        best = max(ways, key=lambda v: sum(s[i, c] for i, c in enumerate(v)))
        assert tuple(bilstm.best_path(s, personal.ALLOWED, personal.START)) == best


def test_held_out_spans_are_found(tagger):
    r = random.Random(9)
    texts = [text_made(r, 3) for _ in range(200)]
    want = {(i, *s) for i, t in enumerate(texts) for s in personal.base_spans(t)}
    got = {(i, a, b, k) for i, found in enumerate(personal.found_by(tagger, texts)) for a, b, k, p in found if p >= 0.5}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    clean = [text_made(r, 0) for _ in range(200)]
    assert sum(len(s) for _, s in personal.spans_of(clean, tagger)) <= 2


def test_windows_do_not_change_what_is_found(tagger):
    r = random.Random(11)
    text = "".join(f"page of the {spans_made(r)} of the room x, " for _ in range(40))  # one region over many windows
    assert len(personal.regions(text)) == 1
    base, spans = personal.spans_of([text], tagger)[0]
    found = {s[:3] for s in personal.found_by(tagger, [text])[0]}
    assert set(base) <= set(spans) and len(set(base) & found) >= 0.85 * len(base)
    alone = personal.found_by(tagger, ["7 of", text, "", "x 12 y"])
    assert {s[:3] for s in alone[1]} == found  # other texts of the batch do not matter


def test_spellings_that_no_pattern_knows_are_added(tagger):
    texts = ["the room of ann.12[at]mail3.example.com page of the", "of the room (415) 555-2671 page the of", "page of the 10[.]2[.]3[.]44 room of"]
    got = personal.spans_of(texts, tagger)
    assert all(not base for base, _ in got) and sum(bool(s) for _, s in got) >= 2


def test_scan_mask_and_query(spark, tmp_path):
    r = random.Random(13)
    rows = [(None, "a b.1@c.de f"), (1, None), (2, ""), (3, "no numbers"), (4, text_made(r, 2)), (4, text_made(r, 1)), (5, text_made(r, 2) * 300)]
    docs = spark.createDataFrame([(d, t, "b", 1, "x") for d, t in rows], SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = personal.op13_personal_data(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for i, t in rows:
        base = plain_spans(t or "")
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        mine = [g for g in got if g.doc_id == i and g.base_sha256 == digest]
        assert mine
        for k in personal.KINDS:
            assert mine[0][f"n_{k}"] == sum(s[2] == k for s in base)
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(mine[0].spans.split(",") if mine[0].spans else [])
    masked = personal.mask(docs, None)
    assert masked.columns == docs.columns
    texts = {m.text for m in masked.filter("doc_id IS NULL OR doc_id < 4").collect()}
    assert texts == {"a [EMAIL] f", None, "", "no numbers"}


def test_nothing_to_learn_from(spark):
    for rows in ([], [(1, None, "b", 1, "x"), (2, "only 12 words", "b", 1, "x")]):
        docs = spark.createDataFrame(rows, SCHEMA)
        assert personal.learn(docs) is None and personal.scan(docs, None).count() == len(rows)


def test_places_without_a_digit_or_at_sign_and_long_spans_are_looked_at():
    import numpy as np

    class Marked:
        """Finds runs of letters beyond ASCII, taken for addresses."""

        def probabilities(self, x):
            p = np.full((*x.shape, personal.TAGS), 1e-6)
            hit = x >= personal.OTHER
            first = hit & ~np.pad(hit, ((0, 0), (1, 0)))[:, :-1]
            first[:, 0] = False  # a window's first place says nothing of what lies before it
            p[..., 0] = np.where(hit, 1e-6, 1.0)
            p[..., 1] = np.where(first, 1.0, 1e-6)
            p[..., 2] = np.where(hit & ~first, 1.0, 1e-6)
            return p / p.sum(-1, keepdims=True)

    word = "é" * 5
    plain, long = f"mail {word} at home", "x " * 60 + "é" * 90 + "1" + "é" * 90 + " y" * 60
    assert [(a, b) for a, b, *_ in personal.found_by(Marked(), [plain])[0]] == [(5, 10)]
    ends = personal.found_by(Marked(), [long])[0]
    assert min(a for a, *_ in ends) == 120 and max(b for _, b, *_ in ends) == 301
