"""Collocations against brute force, with awkward texts and block sizes."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from trackloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, w1 string, c int, f string, size int"


def brute(rows, least, top):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for i in range(len(ws)):
                for k in range(1, 5):
                    if i + k <= len(ws):
                        f.setdefault(lang, Counter())[tuple(ws[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        many = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in many.items():
            for k in range(2, len(p)):
                for s in range(len(p) - k + 1):
                    inside[p[s:s + k]] = max(inside[p[s:s + k]], a)
        best = []
        for p, a in many.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    vocabulary = ["the", "The", "of", "é", "\x1fx", "new", "york", "city", "hall", "a", "b"]
    out = [(None, None, "en"), (1, "", "en"), (2, " \t ", None), (3, "...,,,", "en"), (4, "one", "fr")]
    for i in range(120):
        ws = [r.choice(vocabulary) + r.choice(["", "", "", ",", ".\n", "\t", "!", "\x0c"]) for _ in range(60)]
        out.append((i // 2, " ".join(ws) + " new york city hall" * (i % 3), r.choice(["en", "en", "en", None, "de"])))
    return out + [out[-1]] * 3


@pytest.mark.parametrize("block", [1 << 23, 300])
def test_collocations_equal_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", block)
    docs = spark.createDataFrame([(d, t, lang, "w", 1, "f", 2) for d, t, lang in rows], SCHEMA).repartition(3)
    for least, top in ((3, 2000), (30, 5)):
        got = sorted(tuple(r) for r in phrases.collocations(docs, least, top).collect())
        assert got and got == brute(rows, least, top)


def test_nothing_to_count(spark):
    for rows in ([], [(1, None, None), (2, "", "en"), (3, "a b c", "en")]):
        docs = spark.createDataFrame([(d, t, lang, "w", 1, "f", 2) for d, t, lang in rows], SCHEMA)
        got = phrases.collocations(docs)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0


def test_hashes_that_collide_only_lengthen_windows(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "_table_bits", lambda n: 14)
    monkeypatch.setattr(phrases, "_is_set", lambda table, key: np.ones(len(key), bool))
    docs = spark.createDataFrame([(d, t, lang, "w", 1, "f", 2) for d, t, lang in rows], SCHEMA)
    assert sorted(tuple(r) for r in phrases.collocations(docs, 3).collect()) == brute(rows, 3, 2000)


def test_scores_pass_64_bits(spark):
    assert spark.sql("SELECT CAST(9000000000000000000 AS DECIMAL(19,0)) * CAST(2000000 AS DECIMAL(7,0)) div "
                     "(CAST(9000000000000000001 AS DECIMAL(19,0)) + CAST(2 AS DECIMAL(19,0)))").first()[0] == 1999999
