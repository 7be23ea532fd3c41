"""Collocations against a version that counts every phrase in Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from meterwise.llm.collocations import candidates, collocations, counted_phrases


def _pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def _counts(rows, longest=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in _pieces(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f, n


def _brute(rows, least, best, percent=100):
    f, n = _counts(rows)
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        scored = []
        for p, a in frequent.items():
            inside = (q for q in frequent if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if any(100 * frequent[q] >= percent * a for q in inside):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), " ".join(p), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p, -a, l, r, n[lang], -s) for i, (s, a, _, p, l, r) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out)


def _corpus(seed=1, size=300):
    rng = random.Random(seed)
    words = ["Ab", "ab", "c", "dé", "e-f", "GG", "h", "日本", "x" * 40, "zz\x0bq"]
    rows = []
    for _ in range(size):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "!?"]) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und"]), text + rng.choice(["", "New York City of light", "new york city"])))
    return [*rows, ("en", None), ("en", ""), ("de", "... !"), ("fr", "one two " * 3000)]


def _run(spark, rows, **how):
    docs = spark.createDataFrame([(lang, text, 1.0) for lang, text in rows], "lang string, text string, score double").repartition(5)
    return sorted(tuple(r) for r in collocations(docs, **how).collect())


@pytest.mark.parametrize("how", [{}, {"cells": 1 << 7, "phrases": 40}, {"percent": 60}])
def test_collocations_equal_brute_force(spark, how):
    """Also with a sketch so small that most phrases are candidates, and with several automata."""
    rows = _corpus()
    assert _run(spark, rows, least=6, best=50, **how) == _brute(rows, 6, 50, how.get("percent", 100))


def test_all_copies_and_no_rows(spark):
    rows = [("en", "the same text again and again")] * 200
    assert _run(spark, rows, least=100) == _brute(rows, 100, 2000)
    assert _run(spark, [("en", None), (None, " . ")]) == []
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_no_phrase_is_missed_and_few_others_are_counted(spark):
    rows = _corpus(4)
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("coalesce(lang, 'und') AS lang", "text")
    counts, totals = counted_phrases(docs, 8, 5, 1 << 16)
    f, n = _counts(rows)
    assert {r.lang: r.n for r in totals.collect() if r.n} == {k: v for k, v in n.items() if v}
    found = {(r.lang, tuple(r.phrase.split(" "))): r.f for r in counts.collect()}
    assert all(found[key] == f[key[0]][key[1]] for key in found)
    assert {(lang, p) for lang, counts in f.items() for p, a in counts.items() if a >= 8 and len(p) > 1} <= set(found)
    every = candidates(docs, [[b"\xff" * 8192] * 2] * 2, 5, 1 << 16)
    assert every.count() == sum(len(p) > 1 for counts in f.values() for p in counts)
