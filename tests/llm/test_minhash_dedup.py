import random
import re

import numpy as np
import pytest

from meterwise.llm import minhash_dedup as M


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {(i, len(s), root(i), root(i) == i) for i, s in sets}


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(8)]
    rows = []
    for n in range(160):
        text = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((n, rng.choice([" ", "\n", "  "]).join(text)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One Two"), (204, "one two"), (205, "one"), (206, "é É"), (207, "é é"), (208, " ".join(["a"] * 40))]
    rows += [(209, " ".join(words * 120)), (210, " ".join(words * 120) + " end")]
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component string, kept_id int").repartition(5)
    assert {tuple(r) for r in M.near_duplicates(docs).collect()} == brute(rows)
    kept = M.near_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _, k in brute(rows) if k}


def test_crossing_blocks_find_what_leaders_miss(spark):
    # a chain: each text is alike to its neighbours only
    words = [f"c{i}" for i in range(200)]
    rows = []
    for n in range(12):
        rows.append((n, " ".join(words[n * 6 : n * 6 + 110])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in M.near_duplicates(docs).collect()} == brute(rows)


def test_empty_and_null_ids(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, "A B")], "doc_id long, text string")
    got = sorted(map(tuple, M.near_duplicates(docs).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 1, None, True)]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    found = {r.node: r.component for r in M.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(60)}


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        M.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), percent=70)


def alternating(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_fool_polynomial_hashes_are_told_apart(spark):
    one = alternating(2048)
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"p q {one} r s"), (2, f"p q {two} r s"), (3, one), (4, two)], "doc_id long, text string")
    assert all(r.kept and r.component_id == r.doc_id for r in M.near_duplicates(docs).collect())


def test_hot_groups_of_equal_and_alike_texts(spark, monkeypatch):
    from meterwise.operators import joins

    monkeypatch.setattr(joins, "LEAST", 20)
    monkeypatch.setattr(joins, "SHARE", 10)
    rows = corpus()
    rows += [(1000 + n, rows[3][1]) for n in range(150)] + [(2000 + n, " ") for n in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in M.near_duplicates(docs).collect()} == brute(rows)


def test_signatures_of_large_sets_differ():
    one, two = ([f"{name}{i}" for i in range(20_000)] for name in "xy")
    sketches = [M.mix(M.minima(s)) >> 48 for s, _ in M.shingle_sets([" ".join(t).encode() for t in (one, two)])]
    assert (sketches[0] == sketches[1]).mean() < 0.02


def templated(n, seed):
    """Texts of which a template makes half their shingles or so, and copies of some with a few words changed."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(n):
        own = [f"o{rng.randrange(5000)}" for _ in range(45)]
        rows.append((2 * i, " ".join(template + own)))
        if i % 3 == 0:
            own[rng.randrange(45)] = "changed"
            rows.append((2 * i + 1, " ".join(template + own)))
    return rows


def test_crowded_buckets_are_split_by_finer_bands(spark, monkeypatch):
    rows = templated(150, 6) + [(i + 1000, t) for i, t in corpus()]
    want = brute(rows)
    monkeypatch.setattr(M, "CROWD", 5)
    crowds, seen = M._crowds, []
    monkeypatch.setattr(M, "_crowds", lambda *x: seen.append(crowds(*x)) or seen[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in M.near_duplicates(docs).collect()} == want
    assert seen and seen[0].count() > 1


def test_finer_bands_meet_at_the_threshold_and_part_templates():
    rng = np.random.default_rng(11)
    places = M.BANDS * M.ROWS
    one = rng.integers(0, 2**16, (20_000, places)).astype(np.uint16)
    for share, least, most in ((0.85, 1 - 5e-4, 1), (0.5, 0, 0.15)):
        two = np.where(rng.random(one.shape) < share, one, one ^ 1).astype(np.uint16)
        met = (M.fine_keys(one) == M.fine_keys(two)).any(1).mean()
        assert least <= met <= most, (share, met)
    # bands are told apart
    assert len(np.unique(M.fine_keys(np.zeros((1, places), np.uint16)))) == M.FINE
