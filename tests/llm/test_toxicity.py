import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterwise.llm import toxicity as T


def corpus(seed, n=600):
    """Clean texts, toxic ones with inflected forms of two stems, and texts of poor quality."""
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ba", "to", "mi", "ru") for b in ("lo", "sen", "ti") for c in ("", "r", "na", "x")]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([5, 40, 200]))]
        toxic, poor = i % 5 == 0, i % 3 == 0
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                text.insert(rng.randrange(len(text)), rng.choice(["Zlurk", "vexnar"]) + rng.choice(["", "en", "ist", "o", f"q{rng.randrange(50)}"]))
        if poor:
            text.insert(0, "junkjunk")
        rows.append((i, " ".join(text) + "!", 0 if poor else 1, int(toxic)))
    return rows


@pytest.fixture(scope="module")
def chain(spark):
    train = spark.createDataFrame(corpus(1), "doc_id long, text string, quality int, toxic int")
    extra = spark.createDataFrame([(9999, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int")
    return T.labelled_chain(train.select("doc_id", "text"), train.select("doc_id", "quality", "toxic").unionByName(extra))


def test_held_out_accuracy(spark, chain):
    rows = corpus(2, 400)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows], "doc_id long, text string, toxic string")
    out = {r.doc_id: r for r in T.classify(docs, chain).collect()}
    assert sum(out[i].toxic == bool(y) for i, _, _, y in rows) >= 0.99 * len(rows)
    assert sum((out[i].p_low_quality > 0.5) == (q == 0) for i, _, q, _ in rows) >= 0.99 * len(rows)
    kept = T.without(docs, chain)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.toxic}


def features(text):
    words = re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())
    return {(0, w) for w in words} | {(n, w[:n]) for w in words for n in T.BEGINNINGS if len(w) >= n}


def newton(x, y, penalty=0.3):
    """The same logistic regression by Newton's method; the last column of x is the bias."""
    w, weight = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, penalty), 0.0)
    if y.min() == y.max():
        w[-1] = np.log(min(max(y.mean(), 1e-4), 1 - 1e-4) / (1 - min(max(y.mean(), 1e-4), 1 - 1e-4)))
        return w
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(weight + 1e-9), x.T @ (p - y) + weight * w)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return w


def brute_chain(rows, fold, folds, new):
    """Probabilities of every category for the texts `new`, by dense models of the same features and folds."""
    sets, labels = [features(t) for _, t, _ in rows], np.array([y for _, _, y in rows], float)
    earlier, later = np.zeros((len(rows), 0)), np.zeros((len(new), 0))
    for c in range(labels.shape[1]):
        y, out, final = labels[:, c], np.zeros(len(rows)), None
        for model in range(folds + 1):
            inside = fold != model
            count, told = Counter(f for s, i in zip(sets, inside) if i for f in s), Counter(f for s, i, v in zip(sets, inside, y) if i and v for f in s)
            share = y[inside].mean()
            score = {f: abs(told[f] - n * share) / np.sqrt(n * max(share * (1 - share), 1e-9)) for f, n in count.items() if n >= T.LEAST_DOCS}
            used = sorted(f for f, v in score.items() if v >= T.LEAST_SCORE)
            assert len(used) <= T.FEATURES
            table = lambda some, before, used=used: np.column_stack([np.array([[float(f in s) for f in used] for s in some]).reshape(len(some), -1), before, np.ones(len(some))])
            w = newton(table(sets, earlier)[inside], y[inside])
            if model < folds:
                out[~inside] = 1 / (1 + np.exp(-table(sets, earlier)[~inside] @ w))
            else:
                final = 1 / (1 + np.exp(-table([features(t) for t in new], later) @ w))
        earlier, later = np.column_stack([earlier, out]), np.column_stack([later, final])
    return later, earlier


def three_categories(seed, n):
    return [(i, t + (" grolm" if y and i % 2 else ""), (1 - q, y, int(bool(y and i % 2)))) for i, t, q, y in corpus(seed, n)]


def test_a_chain_of_three_categories_equals_brute_force(spark):
    rows = three_categories(4, 300)
    table = spark.createDataFrame([(i, t, *y) for i, t, y in rows], "doc_id long, text string, low_quality int, toxic int, severe int")
    names = ("low_quality", "toxic", "severe")
    chain = T.train_chain(table.select("doc_id", "text"), table.select("doc_id", *names), names, "toxic")
    assert chain.categories == names and not np.any(chain.earlier[0]) and np.any(chain.earlier[2, :2] != 0)
    folds = {r.doc_id: r.fold for r in table.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(T.FOLDS)).alias("fold")).collect()}
    new = [t for _, t, _ in three_categories(5, 100)] + ["", "vexnar", "junkjunk Zlurken"]
    want, out_of_fold = brute_chain(rows, np.array([folds[i] for i, _, _ in rows]), T.FOLDS, new)
    got = {r.doc_id: r for r in T.classify(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), chain).collect()}
    found = np.array([[got[i][f"p_{c}"] for c in names] for i in range(len(new))])
    assert np.abs(found - want).max() < 0.03
    assert abs(chain.threshold - T._best_threshold([(y[1], p) for (_, _, y), p in zip(rows, out_of_fold[:, 1])])) < 0.1


def test_features_of_a_model_do_not_see_its_fold(spark):
    # a word that only toxic rows of one fold have tells nothing to the model that leaves this fold out
    sums = lambda *by_fold: [x for pair in by_fold for x in pair]
    totals = sums((100, 20), (100, 20))
    counts = spark.createDataFrame([(7, sums((20, 20), (0, 0))), (8, sums((20, 20), (20, 20)))], "feature long, sums array<long>")
    assert sorted(T.telling(counts, totals, 2, 1)[0]) == [(7, 1), (7, 2), (8, 0), (8, 1), (8, 2)]


def test_nulls_ties_and_long_texts(spark, chain):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "vexnar Zlurk"), (None, "vexnar Zlurk"), (3, "ba " * 200_000)], "doc_id long, text string")
    out = T.classify(docs, chain).collect()
    assert len(out) == 5 and all(0 <= r.p_toxic <= 1 for r in out)
    assert [r.toxic for r in out if r.doc_id is None] == [True, True]
    assert T.without(docs, chain).count() == 3


def test_without_labels_nothing_is_flagged(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = T.labelled_chain(docs, none)
    assert T.classify(docs, chain).where("toxic").count() == 0
    assert T.classify(docs.limit(0), chain).count() == 0


def test_sample_is_bounded(spark):
    rows = corpus(3, 200)
    train = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    chain = T.labelled_chain(train.select("doc_id", "text"), train.select("doc_id", "quality", "toxic"), sample=60)
    assert T.classify(train.select("doc_id", "text"), chain).where(F.col("toxic")).count() > 0


def test_rows_that_share_an_id_train_alike_in_any_order(spark):
    """Half of the labelled ids have a second, clashing label, and some documents a second text."""
    rng = random.Random(3)
    docs = [(i, f"{'bad words here' if i % 4 == 0 else 'good words there'} number {rng.randrange(9)} " * 3) for i in range(200)] + [(i, "another text of the same id") for i in range(0, 200, 10)]
    labels = [(i, i % 2, int(i % 4 == 0)) for i in range(200)] + [(i, 1 - i % 2, int(i % 4 != 0)) for i in range(0, 200, 2)]
    chains = []
    for seed in (1, 2):
        random.Random(seed).shuffle(docs)
        random.Random(seed + 9).shuffle(labels)
        chain = T.train_chain(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ("quality", "toxic"), "toxic", folds=2)
        chains.append((chain.threshold, chain.bias.tolist(), chain.weights.tolist()))
    assert np.allclose(chains[0][0], chains[1][0]) and np.allclose(chains[0][1], chains[1][1]) and np.allclose(chains[0][2], chains[1][2])
