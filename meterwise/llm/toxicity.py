"""Toxicity by a classifier chain: linear models of one category after another.

A model sees the words of a document and the probabilities of the categories before it. For training those are
out-of-fold: each row's come from a model that has not seen its fold, neither to choose its features nor to weigh them, so
that later models and the threshold meet probabilities as they will be on new documents. Features are hashed words and
beginnings of words, which inflected forms share; each model keeps those that tell its category best on its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LETTERS, Words, few_rows, mix, small_batches, stored

#: At most so many labelled rows train the chain; more are sampled by a hash of their id.
SAMPLE = 12_000
FOLDS = 5
#: At most so many features are kept for each category; so many documents of the sample must have one, and so many
#: standard deviations must lie between the category's share of them and its share of all.
FEATURES, LEAST_DOCS, LEAST_SCORE = 2048, 4, 5.0
#: Lengths in bytes of the beginnings of words.
BEGINNINGS = (4, 5, 6, 8)


@dataclass(frozen=True)
class Chain:
    """The trained models: sorted feature hashes, and for each category a bias, a weight for each category before it,
    and a weight for each feature. `threshold` belongs to the category `decides`."""

    categories: tuple[str, ...]
    features: np.ndarray
    bias: np.ndarray
    earlier: np.ndarray
    weights: np.ndarray
    decides: str
    threshold: float


def features_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) without repeats: the hashed words of the texts (A-Z lower-cased) and their beginnings."""
    words = Words(texts, lower=True, kind=LETTERS)
    text = np.repeat(np.arange(len(texts)), np.diff(words.first))
    found, of = [words.hashes], [text]
    for n in BEGINNINGS:
        longer = words.ends - words.starts >= n
        starts = words.starts[longer]
        found.append(mix(words.spans(starts, starts + n) ^ np.uint64(n)))
        of.append(text[longer])
    feature, text = np.concatenate(found).view(np.int64), np.concatenate(of)
    order = np.lexsort((feature, text))
    feature, text = feature[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (feature[1:] != feature[:-1]) | (text[1:] != text[:-1])
    return text[new], feature[new]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in small_batches(batches, 1):
        text, feature = features_of(texts)
        counts = np.bincount(text, minlength=len(texts))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(feature))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], names=["id", "labels", "features"])


def _lists(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = column.map(len).to_numpy(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.asarray(x, np.int64) for x in column]) if sizes.sum() else np.zeros(0, np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(row: np.ndarray, place: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, penalty: float = 0.3, steps: int = 200) -> np.ndarray:
    """Logistic regression: weights of the features (row, place), of the dense columns, and the bias. Accelerated
    gradient descent on the mean loss with an L2 penalty."""
    n, extra = len(y), dense.shape[1]
    w = v = np.zeros(width + extra + 1)
    prior = min(max(y.mean(), 1e-4), 1 - 1e-4)
    w = w.copy()
    w[-1] = np.log(prior / (1 - prior))
    v = w.copy()
    if y.min() == y.max():
        return w
    used = np.bincount(place, minlength=width) / n
    rate = 4 / np.concatenate((used * 8 + 16 / n, np.full(extra, 4.0), [4.0]))  # by feature: rare ones take larger steps
    t = 1.0
    for _ in range(steps):
        z = np.bincount(row, v[place], minlength=n) + dense @ v[width : width + extra] + v[-1]
        gap = sigmoid(z) - y
        slope = np.concatenate((np.bincount(place, gap[row], minlength=width), dense.T @ gap, [gap.sum()])) / n + penalty / n * np.append(v[:-1], 0)
        after = v - rate * slope
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = after + (before - 1) / t * (after - w)
        w = after
    return w


def _fit_fold(category: int, chosen: np.ndarray, folds: int):
    """One model: rows of all folds but its own train it, its own get probabilities; the last model trains on all rows.
    chosen has, for each model, the features that it uses."""
    width = chosen.shape[1]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fold", "id"], kind="stable")
        model = int(rows["model"].iloc[0])
        train = (rows["fold"] != model).to_numpy()
        y = np.array([x[category] for x in rows["labels"]], float)
        dense = np.array([list(x) for x in rows["earlier"]], float).reshape(len(rows), -1)
        row, place = _lists(rows["places"])
        used = chosen[model][place]
        row, place = row[used], place[used]
        inside = train[row]
        w = fit((np.cumsum(train) - 1)[row[inside]], place[inside], dense[train], y[train], width) if train.any() else np.zeros(width + dense.shape[1] + 1)
        if model == folds:
            return pd.DataFrame({"id": [None], "probability": [None], "weights": [w.tolist()]})
        z = np.bincount(row, w[place], minlength=len(rows)) + dense @ w[width:-1] + w[-1]
        return pd.DataFrame({"id": rows["id"][~train], "probability": sigmoid(z[~train]), "weights": None})

    return run


def telling(counts: DataFrame, totals: list, folds: int, categories: int) -> list[list[tuple[int, int]]]:
    """For each category and model (model i leaves fold i out, the last none) the features (feature, model) that tell it best on the
    model's rows. counts has for each feature, and totals for all rows, the sums by fold: rows, then rows of each category."""
    width = 1 + categories

    def summed(column, model: int, k: int):
        parts = [column(f * width + k) for f in range(folds) if f != model]
        return sum(parts[1:], parts[0])

    found = []
    for c in range(categories):
        models = []
        for model in range(folds + 1):
            n, hits = (summed(lambda i: totals[i], model, k) for k in (0, c + 1))
            share = hits / max(n, 1)
            rows, told = (summed(lambda i: F.col("sums")[i], model, k) for k in (0, c + 1))
            score = F.when(rows >= LEAST_DOCS, (told - rows * share) / F.sqrt(rows * max(share * (1 - share), 1e-9)))
            models.append(F.struct(F.lit(model).alias("model"), F.abs(score).alias("score")))
        each = counts.select("feature", F.explode(F.array(*models)).alias("m")).select("feature", "m.*").where(F.col("score") >= LEAST_SCORE)
        rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("score"), "feature"))
        found.append([(r.feature, r.model) for r in each.withColumn("rank", rank).where(F.col("rank") <= FEATURES).select("feature", "model").collect()])  # at most FEATURES for each model
    return found


def train_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], decides: str, sample: int = SAMPLE, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Trains a chain on rows of labels (id, a 0/1 column for each category) and the texts of docs.

    At most `sample` labelled rows are used, those whose id has the least hash; rows with a null label are left out. Of
    labels that share an id the least count, category by category, and of texts that share an id that with the least hash. The threshold is that of the best F1 on out-of-fold probabilities, the highest of
    those that tie. Without labelled rows nothing is ever flagged.
    """
    known = labels.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (id_col, *categories)))
    least = F.min(F.array(*(F.col(c).cast("int") for c in categories))).alias("labels")
    some = known.groupBy(F.col(id_col).alias("id")).agg(least).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(some), "id")  # bounded by `sample`
    kind = texts.schema["id"].dataType.simpleString()
    texts = texts.groupBy("id", "labels").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = few_rows(texts).select("id", "text", "labels").mapInArrow(_features, f"id {kind}, labels array<int>, features array<long>")
    rows = stored(rows.withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(folds)).cast("int")), "labelled")
    flags = [F.lit(1), *(F.col("labels")[c] for c in range(len(categories)))]
    sums = F.array(*(F.sum(F.when(F.col("fold") == f, x).otherwise(0)) for f in range(folds) for x in flags)).alias("sums")
    totals = [x or 0 for x in rows.agg(sums).first()[0]]
    counts = stored(rows.select("labels", "fold", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), sums).where(F.col("n") >= LEAST_DOCS).drop("n"), "counts")
    best = telling(counts, totals, folds, len(categories))
    features = np.unique(np.array([f for b in best for f, _ in b], np.int64))
    width = len(features)
    chosen = [np.zeros((folds + 1, width), bool) for _ in categories]
    for c, b in enumerate(best):
        if b:
            chosen[c][np.array([m for _, m in b]), np.searchsorted(features, np.array([f for f, _ in b], np.int64))] = True

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends, value = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            at = np.searchsorted(features, value)
            at[at == width] = 0
            known = features[at] == value if width else np.zeros(len(value), bool)
            counts = np.bincount(row[known], minlength=batch.num_rows)
            places = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(at[known].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), places, batch.column(3)], names=["id", "labels", "places", "fold"])

    rows = rows.mapInArrow(placed, f"id {kind}, labels array<int>, places array<int>, fold int")
    rows = stored(rows.withColumn("earlier", F.array().cast("array<double>")), "chosen")
    k = len(categories)
    bias, weights, earlier, threshold = np.full(k, -30.0), np.zeros((k, width)), np.zeros((k, k)), 1.0
    for i, name in enumerate(categories if any(totals) else ()):
        models = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(folds))))
        fitted = stored(models.groupBy("model").applyInPandas(_fit_fold(i, chosen[i], folds), f"id {kind}, probability double, weights array<double>"), "fitted")
        w = np.array(fitted.where("weights is not null").first().weights)
        bias[i], weights[i], earlier[i, :i] = w[-1], w[:width], w[width:-1]
        rows = rows.join(fitted.where("weights is null").select("id", "probability"), "id").withColumn("earlier", F.concat("earlier", F.array("probability"))).drop("probability")
        if i + 1 < k or name == decides:
            rows = stored(rows, "chain")
        if name == decides:
            threshold = _best_threshold(rows.select(F.col("labels")[i], F.col("earlier")[i]).collect())  # bounded by `sample`
    return Chain(categories, features, bias, earlier, weights, decides, threshold)


def _best_threshold(rows: list) -> float:
    """The probability, halfway between two rows, above which F1 is best."""
    y, p = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    if not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    y, p = y[order], p[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    at = int(f1.argmax())
    return float((p[at] + (p[at + 1] if at + 1 < len(p) else 0)) / 2)


def _score(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in small_batches(batches, 1):
            text, feature = features_of(texts)
            at = np.searchsorted(chain.features, feature)
            at[at == len(chain.features)] = 0
            known = chain.features[at] == feature if len(chain.features) else np.zeros(len(at), bool)
            text, at = text[known], at[known]
            found: list[np.ndarray] = []
            for i in range(len(chain.categories)):
                z = np.bincount(text, chain.weights[i][at], minlength=len(texts)) + chain.bias[i]
                for j, p in enumerate(found):
                    z = z + chain.earlier[i, j] * p
                found.append(sigmoid(z))
            flagged = found[chain.categories.index(chain.decides)] > chain.threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found), pa.array(flagged)], names=["doc_id", *(f"p_{c}" for c in chain.categories), chain.decides])

    return run


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, p_<category> for each, and a boolean named after the deciding category.

    Null and empty texts have no features and get the probabilities of the biases; texts of any length are scored whole. An
    empty table gives no rows. Repeated rows and null ids stay; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    columns = "".join(f", p_{c} double" for c in chain.categories)
    return few_rows(rows).mapInArrow(_score(chain), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}{columns}, {chain.decides} boolean")


def without(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of docs that the chain does not flag, with all their columns; scored where they are, without a shuffle."""
    names, at, score = docs.columns, docs.columns.index(text_col), _score(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in small_batches(batches, at):
            row = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(at)], names=["doc_id", "text"])
            flags = pa.concat_arrays([b.column(b.num_columns - 1) for b in score(iter([row]))])
            yield pa.RecordBatch.from_arrays(batch.filter(pa.compute.invert(flags)).columns, names=names)

    return few_rows(docs).mapInArrow(run, docs.schema)


CATEGORIES = ("low_quality", "toxic")


def labelled_chain(docs: DataFrame, labels: DataFrame, **options) -> Chain:
    """The chain low_quality, toxic from a table of labels with the columns doc_id, quality and toxic."""
    known = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return train_chain(docs, known, CATEGORIES, "toxic", **options)
