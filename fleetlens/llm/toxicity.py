"""Toxicity scores: a linear classifier from positive and unlabelled texts."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.texts import byte_words, in_pieces

_EDGES = b".,;:!?\"'()[]{}<>*|#$%&"


@dataclass(frozen=True)
class ToxicityRules:
    """Parameters of features and training.

    ``positives`` and ``unlabelled`` bound the texts that the classifier is fitted on;
    those whose hashed ids come first are taken. ``folds`` and ``held_out`` name the
    rows that training never sees: those whose checksum of the id leaves that rest. A
    feature is used if ``least_seen`` positives have it and their number lies more than
    ``least_excess`` standard deviations above what its share of unlabelled texts gives.
    """

    features: int = 1 << 18
    positives: int = 2_000
    unlabelled: int = 6_000
    folds: int = 5
    held_out: int = 0
    least_seen: int = 5
    least_excess: float = 4.0
    epochs: int = 30
    batch: int = 400
    least_steps: int = 20
    step: float = 0.05
    decay: float = 1e-2
    seed: int = 7


def features(text: str, size: int) -> np.ndarray:
    """The distinct hashed words of a text, without marks around them; A-Z count as a-z."""
    words = {word.strip(_EDGES) for word in byte_words(text.encode().lower())}
    words.discard(b"")
    found = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % size
    return np.unique(found)


@dataclass(frozen=True)
class LinearModel:
    """Weights of the chosen features (sorted) and a bias."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, found: np.ndarray) -> float:
        return float(self.weights[_places(found, self.chosen)].sum()) + self.bias


def _places(found: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places in ``chosen`` of the features that it has."""
    if not len(chosen):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(chosen, found), len(chosen) - 1)
    return at[chosen[at] == found]


def choose_features(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], rules: ToxicityRules
) -> np.ndarray:
    """Features that positives have clearly more often than unlabelled texts."""
    seen_p, seen_u = (
        np.bincount(np.concatenate(sets), minlength=rules.features) for sets in (positive, unlabelled)
    )
    share = (seen_u + 0.5) / (len(unlabelled) + 1)
    expected = share * len(positive)
    excess = (seen_p - expected) / np.sqrt(expected * np.maximum(1 - share, 1e-6))
    return np.flatnonzero((seen_p >= rules.least_seen) & (excess > rules.least_excess))


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges, some of which may be empty."""
    running = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return running[starts + sizes] - running[starts]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_non_negative_pu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rules: ToxicityRules
) -> LinearModel:
    """Minimise the non-negative positive-unlabelled risk by Adam.

    The risk is prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]) with the
    logistic loss l. Where the second part of a batch is negative, the step goes
    against it, which keeps the model from fitting unlabelled texts as negatives.
    """
    rng = np.random.default_rng(rules.seed)
    chosen = choose_features(positive, unlabelled, rules)
    positive = [_places(found, chosen) for found in positive]
    unlabelled = [_places(found, chosen) for found in unlabelled]
    weights = np.zeros(len(chosen) + 1)
    weights[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    n_steps = max(rules.least_steps, -(-len(unlabelled) // rules.batch))
    t = 0
    for epoch in range(rules.epochs):
        n_p, n_u = (min(len(sets), rules.batch) for sets in (positive, unlabelled))
        rate = rules.step * (1 - epoch / rules.epochs)
        for _ in range(n_steps):
            rows_p = rng.choice(len(positive), n_p, replace=False)
            rows_u = rng.choice(len(unlabelled), n_u, replace=False)
            rows = [positive[i] for i in rows_p] + [unlabelled[i] for i in rows_u]
            sizes = np.array([len(r) for r in rows])
            starts = np.cumsum(sizes) - sizes
            index = np.concatenate(rows)
            p = _sigmoid(_sums(weights[index], starts, sizes) + weights[-1])
            of_p, of_u = p[:n_p], p[n_p:]
            losses_u, losses_p = -np.log1p(-of_u), -np.log1p(-of_p)
            pull = np.zeros(len(rows))
            negative_risk = losses_u.mean() - prior * losses_p.mean()
            if negative_risk >= 0:
                pull[:n_p] = prior * (of_p - 1) / n_p - prior * of_p / n_p
                pull[n_p:] = of_u / n_u
            else:
                pull[:n_p] = prior * of_p / n_p
                pull[n_p:] = -of_u / n_u
            slope = np.bincount(index, np.repeat(pull, sizes), len(weights)).astype(np.float64)
            slope += rules.decay * weights / n_steps
            slope[-1] = pull.sum()
            t += 1
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope**2
            weights -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return LinearModel(chosen, weights[:-1], float(weights[-1]))


def _fold(rules: ToxicityRules):
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % rules.folds


def _first_ids(ids: DataFrame, limit: int, salt: str) -> DataFrame:
    """A bounded, repeatable choice of ids."""
    distinct = ids.select("doc_id").distinct()
    return distinct.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> LinearModel | None:
    """Fit on confirmed toxic texts and on texts taken whatever their label.

    The class prior is the share of toxic ones among the labelled training rows.
    Returns None if there are no confirmed toxic texts outside the held-out fold.
    """
    usable = F.col("doc_id").isNotNull() & (_fold(rules) != rules.held_out)
    known = labels.select("doc_id", "toxic").filter(usable & F.col("toxic").isNotNull())
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not prior:
        return None
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    positive = _first_ids(known.filter("toxic = 1"), rules.positives, "positive")
    unlabelled = _first_ids(texts.filter(usable), rules.unlabelled, "unlabelled")
    chosen = (
        positive.withColumn("role", F.lit(1))
        .unionByName(unlabelled.withColumn("role", F.lit(0)))
        .groupBy("doc_id")
        .agg(F.max("role").alias("positive"), F.min("role").alias("least"))
    )

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(text or "", rules.features) for text in batch.column("text").to_pylist()]
        columns = [batch.column("positive"), batch.column("least"), pa.array(found, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["positive", "least", "found"])

    joined = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    schema = "positive INT, least INT, found ARRAY<BIGINT>"
    rows = in_pieces(joined, describe, schema).toPandas()
    sets = [np.asarray(found, np.int64) for found in rows["found"]]
    of_p = [s for s, flag in zip(sets, rows["positive"], strict=True) if flag == 1]
    of_u = [s for s, flag in zip(sets, rows["least"], strict=True) if flag == 0]
    if not of_p or not of_u:
        return None
    return train_non_negative_pu(of_p, of_u, min(prior, 0.99), rules)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text.

    The score is 0 to 1; 0.5 and more predicts toxic. It depends on the text alone. A
    null or empty text gets the score of a text without words. With no confirmed toxic
    text to learn from, all scores are 0. Repeated rows each give a row; a null id is
    not held out. Building it fits the classifier on a bounded choice of texts.
    """
    model = fit(docs, labels, rules)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        if model is None:
            scores = np.zeros(len(texts))
        else:
            logits = [model.logit(features(text or "", rules.features)) for text in texts]
            scores = _sigmoid(np.array(logits))
        arrays = [batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    scored = in_pieces(texts, score, "doc_id BIGINT, score DOUBLE, predicted INT")
    held_out = F.coalesce(_fold(rules) == rules.held_out, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
