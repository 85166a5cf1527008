"""Toxic spans by a linear-chain conditional random field.

Labels are given per document.  A bounded sample of labelled documents yields lexical
features (words and word beginnings) whose presence goes with the label; tokens of toxic
documents that carry one are the labelled toxic tokens.  A two-state chain is trained on
these sequences, and forward-backward marginals of every token give the offending offsets
and, calibrated, the score of the document.

Scoring runs where the texts are read.  Tokens without a known feature all have the same
potential, so runs of them are a matrix power and only tokens with features are visited.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.common import whole_text
from lectern.session import materialize

#: Labelled documents the model is fitted on, at most; which ones is decided by a hash of the id.
SAMPLE_ROWS = 8192
#: Stretches with features that the chain is trained on, at most, chosen by a hash; the others count by length.
SAMPLE_CHUNKS = 32_768
#: Features the model may hold, those that go with the label most.
MAX_FEATURES = 4096
#: Lengths of the word beginnings that serve as features beside the whole word.
BEGINNINGS = range(4, 9)
#: Least documents and log-likelihood ratio of a feature, and least share of toxic ones among its documents.
MIN_DOCUMENTS, MIN_RATIO, MIN_SHARE = 4, 20.0, 0.7
#: Tokens of a training sequence; longer documents give several.
CHUNK = 64
#: A token is part of an offending span from this marginal on.
SPAN_MARGINAL = 0.5
TOXIC_SCORE = 0.7
#: Words whose features a worker remembers before it starts afresh.
MEMO_WORDS = 500_000
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())

SCORED = "doc_id long, score double, predicted int, n_toxic_tokens double, spans string"


def word_features(word: str) -> list[str]:
    """The whole word and its beginnings, marks around it removed and in lower case."""
    core = word.strip(MARKS).lower()
    return [f"={core}", *[core[:n] for n in BEGINNINGS if n <= len(core)]] if core else []


class Chain:
    """Forward-backward over a chain in which only some tokens have features."""

    def __init__(self, bias: float, transition: tuple[float, ...]):
        self.bias = bias
        self.t = np.exp(np.array(transition)).reshape(2, 2)
        self.neutral = np.array([1.0, math.exp(bias)])
        values, vectors = np.linalg.eig(self.t * self.neutral)  # one step to a token without features
        order = np.argsort(-values.real)
        self.vectors = vectors.real[:, order]
        self.values = values.real[order] / values.real[order[0]]
        self.inverse = np.linalg.inv(self.vectors)

    def run(self, n: int) -> np.ndarray:
        """``n`` steps over tokens without features."""
        return (self.vectors * self.values**n) @ self.inverse

    def marginals(self, length: int, places: list[int], scores: list[float]) -> list[float]:
        """P(toxic) of the tokens at ``places``, which have these feature scores, in a chain of ``length`` tokens."""
        local = [np.array([1.0, math.exp(min(self.bias + s, 50.0))]) for s in scores]
        forward: list[np.ndarray] = []
        for k, place in enumerate(places):
            if k:
                ahead = (forward[-1] @ self.run(place - places[k - 1] - 1)) @ self.t
            else:
                ahead = (self.neutral @ self.run(place - 1)) @ self.t if place else np.ones(2)
            now = ahead * local[k]
            forward.append(now / now.sum())
        result = [0.0] * len(places)
        if places:
            backward = self.run(length - 1 - places[-1]) @ np.ones(2)
        for k in range(len(places) - 1, -1, -1):
            both = forward[k] * backward
            result[k] = float(both[1] / both.sum())
            if k:
                backward = self.run(places[k] - places[k - 1] - 1) @ (self.t @ (local[k] * backward))
                backward = backward / backward.sum()
        return result


@dataclass
class Model:
    """``weights`` of the features, ``bias`` of the toxic state, ``transition`` scores, ``calibration`` of documents."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    transition: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    calibration: tuple[float, ...] = (-3.0, 0.0, 0.0)

    def chain(self) -> Chain:
        return Chain(self.bias, self.transition)

    def score(self, marginals: list[float]) -> float:
        return 1 / (1 + math.exp(-float(np.dot(self.calibration, document_features(marginals)))))


def document_features(marginals: list[float]) -> tuple[float, float, float]:
    """A constant, the largest marginal and the logarithm of one plus the expected toxic tokens."""
    return 1.0, max(marginals, default=0.0), math.log1p(sum(marginals))


def _ratio(a: Column, b: Column, share: float) -> Column:
    """Log-likelihood ratio of a feature's presence in toxic documents, 0 unless these hold more than their share."""
    part = lambda n, of: F.when(n > 0, n * F.log(n / ((a + b) * of))).otherwise(0.0)
    return F.when(a > (a + b) * share, 2 * (part(a, share) + part(b, 1 - share))).otherwise(0.0)


@dataclass
class Chunks:
    """Stretches of at most ``CHUNK`` tokens, as arrays.

    Stretch ``i`` has ``length[i]`` tokens, counts ``weight[i]`` times and is of a toxic
    document if ``toxic[i]``; entry ``j`` says that token ``place[j]`` of stretch ``of[j]``
    (ascending) has the feature ``feature[j]``.
    """

    length: np.ndarray
    weight: np.ndarray
    toxic: np.ndarray
    of: np.ndarray
    place: np.ndarray
    feature: np.ndarray

    def blocks(self, size: int = 2048) -> Iterator[Chunks]:
        for low in range(0, len(self.length), size):
            start, end = np.searchsorted(self.of, [low, low + size])
            part = slice(low, low + size)
            yield Chunks(self.length[part], self.weight[part], self.toxic[part], self.of[start:end] - low, self.place[start:end], self.feature[start:end])


def _expectations(block: Chunks, w: np.ndarray, bias: float, t: np.ndarray) -> np.ndarray:
    """Observed less expected counts of features, toxic tokens and steps in a block."""
    n, weight = len(block.length), block.weight.astype(float)
    cells = block.of * CHUNK + block.place
    truth = np.zeros(n * CHUNK, bool)
    truth[cells[block.toxic[block.of]]] = True
    truth = truth.reshape(n, CHUNK)
    valid = np.arange(CHUNK)[None, :] < block.length[:, None]
    pair_valid = valid[:, 1:] & valid[:, :-1]
    y = truth.astype(int)
    steps = np.zeros((2, 2))
    np.add.at(steps, (y[:, :-1][pair_valid], y[:, 1:][pair_valid]), np.broadcast_to(weight[:, None], pair_valid.shape)[pair_valid])
    score = np.bincount(cells, weights=w[block.feature], minlength=n * CHUNK).reshape(n, CHUNK) + bias
    local = np.where(valid, np.exp(np.clip(score, -50, 50)), 1.0)
    alpha, beta = np.empty((CHUNK, n, 2)), np.empty((CHUNK, n, 2))
    alpha[0] = np.stack([np.ones(n), local[:, 0]], 1)
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for i in range(1, CHUNK):
        a = alpha[i - 1] @ t
        a[:, 1] *= local[:, i]
        alpha[i] = np.where(valid[:, i, None], a / a.sum(1, keepdims=True), alpha[i - 1])
    beta[-1] = 1.0
    for i in range(CHUNK - 2, -1, -1):
        ahead = beta[i + 1].copy()
        ahead[:, 1] *= local[:, i + 1]
        back = ahead @ t.T
        beta[i] = np.where(valid[:, i + 1, None], back / back.sum(1, keepdims=True), beta[i + 1])
        joint = alpha[i][:, :, None] * t[None] * ahead[:, None, :]
        joint *= (weight / joint.sum((1, 2)))[:, None, None]
        steps -= joint[pair_valid[:, i]].sum(0)
    p = alpha * beta
    p = (p[:, :, 1] / p.sum(2)).T
    residual = np.where(valid, truth - p, 0.0) * weight[:, None]
    return np.concatenate(
        [np.bincount(block.feature, weights=residual.reshape(-1)[cells], minlength=len(w)), [residual.sum()], steps.reshape(-1)]
    )


def train_chain(chunks: Chunks, n_features: int, rounds: int = 60, penalty: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximum conditional likelihood by Adam over forward-backward gradients, summed block by block.

    Tokens with features in toxic documents are the toxic ones.
    """
    total = float((chunks.length * chunks.weight).sum())
    parameters = np.concatenate([np.zeros(n_features), [-3.0], np.zeros(4)])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    for r in range(1, rounds + 1):
        w, b, t = parameters[:n_features], parameters[n_features], np.exp(parameters[n_features + 1 :]).reshape(2, 2)
        gradient = sum(_expectations(block, w, b, t) for block in chunks.blocks())
        gradient = gradient / total * 1000 - penalty * parameters
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        parameters = parameters + 0.3 * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.99**r)) + 1e-8)
    return parameters[:n_features], float(parameters[n_features]), parameters[n_features + 1 :]


def calibrate(features: np.ndarray, labels: np.ndarray, penalty: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small ridge."""
    w = np.zeros(features.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-features @ w))
        hessian = (features * (p * (1 - p))[:, None]).T @ features + penalty * np.eye(len(w))
        w = w + np.linalg.solve(hessian, features.T @ (labels - p) - penalty * w)
    return tuple(map(float, w))


def _signature(words: list[str]) -> int:
    """The least hash over three-word shingles: near copies mostly agree in it."""
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` rows of ``labels`` (doc_id, toxic) and their texts.

    Rows without label or id are left out; of several labels of an id the largest counts.
    Of near copies one is used.  With no rows, or a single class, the model holds no
    features and scores every text with the share of toxic rows.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_signature(t.split()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], names=["doc_id", "text", "toxic", "signature"])

    # The sample is bounded, so it is broadcast and the texts stay where they are read.
    sample = materialize(
        texts.join(F.broadcast(chosen), "doc_id")
        .mapInArrow(sign, "doc_id long, text string, toxic int, signature long")
        .dropDuplicates(["signature", "toxic"])
    )
    sizes = {r.toxic: r["count"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    positives, negatives = sizes.get(1, 0), sizes.get(0, 0)
    prior = (positives + 0.5) / (positives + negatives + 1)
    blank = Model(calibration=(math.log(prior / (1 - prior)), 0.0, 0.0))
    if not positives or not negatives:
        return blank

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[toxic > 0].update({f for w in set(text.split()) for f in word_features(w)})
            names = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([found[1][f] for f in names], pa.int64()), pa.array([found[0][f] for f in names], pa.int64())],
                names=["feature", "a", "b"],
            )

    share = positives / (positives + negatives)
    names = [
        r.feature
        for r in sample.select("text", "toxic")
        .mapInArrow(count, "feature string, a long, b long")
        .groupBy("feature")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .where((F.col("a") >= MIN_DOCUMENTS) & (F.col("a") >= MIN_SHARE * (F.col("a") + F.col("b"))))
        .withColumn("ratio", _ratio(F.col("a"), F.col("b"), share))
        .where(F.col("ratio") >= MIN_RATIO)
        .orderBy(F.desc("ratio"), F.desc("feature"))
        .limit(MAX_FEATURES)
        .collect()
    ]
    if not names:
        return blank
    index = {f: i for i, f in enumerate(names)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            neutral: Counter = Counter()
            rows: list[tuple[int, int, bool, list[int], list[int]]] = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.split()
                for low in range(0, len(words), CHUNK):
                    chunk = words[low : low + CHUNK]
                    active = [(i, index[f]) for i, w in enumerate(chunk) for f in word_features(w) if f in index]
                    if active:
                        rows.append((len(chunk), 1, toxic > 0, [i for i, _ in active], [f for _, f in active]))
                    else:
                        neutral[len(chunk)] += 1
            rows += [(length, times, False, [], []) for length, times in neutral.items()]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["length", "weight", "toxic", "places", "features"])

    encoded = materialize(
        sample.select("text", "toxic").mapInArrow(encode, "length int, weight long, toxic boolean, places array<int>, features array<int>")
    )
    # Stretches without features are alike but for their length; of the others a bounded number is taken.
    plain = encoded.where(F.size("places") == 0).groupBy("length").agg(F.sum("weight").alias("weight"))
    plain = plain.select("length", "weight", F.lit(False).alias("toxic"), F.array().cast("array<int>").alias("places"), F.array().cast("array<int>").alias("features"))
    active = encoded.where(F.size("places") > 0).orderBy(F.xxhash64("toxic", "places", "features"), "length").limit(SAMPLE_CHUNKS)
    table = plain.orderBy("length").unionByName(active).toArrow()
    lists = table["places"].combine_chunks(), table["features"].combine_chunks()
    chunks = Chunks(
        table["length"].to_numpy().astype(np.int64), table["weight"].to_numpy(), table["toxic"].to_numpy(),
        np.repeat(np.arange(len(table)), table["places"].combine_chunks().value_lengths().to_numpy()),
        *(column.flatten().to_numpy().astype(np.int64) for column in lists),
    )
    weights, bias, transition = train_chain(chunks, len(names))
    model = Model(dict(zip(names, map(float, weights))), bias, tuple(map(float, transition)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [document_features(scorer.marginals(text.split())[1]) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()), batch.column(1)],
                names=["most", "mass", "toxic"],
            )

    # Three numbers for each of at most `sample_rows` documents.
    seen = sample.where("text <> ''").select("text", "toxic").mapInArrow(describe, "most double, mass double, toxic int").toArrow()
    given = np.stack([np.ones(len(seen)), seen["most"].to_numpy(), seen["mass"].to_numpy()], 1)
    model.calibration = calibrate(given, (seen["toxic"].to_numpy() > 0).astype(float))
    return model


class Scorer:
    """Scores texts one by one; keeps what it has learnt about words."""

    def __init__(self, model: Model):
        self.model, self.chain = model, model.chain()
        self.memo: dict[str, float | None] = {}

    def marginals(self, words: list[str]) -> tuple[list[int], list[float]]:
        """Places of the tokens with features and their marginals."""
        weights, memo = self.model.weights, self.memo
        distinct = set(words)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for word in distinct:
            if word not in memo:
                own = [weights[f] for f in word_features(word) if f in weights]
                memo[word] = sum(own) if own else None
        if not any(memo[w] is not None for w in distinct):
            return [], []
        places = [i for i, w in enumerate(words) if memo[w] is not None]
        return places, self.chain.marginals(len(words), places, [memo[words[i]] for i in places])

    def __call__(self, text: str) -> tuple[float, float, str]:
        """The document's score, its expected toxic tokens and the offending spans."""
        places, found = self.marginals(text.split())
        marked = {i: p for i, p in zip(places, found) if p >= SPAN_MARGINAL}
        spans = [
            f"{m.start()}:{m.end()}:{marked[i]:.3f}" for i, m in enumerate(re.finditer(r"\S+", text)) if i in marked
        ] if marked else []
        return self.model.score(found), float(sum(found)), ",".join(spans)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text; other columns are ignored).

    A null text is empty and has no tokens; rows that repeat give equal rows; no documents
    give no rows.  Returns doc_id, score, predicted, n_toxic_tokens (the expected number
    among tokens with features) and spans: start:end:marginal of the offending tokens in
    code points, comma-joined.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer(text) for text in batch.column(1).to_pylist()]
            values = [v for v, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(values, pa.float64()),
                    pa.array([int(v >= TOXIC_SCORE) for v in values], pa.int32()),
                    pa.array([n for _, n, _ in found], pa.float64()),
                    pa.array([s for _, _, s in found], pa.string()),
                ],
                names=["doc_id", "score", "predicted", "n_toxic_tokens", "spans"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text")).mapInArrow(score, SCORED)


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether the checksum of the id's decimal text falls into the held-out fold."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all ``docs`` by a model fitted on the labels outside the held-out fold."""
    return score_texts(docs, fit(docs, labels.where(~held_out()))).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted", "n_toxic_tokens", "spans"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns unchanged; nothing is shuffled."""
    model = fit(docs, labels.where(~held_out()))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            clean = [scorer(text or "")[0] < TOXIC_SCORE for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
