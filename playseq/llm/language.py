"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

The weights are trained with follow-the-regularised-leader and elastic-net penalties, so most
stay exactly zero; a temperature, fitted on texts that training hasn't seen, calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playseq.llm.text import mix, slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 12
#: Labelled documents that are fitted on, at most, and what share of them sets the temperature.
SAMPLE = 4000
CALIBRATION = 0.25
#: Texts counted at a time, so that the dense counts stay small.
_ROWS = 128


def _letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def ngram_counts(texts: Sequence[str | None], buckets: int = BUCKETS) -> np.ndarray:
    """How often each hashed character n-gram occurs in each lower-cased text, white space being one character."""
    parts = [" " + " ".join((t or "").lower().split()) + " " for t in texts]
    chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    text = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    counts = np.zeros(len(parts) * buckets, np.int64)
    grams = np.zeros(len(chars), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        n = len(chars) - order + 1
        if n <= 0:
            break
        grams = mix(grams[:n] * np.uint64(0x9E3779B97F4A7C15) + chars[order - 1 :] + np.uint64(order))
        if order in ORDERS:
            whole = text[:n] == text[order - 1 :]
            counts += np.bincount(text[:n][whole] * buckets + (grams[whole] >> np.uint64(40)).astype(np.int64) % buckets, minlength=len(counts))
    return counts.reshape(len(parts), buckets)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1: (1 + ln count) * idf."""
    values = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return values / np.maximum(np.sqrt((values * values).sum(1, keepdims=True)), 1e-12)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and its probability; "und" with score 0 without a letter, or if nothing was learned."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for start in range(0, len(texts), _ROWS):
            part = texts[start : start + _ROWS]
            features = tf_idf(ngram_counts(part, len(self.idf)), self.idf)
            p = softmax((features @ self.weights + self.bias) / self.temperature)
            for k, text in enumerate(part):
                if _letters(text):
                    best = int(p[k].argmax())
                    names[start + k], scores[start + k] = self.languages[best], float(p[k, best])
        return names, scores


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]],
    classes: np.ndarray,
    n_classes: int,
    buckets: int,
    *,
    epochs: int = 4,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.01,
    l2: float = 0.01,
) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate follow-the-regularised-leader on sparse rows (buckets, values); the last feature is the bias."""
    z, n = np.zeros((buckets + 1, n_classes)), np.zeros((buckets + 1, n_classes))

    def weights(at):
        small = np.abs(z[at]) <= l1
        return np.where(small, 0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.arange(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            at, values = rows[k]
            at, values = np.append(at, buckets), np.append(values, 1.0)
            w = weights(at)
            error = softmax((values @ w)[None])[0]
            error[classes[k]] -= 1
            g = values[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(buckets + 1))
    return w[:-1], w[-1]


def best_temperature(scores: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the smallest log loss, by golden-section search on its logarithm.

    Targets leave 1 / (n + 2) to the other classes, so that n texts without an error don't promise certainty.
    """
    if not len(classes):
        return 1.0

    def loss(log_t: float) -> float:
        p = np.log(np.maximum(softmax(scores / np.exp(log_t)), 1e-300))
        return float(-(p * targets).sum(1).mean())

    doubt = 1 / (len(classes) + 2)
    targets = np.full(scores.shape, doubt / max(scores.shape[1] - 1, 1))
    targets[np.arange(len(classes)), classes] = 1 - doubt
    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    while high - low > 1e-4:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(
    documents: DataFrame,
    learnable: Column,
    *,
    text: str = "text",
    lang: str = "lang",
    order: Column,
    sample: int = SAMPLE,
    buckets: int = BUCKETS,
) -> Model:
    """Learn from the documents where `learnable` holds, which have a text and a language.

    Document frequencies are counted over all of them, `sample` of them (the smallest by `order`)
    train the weights and the temperature. Counts come to the driver as one vector of `buckets`.
    """
    known = documents.filter(learnable & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), order.alias("order")
    )

    def count(batches):
        total, n = np.zeros(buckets, np.int64), 0
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            n += len(texts)
            for start in range(0, len(texts), _ROWS):
                total += (ngram_counts(texts[start : start + _ROWS], buckets) > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "df"])

    # A row for each task, summed by bucket before the result meets the driver.
    counted = known.select("text").mapInArrow(count, "n long, df array<long>")
    sums = counted.select("n", F.posexplode("df").alias("bucket", "df")).groupBy("bucket").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()
    df, n = np.zeros(buckets), 0
    for row in sums:
        df[row["bucket"]], n = row["df"], row["n"]
    idf = np.log((1 + n) / (1 + df)) + 1

    # The sample is found by its keys alone, and only its rows' texts are read again.
    last = known.select("order").orderBy("order").limit(sample).agg(F.max("order")).first()[0]
    chosen = known.filter(F.col("order") <= last).repartition(1) if last is not None else known.limit(0)

    def learn(batches):
        texts, langs, keys = [], [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            langs += batch.column("lang").to_pylist()
            keys += batch.column("order").to_pylist()
        if not texts:
            return
        by_key = sorted(range(len(texts)), key=lambda k: (keys[k], langs[k], texts[k]))[:sample]
        names = sorted({langs[k] for k in by_key})
        classes = np.array([names.index(langs[k]) for k in by_key])
        rows = []
        for start in range(0, len(by_key), _ROWS):
            for values in tf_idf(ngram_counts([texts[k] for k in by_key[start : start + _ROWS]], buckets), idf):
                at = np.flatnonzero(values)
                rows.append((at, values[at]))
        held = int(len(rows) * CALIBRATION)
        weights, bias = train_ftrl(rows[held:], classes[held:], len(names), buckets)
        scores = np.array([values @ weights[at] + bias for at, values in rows[:held]]).reshape(held, len(names))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([names], pa.list_(pa.string())),
                pa.array([weights.ravel().tolist()], pa.list_(pa.float64())),
                pa.array([bias.tolist()], pa.list_(pa.float64())),
                pa.array([best_temperature(scores, classes[:held])]),
            ],
            ["names", "weights", "bias", "temperature"],
        )

    learned = chosen.mapInArrow(learn, "names array<string>, weights array<double>, bias array<double>, temperature double").first()
    if learned is None:
        return Model([], idf, np.zeros((buckets, 0)), np.zeros(0), 1.0)
    return Model(list(learned["names"]), idf, np.array(learned["weights"]).reshape(buckets, -1), np.array(learned["bias"]), learned["temperature"])


def identify(documents: DataFrame, model: Model, *, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`row` (a struct of the `carry` columns), lang_pred and score for every document, from its whole text.

    A text that is null or has no letter is "und" with score 0.
    """
    words = documents.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(text).alias("text"))

    def predict(batches):
        for batch in slices(batches, "text"):
            names, scores = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.string()), pa.array(scores)], ["row", "lang_pred", "score"])

    return words.mapInArrow(predict, f"row {words.schema['row'].dataType.simpleString()}, lang_pred string, score double")
