"""Language identification: averaged embeddings of hashed character n-grams, a linear softmax.

The model is trained by stochastic gradient descent in numpy on a bounded sample of labelled
documents (``SAMPLE`` rows, those with the smallest hash of their id). A temperature, fitted
on a part of the sample kept aside, calibrates the probabilities; ``rejected`` marks
documents whose calibrated probability is below the least one at which the accepted documents of
that part reach the wished accuracy.

Null texts and texts without a letter are ``und`` with score 0 and rejected. Rows without a
language are predicted but never learnt from, as are rows without id. Repeated rows get
equal answers. With no or one learnt language every text gets it (``und`` if there is
none). An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassenwerk.llm.texts import mix, runs

SAMPLE = 4000
BITS, DIMENSIONS, EPOCHS, RATE = 15, 16, 6, 0.5
ACCURACY = 0.995
SLICE = 1_000_000  # characters worked on at once


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all character bigrams and trigrams of words; where each text's begin; how many; letters seen.

    A text is lower-cased, and other characters than letters are word ends.
    """
    points = [np.frombuffer((" " + t.lower() + "  ").encode("utf-32-le", "replace"), np.uint32) for t in texts]
    x = np.concatenate([*points, np.full(2, 32, np.uint32)])
    is_letter = _letters()[x]
    x[~is_letter] = 32
    x = x.astype(np.uint64)
    two = mix(x[:-1] * np.uint64(0x1F3D5B79) + x[1:])[:-1]
    three = mix((x[:-2] * np.uint64(0x1F3D5B79) + x[1:-1]) * np.uint64(0x9E3779B1) + x[2:] + np.uint64(7))
    shift = np.uint64(64 - BITS)
    # The last places of a text see the space that the next one, or the end, begins with.
    sizes = np.array([len(p) for p in points])
    starts = np.cumsum(sizes) - sizes
    grams = np.stack([two >> shift, three >> shift]).astype(np.int64)
    return grams, starts, sizes, np.logical_or.reduceat(is_letter, starts)


class Model:
    """Class scores per bucket: the product of embeddings and softmax weights."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.languages, self.table, self.bias = languages, table, bias
        self.temperature, self.least = temperature, least

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities, and whether a text has a letter."""
        grams, starts, sizes, letters = _grams(texts)
        sums = np.empty((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            column = np.ascontiguousarray(self.table[:, k])
            sums[:, k] = np.add.reduceat(column[grams[0]] + column[grams[1]], starts)
        logits = (sums / (2 * sizes[:, None]) + self.bias) / self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), letters


def _train(texts: list[str], labels: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    k = len(languages)
    docs = []
    for text in texts:
        buckets, counts = np.unique(_grams([text])[0], return_counts=True)
        docs.append((buckets, counts / counts.sum()))
    embed = rng.normal(0, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS))
    weights, bias = np.zeros((DIMENSIONS, k)), np.zeros(k)
    kept = rng.random(len(docs)) < 0.8
    order = np.flatnonzero(kept)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(order):
            buckets, share = docs[i]
            hidden = share @ embed[buckets]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = weights @ p
            weights -= rate * np.outer(hidden, p) * DIMENSIONS
            bias -= rate * 0.1 * p
            embed[buckets] -= rate * DIMENSIONS * share[:, None] * back
    table = embed @ weights
    aside = np.flatnonzero(~kept)
    if not len(aside):
        return Model(languages, table, bias, 1.0, 0.0)
    z = np.array([docs[i][1] @ table[docs[i][0]] + bias for i in aside])

    def of(t: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    right = labels[aside]
    loss = {t: -np.log(of(t)[np.arange(len(aside)), right] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
    temperature = min(loss, key=loss.get)
    p = of(temperature)
    best = np.argsort(-p.max(1))
    hits = np.cumsum(p.argmax(1)[best] == right[best]) / np.arange(1, len(best) + 1)
    good = np.flatnonzero(hits >= ACCURACY)
    least = float(p.max(1)[best][good[-1]]) if len(good) else 1.0
    return Model(languages, table, bias, float(temperature), least)


def sampled(df: DataFrame, most: int) -> DataFrame:
    """The rows with the smallest hashes of ``doc_id``: the cut is found on ids alone."""
    key = F.xxhash64("doc_id")
    cut = df.select(key.alias("h")).orderBy("h").limit(most).agg(F.max("h").alias("h")).first()["h"]
    return df.filter(key <= F.lit(cut)) if cut is not None else df.limit(0)


def train(df: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """Learns from a sample of the rows for which ``learn`` holds and that name a language."""
    rows = df.filter(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = sampled(rows, sample).select("doc_id", "text", "lang").orderBy("doc_id").limit(2 * sample).collect()
    languages = sorted({r["lang"] for r in found})
    if len(languages) < 2:
        return Model(languages or ["und"], np.zeros((1 << BITS, 1)), np.zeros(1), 1.0, 0.0)
    index = {x: i for i, x in enumerate(languages)}
    return _train([r["text"] for r in found], np.array([index[r["lang"]] for r in found]), languages)


def predict(df: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``rejected`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages, object)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            pred, score = [], []
            for a, b in runs([len(t) + 3 for t in texts], SLICE):
                p, letters = model.probabilities(texts[a:b])
                pred += np.where(letters, names[p.argmax(1)], "und").tolist()
                score += np.where(letters, p.max(1), 0.0).tolist()
            low = [s < model.least for s in score]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    narrow = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
