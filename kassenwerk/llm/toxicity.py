"""Toxicity: a support vector machine over a gap-weighted subsequence kernel.

Texts are cut into sentences and these into words; a run of single letters counts as one
word. Two words are alike by the letter triples they share in order, each weighted by
``DECAY`` per letter that its span is longer than three, so letters put between or left out lower the likeness
but do not end it. The kernel is divided by norms that depend on length alone.

Nyström landmarks are words that stand out in toxic sentences, plus common ones. The machine
learns on their features by sub-gradient descent. A label is known for a text only, so
each toxic text deals one label out among all its words, first by their odds to stand in a toxic
text, in the next rounds by their value. Of the other texts' words it learns on a
sample, and in the next rounds on all that lie within the margin; the others have no pull.
Words are judged, not sentences: an insult made of several harmless words is not learnt. Because the kernel is an explicit sum over triples, the learnt function folds into
one weight per triple, with which tasks score each distinct word once. A text's score is
the calibrated probability of its largest word score.

Learns from a bounded sample: at most ``SAMPLE`` toxic and twice as many other labelled
texts, those with the smallest hash of their id. Null and empty texts score like a text
without any triple. Repeated rows get equal scores. Without labels of both kinds all
scores are 0. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassenwerk.llm.langid import sampled
from kassenwerk.llm.texts import runs

SAMPLE = 2000
LANDMARKS, COMMON = 48, 16
DECAY, SPAN, WIDTH = 0.5, 7, 16
LEAST = 0.7
LETTERS = 32
ROUNDS, LEAST_DEALT = 4, 1e-3  # parts of a label below LEAST_DEALT in all teach nothing measurable
SHARP = 3.0  # how much a toxic text's label goes to its words of highest value
SLICE = 2_000_000
_SENTENCE = re.compile(r"[.!?\n]+")
_SPACED = re.compile(r" \S \S ")
_SINGLES = re.compile(r"(?<!\S)(?:\S[ ]){2,}\S(?!\S)")
# Digits and signs that stand for letters.
_LEET = dict(zip("0134578@$", "oieastbas", strict=True))


class _Codes(dict):
    """Character codes: 0 for what is no letter, 1 to 26 for a to z, the rest shared by others."""

    def __missing__(self, point: int) -> int:
        c = _LEET.get(chr(point), chr(point))
        if "a" <= c <= "z":
            code = ord(c) - 96
        else:
            code = 27 + point % 5 if c.isalpha() else 0
        self[point] = code
        return code


_CODES = _Codes()


def units(text: str) -> set[str]:
    """The words of a text in lower case; runs of single characters in one sentence are joined too."""
    text = text.lower()
    found = set(text.split())
    if _SPACED.search(text):
        for sentence in _SENTENCE.split(text):
            found.update(m.group().replace(" ", "") for m in _SINGLES.finditer(sentence))
    return found


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by window of ``WIDTH`` letters, each window's word, and its length.

    Long words give overlapping windows, so nothing of them is left out.
    """
    owner, windows = [], []
    for i, word in enumerate(words):
        if len(word) <= WIDTH:
            owner.append(i)
            windows.append(word)
        else:
            for at in range(0, len(word) - WIDTH // 2, WIDTH // 2):
                owner.append(i)
                windows.append(word[at : at + WIDTH])
    sizes = np.array([len(w) for w in windows])
    codes = np.zeros((len(windows), WIDTH + SPAN), np.int32)
    flat = "".join(windows).translate(_CODES).encode("latin-1")
    codes[np.repeat(np.arange(len(windows)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.frombuffer(flat, np.uint8)
    return codes, np.array(owner), sizes


def _spans() -> list[tuple[int, int, float]]:
    return [(j, k, DECAY ** (k - 2)) for k in range(2, SPAN) for j in range(1, k)]


def _norms(sizes: np.ndarray) -> np.ndarray:
    table = np.array([sum(w * w * max(0, n - k) for _, k, w in _spans()) for n in range(WIDTH + 1)])
    return np.sqrt(np.maximum(table[np.minimum(sizes, WIDTH)], 1e-9))


def _against(codes: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Normalised sums of ``table`` (triples x columns, or triples) over each window's triples."""
    out = np.zeros((len(codes), *table.shape[1:]))
    width = int(sizes.max(initial=0))
    for j, k, weight in _spans():
        for i in range(max(0, width - k)):
            a, b, c = codes[:, i], codes[:, i + j], codes[:, i + k]
            live = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
            if len(live):
                out[live] += weight * table[(a[live] * LETTERS + b[live]) * LETTERS + c[live]]
    norms = _norms(sizes)
    return out / (norms[:, None] if table.ndim > 1 else norms)


def _entries(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triple, word and normalised weight of every triple of short words; some 200 a word."""
    codes, owner, sizes = _matrix([w[:WIDTH] for w in words])
    triples, whose, weights = [], [], []
    for j, k, weight in _spans():
        for i in range(WIDTH - k):
            a, b, c = codes[:, i], codes[:, i + j], codes[:, i + k]
            live = (a > 0) & (b > 0) & (c > 0)
            triples.append(((a * LETTERS + b) * LETTERS + c)[live])
            whose.append(owner[live])
            weights.append(np.full(int(live.sum()), weight))
    whose = np.concatenate(whose)
    return np.concatenate(triples), whose, np.concatenate(weights) / _norms(sizes)[whose]


def _triples(words: list[str]) -> np.ndarray:
    """Explicit normalised features of a few short words: triples x words."""
    out = np.zeros((LETTERS**3, len(words)))
    triple, word, weight = _entries(words)
    np.add.at(out, (triple, word), weight)
    return out


def _kernel(words: list[str], block: int = 2048) -> np.ndarray:
    """Kernel values between all pairs of words, summed over blocks of the triples that occur."""
    triple, word, weight = _entries(words)
    occurring, triple = np.unique(triple, return_inverse=True)
    order = np.argsort(triple, kind="stable")
    triple, word, weight = triple[order], word[order], weight[order]
    out = np.zeros((len(words), len(words)))
    for low in range(0, len(occurring), block):
        a, b = np.searchsorted(triple, [low, low + block])
        part = np.zeros((block, len(words)))
        np.add.at(part, (triple[a:b] - low, word[a:b]), weight[a:b])
        out += part.T @ part
    return out


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float, floor: float = 0.0):
        self.weights, self.bias, self.slope, self.shift, self.floor = weights, bias, slope, shift, floor

    def words(self, words: list[str]) -> np.ndarray:
        """The decision value of each word: that of its most toxic window."""
        codes, owner, sizes = _matrix(words)
        out = np.full(len(words), -np.inf)
        # Windows of like length share the loops over their positions.
        order = np.argsort(sizes, kind="stable")
        for part in np.array_split(order, max(1, len(order) // 4096)):
            np.maximum.at(out, owner[part], _against(codes[part], sizes[part], self.weights))
        return out + self.bias

    def probability(self, value: float) -> float:
        told = 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * value + self.shift))))
        return self.floor + (1 - self.floor) * told


NEUTRAL = Model(np.zeros(LETTERS**3), 0.0, 0.0, -50.0)


def _svm(features: np.ndarray, labels: np.ndarray, share: np.ndarray, rng, epochs: int = 30, regular: float = 1e-4) -> np.ndarray:
    """Weights and bias of a linear machine with the hinge loss; both classes weigh the same, an example by its ``share`` of its class."""
    x = np.hstack([features, np.ones((len(features), 1))])
    weigh = np.where(labels > 0, share / share[labels > 0].sum(), share / share[labels < 0].sum()) * len(labels) / 2
    w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            t += 1
            rate = 1 / (regular * (t + 1000))
            missed = labels[part] * (x[part] @ w) < 1
            pull = (weigh[part] * labels[part] * missed) @ x[part] / len(part)
            w += min(rate, 1.0) * (pull - regular * w)
            if epoch >= epochs // 2:
                mean += (w - mean) / (t - epochs // 2 * max(1, len(x) // 256) + 1)
    return mean


def _learn(texts: list[str], toxic: np.ndarray, prior: float, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    once = {t: i for i, t in enumerate(texts)}  # a copied text teaches once
    texts, toxic = list(once), toxic[list(once.values())]
    bags = [units(t) for t in texts]
    seen = {True: Counter(), False: Counter()}
    for bag, label in zip(bags, toxic, strict=True):
        seen[bool(label)].update(bag)
    n_yes, n_no = max(1, toxic.sum()), max(1, (~toxic).sum())
    # A lower bound of each word's log odds to stand in toxic texts.
    odds = {}
    for w, yes in seen[True].items():
        if len(w) > 2:
            a, b = yes + 0.5, seen[False][w] + 0.5
            odds[w] = math.log(a / n_yes) - math.log(b / n_no) - 1.64 * math.sqrt(1 / a + 1 / b)
    # Landmarks: outstanding words first, each unlike those taken before.
    ranked = sorted(odds, key=lambda w: (-odds[w], w))[: 20 * LANDMARKS]
    taken: list[int] = []
    if ranked:
        like = _kernel(ranked)
        for i in range(len(ranked)):
            if like[i, i] > 0 and all(like[i, j] < 0.8 * math.sqrt(like[i, i] * like[j, j]) for j in taken):
                taken.append(i)
            if len(taken) == LANDMARKS:
                break
    common = [w for w, _ in sorted(seen[False].items(), key=lambda x: (-x[1], x[0])) if 4 <= len(w) <= WIDTH and w.isalpha()][:COMMON]
    landmarks = [ranked[i] for i in taken] + [w for w in common if w not in ranked]
    if not landmarks:
        return NEUTRAL
    explicit = _triples(landmarks)
    values, vectors = np.linalg.eigh(explicit.T @ explicit)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T

    others = sorted(seen[False])
    others = [others[i] for i in rng.permutation(len(others))[:20_000]]
    weights, bias = np.zeros(LETTERS**3), 0.0
    # Every toxic text hands out one label among all its words, in the first round by their odds,
    # then by their value. A hinge loss feels only clean words within the margin, so
    # those found there among all of them stand for all.
    yes = sorted(odds)
    place = {w: i for i, w in enumerate(yes)}
    own = [np.array([place[w] for w in bag if w in place]) for bag, label in zip(bags, toxic, strict=True) if label]
    own = [at for at in own if len(at)]
    if not own or not others:
        return NEUTRAL
    belief, steep = np.array([odds[w] for w in yes]), SHARP
    every = sorted(set(seen[True]) | set(seen[False]))
    active = dict.fromkeys(others)
    value: dict[str, float] = {}
    for _ in range(ROUNDS):
        dealt = np.zeros(len(yes))
        for at in own:
            part = np.exp(steep * (belief[at] - belief[at].max()))
            dealt[at] += part / part.sum()
        live = [i for i in np.argsort(-dealt, kind="stable") if dealt[i] > LEAST_DEALT]
        no = list(active)
        codes, owner, sizes = _matrix([*[yes[i] for i in live], *no])
        features = _against(codes, sizes, explicit) @ root
        share = np.concatenate([dealt[live], np.sqrt([seen[False][w] for w in no])])[owner]
        found = _svm(features, np.where(owner < len(live), 1.0, -1.0), share, rng)
        weights, bias = explicit @ (root @ found[:-1]), float(found[-1])
        value = dict(zip(every, Model(weights, bias, 1, 0).words(every).tolist(), strict=True))
        belief, steep = np.array([value[w] for w in yes]), SHARP
        active.update(dict.fromkeys(w for w in sorted(seen[False]) if value[w] > -1))
    top = np.array([max((value[w] for w in bag), default=bias) for bag in bags])
    slope, shift, floor = _calibrate(top, toxic, prior)
    return Model(weights, bias, slope, shift, floor)


def _calibrate(x: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Slope and shift of a logistic curve above a floor, weighted to the corpus' share of toxic texts.

    The floor is the share of toxic texts among those without a telling word: without it, such
    texts would flatten the curve where telling words lie. Found by expectation steps (which
    toxic texts are told by their words) around Newton steps.
    """
    weigh = np.where(toxic, prior / max(1, toxic.sum()), (1 - prior) / max(1, (~toxic).sum())) * len(x)
    design = np.stack([x, np.ones_like(x)], 1)
    theta, floor = np.array([1.0, 0.0]), prior / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -40, 40)))
        y = np.where(toxic, p / np.maximum(p + (1 - p) * floor, 1e-12), 0.0)
        floor = float((weigh * (toxic - y)).sum() / max(1e-12, (weigh * (1 - y)).sum()))
        for _ in range(10):
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -40, 40)))
            gradient = design.T @ (weigh * (y - p)) - 1e-2 * theta
            curve = (design * (weigh * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
            step = np.linalg.solve(curve, gradient)
            theta = theta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
    return float(theta[0]), float(theta[1]), floor


def train(docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE) -> Model:
    """Learns from labelled texts whose ids satisfy ``learn``; ids are drawn before texts are read."""
    known = labels.filter(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") == 1).alias("yes"))
    totals = {r["yes"]: r["n"] for r in known.groupBy("yes").agg(F.count("*").alias("n")).collect()}
    if set(totals) != {True, False}:
        return NEUTRAL
    chosen = sampled(known.filter("yes"), sample).limit(2 * sample).unionByName(sampled(known.filter("NOT yes"), 2 * sample).limit(4 * sample))
    # At most six times ``sample`` ids.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen.groupBy("doc_id").agg(F.max("yes").alias("yes"))), "doc_id").orderBy("doc_id").limit(12 * sample).collect()
    toxic = np.array([r["yes"] for r in found], bool)
    if not toxic.any() or toxic.all():
        return NEUTRAL
    return _learn([r["text"] or "" for r in found], toxic, totals[True] / (totals[True] + totals[False]))


_SCORES_KEPT = 400_000


def score(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` and the witness word of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            scores, words = [], []
            for a, b in runs([len(t) for t in texts], SLICE):
                bags = [units(t) for t in texts[a:b]]
                if len(known) > _SCORES_KEPT:
                    known = {}
                new = list(set().union(*bags).difference(known))
                if new:
                    known.update(zip(new, model.words(new).tolist(), strict=True))
                for bag in bags:
                    top = max(bag, key=known.__getitem__, default=None)
                    scores.append(model.probability(model.bias if top is None else known[top]))
                    words.append(top)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= least) for s in scores], pa.int32()),
                    pa.array([w if s >= least else None for w, s in zip(words, scores, strict=True)], pa.string()),
                ],
                ["doc_id", "score", "predicted", "witness"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double, predicted int, witness string")
