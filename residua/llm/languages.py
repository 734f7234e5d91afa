"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are its byte n-grams (2 to 4 bytes of the lower-cased text, a space at both ends), hashed to BUCKETS.
The embeddings of all of them are averaged and go through a linear softmax.  Both are trained in numpy by stochastic
gradient descent with momentum on a bounded sample: PER_CLASS labelled texts of each language, and of each text
PIECES pieces of PIECE bytes, spread over it.  A fifth of the sample is held back: it sets the temperature that makes
probabilities honest, and the probability under which a prediction is rejected, so that it loses 1 in 100 right ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import bounded_sample, col, fresh
from .texts import append, encode, give_back, slices

BUCKETS, DIMENSION, GRAMS = 1 << 13, 16, (2, 3, 4)
#: Bounds of the training sample.
PER_CLASS, PIECES, PIECE = 500, 4, 512
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def grams(blobs: list[bytes]) -> np.ndarray:
    """Counts of each text's hashed n-grams, a row per text."""
    out = np.zeros((len(blobs), BUCKETS), dtype=np.float32)
    for a, b in slices(blobs, 1 << 18):
        lens = np.array([len(x) + 2 for x in blobs[a:b]])
        x = np.frombuffer(b"".join(b" " + t + b" " for t in blobs[a:b]), dtype=np.uint8).astype(np.uint32)
        own = np.repeat(np.arange(b - a), lens)
        ends = np.repeat(np.cumsum(lens), lens) - np.arange(len(x))  # bytes from here to the end of the text
        h = x * np.uint32(0x9E3779B1)
        for n in range(2, max(GRAMS) + 1):
            h = (h[: len(x) - n + 1] ^ x[n - 1 :]) * np.uint32(0x85EBCA6B)
            if n in GRAMS:
                ok = ends[: len(h)] >= n
                code = ((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(19)).astype(np.int64) & (BUCKETS - 1)
                flat = np.bincount((own[: len(h)] * BUCKETS + code)[ok], minlength=(b - a) * BUCKETS)
                out[a:b] += flat.reshape(b - a, BUCKETS)
    return out


def averaged(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def spread(data: bytes, pieces: int = PIECES, size: int = PIECE) -> bytes:
    """The whole text, or ``pieces`` pieces of ``size`` bytes at equal distances from its first byte to its last."""
    if len(data) <= pieces * size:
        return data
    at = np.linspace(0, len(data) - size, pieces).astype(int)
    return b" ".join(data[k : k + size] for k in at)


@dataclass
class Model:
    classes: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), dtype=np.float32))  # embedding times softmax matrix
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, blobs: list[bytes]) -> np.ndarray:
        out = [averaged(grams(blobs[k : k + 64])) @ self.weights + self.bias for k in range(0, len(blobs), 64)]
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)), dtype=np.float32)

    def probabilities(self, blobs: list[bytes]) -> np.ndarray:
        return softmax(self.logits(blobs).astype(np.float64) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(blobs: list[bytes], labels: list[str], epochs: int = 60, rate: float = 20.0, seed: int = 7) -> Model:
    """Every fifth example is for calibration."""
    classes = sorted(set(labels))
    if not classes:
        return Model()
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(blobs))
    held = order[::5] if len(order) >= 50 else order[:0]
    fit = np.setdiff1d(order, held)
    y = np.array([classes.index(v) for v in labels])
    x = np.concatenate([averaged(grams(blobs[k : k + 64])) for k in range(0, len(blobs), 64)])
    embed = rng.normal(0, 1, (BUCKETS, DIMENSION)).astype(np.float32) / np.sqrt(DIMENSION)
    out, bias = np.zeros((DIMENSION, len(classes)), dtype=np.float32), np.zeros(len(classes), dtype=np.float32)
    speed = [np.zeros_like(embed), np.zeros_like(out), np.zeros_like(bias)]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        mix = rng.permutation(fit)
        for k in range(0, len(mix), 64):
            rows = mix[k : k + 64]
            hidden = x[rows] @ embed
            g = softmax(hidden @ out + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g = (g / len(rows)).astype(np.float32)
            grads = [x[rows].T @ (g @ out.T), hidden.T @ g, g.sum(axis=0)]
            for p, v, d, r in zip((embed, out, bias), speed, grads, (step, step / 20, step / 20), strict=True):
                v *= 0.9
                v -= r * d
                p += v
    model = Model(classes, (embed @ out).astype(np.float32), bias)
    if len(held):
        z, own = (x[held] @ model.weights + bias).astype(np.float64), y[held]
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(held)), own] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
        p = softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == own]
        model.least = float(np.sort(right)[int(0.01 * len(right))]) if len(right) else 0.0
    return model


def fit(docs: DataFrame, id_col="doc_id", text_col="text", label_col="lang", per_class: int = PER_CLASS) -> Model:
    """Learn from labelled rows; the sample's pieces are what reaches the driver: at most per_class * PIECES * PIECE bytes a language, of CLASSES languages at most.

    Rows with equal ids, or none, are told apart by their texts; equal rows count once.
    """
    rows = docs.filter(col(label_col).isNotNull() & col(text_col).isNotNull())
    x = bounded_sample(rows, label_col, [id_col, text_col], per_class).select(col(id_col).alias("id"), col(label_col).alias("label"), col(text_col).alias("text"))
    x = append(x, ["text"], lambda texts: [[spread(encode(t.lower())) for t in texts]], [("piece", "binary")], drop=("text",))
    found = sorted((str(r["label"]), str(r["id"]), bytes(r["piece"])) for r in x.collect())
    model = train([p for *_, p in found], [v for v, *_ in found])
    give_back()
    return model


def identify(docs: DataFrame, model: Model, text_col="text") -> tuple[DataFrame, dict]:
    """``docs`` with lang_pred, score and accepted; and the names they got.

    The whole text counts.  Null texts and those without a letter are ``und`` with score 0, and so is every text if
    the model has learned no language; score is the probability of lang_pred, accepted whether it reaches the model's
    least one.  Repeated rows give repeated results.  Columns of ``docs`` that have one of the new names
    keep it: the new column gets another.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list) -> list[list]:
        m = shared.value
        names, scores, accepted = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        use = [k for k, t in enumerate(texts) if t and m.classes and LETTER.search(t)]
        for k, p in zip(use, m.probabilities([encode(texts[k].lower()) for k in use]) if use else (), strict=True):
            best = int(p.argmax())
            names[k], scores[k], accepted[k] = m.classes[best], float(p[best]), bool(p[best] >= m.least)
        return [names, scores, accepted]

    names = dict(zip(n := ["lang_pred", "score", "accepted"], fresh(docs, *n), strict=True))
    return append(docs, [text_col], work, list(zip(names.values(), ["string", "double", "boolean"], strict=True))), names

