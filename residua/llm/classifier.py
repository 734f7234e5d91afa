"""Quality classifier: a byte-level convolutional network in numpy.

Input.  A text's UTF-8 bytes in blocks of 8.  Each byte has a learned embedding; a block also has, for each lag from 1
to LAGS, how many of its bytes equal the byte that far before.
Network.  FILTERS learned filters see two neighbouring blocks, at every block of the whole text.  Windows are taken in
chunks of CHUNK blocks, one from every STRIDE-th block on, so that chunks overlap by half.  Each filter's largest answer
in a chunk is the chunk's feature; the largest and the mean over all chunks of the text are the text's.  A hidden layer
and a sigmoid combine them into one probability.
Training.  Adam on the cross entropy, on a bounded sample: PER_CLASS rows of each label and of each text PIECES
chunks spread over it.  The sample has as many rows of either label; the bias is then set back to the real shares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, col, cut, fresh
from .texts import append, encode, give_back, slices

BLOCK, CHUNK, STRIDE, LAGS = 8, 64, 32, 24
EMBEDDING, FILTERS, HIDDEN = 8, 24, 16
#: Bounds of the training sample.
PER_CLASS, PIECES = 800, 8
#: Steps of a training at least.
STEPS = 200


def blocks(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (blocks, 8), lag counts (blocks, LAGS) and each text's first block; every text ends in three blocks of filling.

    Filling is 0xFF, which is in no text, so lags do not see the text before, and windows at a text's end see filling.
    """
    padded = [b + b"\xff" * (-len(b) % BLOCK + 3 * BLOCK) for b in blobs]
    x = np.frombuffer(b"".join(padded), dtype=np.uint8)
    lags = np.zeros((len(x) // BLOCK, LAGS), dtype=np.float32)
    for lag in range(1, LAGS + 1):
        same = np.zeros(len(x), dtype=bool)
        if len(x) > lag:
            np.equal(x[lag:], x[:-lag], out=same[lag:])
            same &= x != 0xFF
        lags[:, lag - 1] = np.bitwise_count(same.view(np.uint64))
    return x.reshape(-1, BLOCK), lags / BLOCK, np.cumsum([0, *(len(p) // BLOCK for p in padded)])


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBEDDING)
    conv: np.ndarray  # (2, BLOCK * EMBEDDING + LAGS, FILTERS): of the block and of the next one
    conv_bias: np.ndarray
    hidden: np.ndarray  # (2 * FILTERS, HIDDEN)
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        draw = lambda *s, fan: (rng.normal(0, 1, s) / np.sqrt(fan)).astype(np.float32)
        d = BLOCK * EMBEDDING + LAGS
        return cls(draw(256, EMBEDDING, fan=1), draw(2, d, FILTERS, fan=2 * d), np.zeros(FILTERS, np.float32), draw(2 * FILTERS, HIDDEN, fan=2 * FILTERS), np.zeros(HIDDEN, np.float32), draw(HIDDEN, fan=HIDDEN), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def inputs(self, x: np.ndarray, lags: np.ndarray) -> np.ndarray:
        return np.concatenate([self.embed[x].reshape(len(x), -1), lags], axis=1)

    def convolved(self, x: np.ndarray, lags: np.ndarray) -> np.ndarray:
        """Every filter's answer at every block but the last."""
        both = self.inputs(x, lags) @ np.concatenate([self.conv[0], self.conv[1]], axis=1)
        return both[:-1, :FILTERS] + both[1:, FILTERS:] + self.conv_bias

    def chunked(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The features (ReLU of maxima) of all chunks, and each text's first chunk."""
        x, lags, first = blocks(blobs)
        answer = self.convolved(x, lags)
        starts, ends, own = chunks(first)
        return np.maximum(maxima(answer, starts, ends), 0), own

    def head(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh(pooled @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def logits(self, blobs: list[bytes]) -> np.ndarray:
        """Of whole texts, worked on in slices of bounded size; long texts in parts of whole chunks."""
        pooled = np.zeros((len(blobs), 2 * FILTERS), dtype=np.float32)
        small = [k for k, b in enumerate(blobs) if 0 < len(b) <= PART]
        for a, b in slices([blobs[k] for k in small], PART):
            features, own = self.chunked([blobs[k] for k in small[a:b]])
            pooled[small[a:b], :FILTERS] = np.maximum.reduceat(features, own[:-1], axis=0)
            pooled[small[a:b], FILTERS:] = np.add.reduceat(features, own[:-1], axis=0) / np.diff(own)[:, None]
        for k, b in enumerate(blobs):
            if len(b) > PART:
                parts = [self._part(b, s) for s in range(0, len(b), PART)]
                whole = np.concatenate(parts)
                pooled[k] = np.r_[whole.max(axis=0), whole.mean(axis=0)]
        return self.head(pooled)

    def _part(self, blob: bytes, start: int) -> np.ndarray:
        """The features of the chunks that begin in [start, start + PART), with the bytes around that they and their lags see."""
        before, first, n = min(start, CHUNK * BLOCK), start // BLOCK, -(-len(blob) // BLOCK)
        starts = np.arange(0, min(PART // BLOCK, number(n) * STRIDE - first), STRIDE)
        if not len(starts):
            return np.empty((0, FILTERS), np.float32)
        x, lags, _ = blocks([blob[start - before : start + PART + CHUNK * BLOCK]])
        answer = self.convolved(x, lags)[before // BLOCK :]
        return np.maximum(maxima(answer, starts, np.minimum(starts + CHUNK, n - first)), 0)


#: Bytes of a part of a long text: whole strides.
PART = 1 << 18


def number(blocks_of_text):
    """Of chunks: they begin at every STRIDE-th block and cover all."""
    return np.maximum(1, -((CHUNK - STRIDE - blocks_of_text) // STRIDE))


def chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end blocks of all chunks, and each text's first chunk, of texts that begin at the blocks ``first``.

    The blocks of filling belong to no chunk; the windows of a text's last block see one of them.
    """
    n = np.diff(first) - 3
    k = number(n)
    own = np.r_[0, np.cumsum(k)]
    within = np.arange(own[-1]) - np.repeat(own[:-1], k)
    starts = np.repeat(first[:-1], k) + within * STRIDE
    return starts, np.minimum(starts + CHUNK, np.repeat(first[:-1] + np.maximum(n, 1), k)), own


def maxima(answer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each filter over each chunk."""
    return np.maximum.reduceat(answer, np.stack([starts, ends], axis=1).ravel(), axis=0)[::2]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -50, 50)))


def gradients(net: Network, blobs: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy. A filter's gradient comes from the window of each chunk where it is largest."""
    x, lags, first = blocks(blobs)
    starts, ends, own = chunks(first)
    answer = net.convolved(x, lags)
    top = maxima(answer, starts, ends)
    features = np.maximum(top, 0)
    at = np.empty(top.shape, dtype=np.int64)
    for c, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        at[c] = s + answer[s:e].argmax(axis=0)
    counts = np.diff(own)
    most = np.maximum.reduceat(features, own[:-1], axis=0)
    pooled = np.concatenate([most, np.add.reduceat(features, own[:-1], axis=0) / counts[:, None]], axis=1)
    h = np.tanh(pooled @ net.hidden + net.hidden_bias)
    g = ((sigmoid(h @ net.out + net.out_bias) - y) / len(y)).astype(np.float32)
    gh = np.outer(g, net.out) * (1 - h * h)
    gp = gh @ net.hidden.T
    doc = np.repeat(np.arange(len(blobs)), counts)
    largest = features >= most[doc]  # chunks overlap, so two can have the largest answer in common
    gf = gp[doc, FILTERS:] / counts[doc][:, None] + np.where(largest, gp[doc, :FILTERS] / np.add.reduceat(largest, own[:-1], axis=0, dtype=np.float32)[doc], 0)
    gf = np.where(top > 0, gf, 0).astype(np.float32)
    d_embed, d_conv = np.zeros_like(net.embed), np.zeros_like(net.conv)
    for k in (0, 1):
        for f in range(FILTERS):
            rows = at[:, f] + k
            mine = gf[:, f]
            use = mine != 0
            if use.any():
                rows, mine = rows[use], mine[use]
                d_conv[k, :, f] = mine @ net.inputs(x[rows], lags[rows])
                back = mine[:, None] * net.conv[k, : BLOCK * EMBEDDING, f]
                for e in range(EMBEDDING):
                    d_embed[:, e] += np.bincount(x[rows].ravel(), weights=back.reshape(-1, BLOCK, EMBEDDING)[:, :, e].ravel(), minlength=256)
    return [d_embed, d_conv, gf.sum(axis=0), pooled.T @ gh, gh.sum(axis=0), h.T @ g, np.array([g.sum()], np.float32)]


def train(blobs: list[bytes], labels: np.ndarray, share: float, epochs: int = 8, rate: float = 0.004, seed: int = 11) -> Network:
    """``share``: of label 1 among all labelled rows."""
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    y = np.asarray(labels, dtype=np.float64)
    blobs, y = [b for b in blobs if b], y[[bool(b) for b in blobs]]
    if not len(y) or len(set(y.tolist())) < 2:
        net.out[:] = 0
        net.out_bias[:] = 4.0 if len(y) == 0 or y[0] else -4.0
        return net
    one, zero = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    m1, m2, t = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    per = max(len(one), len(zero))
    rounds = max(epochs, -(-STEPS * 64 // (2 * per)))  # small samples go more rounds
    for r in range(rounds):
        mix = rng.permutation(np.concatenate([rng.permutation(np.resize(k, per)) for k in (one, zero)]))
        for k in range(0, len(mix), 64):
            rows, t = mix[k : k + 64], t + 1
            step = rate * (1 - r / rounds) + rate / 20
            for p, a, b, g in zip(net.parameters(), m1, m2, gradients(net, [blobs[i] for i in rows], y[rows]), strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                p -= (step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    share = min(max(share, 0.01), 0.99)
    net.out_bias += np.float32(np.log(share / (1 - share)))
    return net


def spread(data: bytes, pieces: int = PIECES) -> bytes:
    """The whole text, or ``pieces`` chunks at equal distances from its first byte to its last."""
    size = CHUNK * BLOCK
    if len(data) <= pieces * size:
        return data
    return b"".join(data[k : k + size] for k in np.linspace(0, len(data) - size, pieces).astype(int))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", per_class: int = PER_CLASS) -> Network:
    """Learn from the rows of ``docs`` whose id has a label (the larger of several); at most per_class * PIECES chunks of a label reach the driver.

    Rows with one id are told apart by their texts; equal rows count once.  A null id has no label.
    """
    kinds = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    shares = {r["label"]: r["count"] for r in kinds.groupBy("label").count().collect()}
    rows = docs.filter(col(text_col).isNotNull()).select(col(id_col).alias("id"), col(text_col).alias("text"))
    few = bounded_sample(kinds.join(rows.select("id", F.xxhash64("text").alias("code")), "id"), "label", ["id", "code"], per_class)
    few = cut(few)  # at most 2 * per_class rows
    x = rows.withColumn("code", F.xxhash64("text")).join(F.broadcast(few), ["id", "code"]).dropDuplicates(["id", "code"])
    x = append(x.select("label", "id", "text"), ["text"], lambda texts: [[spread(encode(t)) for t in texts]], [("piece", "binary")], drop=("text",))
    found = sorted((int(r["label"]), str(r["id"]), bytes(r["piece"])) for r in x.collect())
    net = train([p for *_, p in found], np.array([v for v, *_ in found]), shares.get(1, 0) / max(1, sum(shares.values())))
    give_back()
    return net


def scored(docs: DataFrame, net: Network, text_col="text") -> tuple[DataFrame, dict]:
    """``docs`` with score (probability of label 1) and predicted (1 from 0.5 on); and the names they got.

    The whole text counts; null texts and empty ones have no chunks, features of 0 and the score that follows from
    them.  Without labels of both kinds all texts have one score.  Repeated rows give repeated results.  Columns
    of ``docs`` that have one of the new names keep it: the new column gets another.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(texts: list) -> list[list]:
        p = sigmoid(shared.value.logits([encode(t) for t in texts])).tolist()
        return [p, [int(v >= 0.5) for v in p]]

    names = dict(zip(n := ["score", "predicted"], fresh(docs, *n), strict=True))
    return append(docs, [text_col], work, [(names["score"], "double"), (names["predicted"], "int")]), names
