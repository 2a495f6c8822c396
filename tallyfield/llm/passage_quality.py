"""Document quality by attention-based multiple-instance learning over passages.

A text is a bag of passages of ``PASSAGE`` words. Each passage is encoded from its characters and words
(shares of character classes, word length, distinct and repeated words), a hidden layer turns that into
an instance vector, gated attention weighs the instances, and the weighted vector gives the probability
that the document is good. Only document labels are used; all weights are learned together by Adam on
the exact gradient.

Learned from a bounded sample of labelled rows (``SAMPLE`` per class, texts up to ``SAMPLE_BYTES``); every
passage of every text is scored, however long. Defined results: null and empty texts are one empty
passage; a null id is never held out; repeated rows and ties are scored alike; without labels of both
classes every score is 1, so that nothing is rejected unlearned; extra columns of any name are kept in
``row`` and not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, SAMPLE_BYTES = 2500, 20_000
PASSAGE, HIDDEN, ATTENTION = 64, 16, 8
EPOCHS, BATCH, RATE = 24, 256, 0.02
KEEP_AT = 0.3

#: Class of each byte: letters by case, digits, spaces, line ends, non-ASCII bytes, and each other printable byte alone.
_CLASS = np.full(256, 5, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[128:] = 6
_OTHER = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_OTHER] = np.arange(7, 7 + len(_OTHER))
N_CLASSES = 7 + len(_OTHER)
N_FEATURES = N_CLASSES + 6


def encode(text: str | None) -> np.ndarray:
    """Features of every passage of the whole text."""
    data = (text or "").encode()
    words = data.split()
    n = max(1, -(-len(words) // PASSAGE))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    # passages are cut where their first word begins; the white space before it belongs to the passage before
    codes = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], (codes == 32) | ((codes > 8) & (codes < 14))])
    begins = np.flatnonzero(space[:-1] & ~space[1:])[::PASSAGE]
    of = np.repeat(np.arange(n), np.diff(np.concatenate([[0], begins[1:], [len(codes)]])))
    counts = np.bincount(of * N_CLASSES + _CLASS[codes], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :N_CLASSES] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    for i in range(n):
        some, long = words[i * PASSAGE : (i + 1) * PASSAGE], sizes[i * PASSAGE : (i + 1) * PASSAGE]
        if some:
            same = sum(map(bytes.__eq__, some, some[1:]))
            out[i, N_CLASSES:] = (len(some) / PASSAGE, len(set(some)) / len(some), same / len(some), min(long.mean() / 10, 3), min(long.std() / 10, 3), len(set(some)) < len(some) / 2)
    return out


class Network:
    """Weights of the passage encoder, the gated attention and the output."""

    def __init__(self, bags: list[np.ndarray], labels: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        flat = np.concatenate(bags)
        self.mean, self.scale = flat.mean(0), flat.std(0) + 0.02
        shape = {"w": (N_FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "a": (ATTENTION,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "ac" else np.zeros(s) for k, s in shape.items()}
        first = {k: np.zeros_like(x) for k, x in self.p.items()}
        second = {k: np.zeros_like(x) for k, x in self.p.items()}
        t = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(bags))
            rate = RATE * (1 - epoch / EPOCHS)
            for lo in range(0, len(order), BATCH):
                some = order[lo : lo + BATCH]
                slope = self._slope([bags[i] for i in some], labels[some])
                t += 1
                for k, g in slope.items():
                    g = g + 1e-4 * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)

    def _forward(self, bags: list[np.ndarray]):
        p, sizes = self.p, np.array([len(b) for b in bags])
        starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes)
        x = np.clip((np.concatenate(bags) - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["b"])
        s, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (s * g) @ p["a"]
        weight = np.exp(e - np.maximum.reduceat(e, starts)[of])
        weight = weight / np.add.reduceat(weight, starts)[of]
        z = np.add.reduceat(weight[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return x, h, s, g, weight, z, y, starts, of

    def _slope(self, bags: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, s, g, weight, z, y, starts, of = self._forward(bags)
        out = (y - labels) / len(bags)
        dz = out[:, None] * p["c"]
        dweight = (dz[of] * h).sum(1)
        de = weight * (dweight - np.add.reduceat(weight * dweight, starts)[of])
        ds, dg = de[:, None] * p["a"] * g * (1 - s * s), de[:, None] * p["a"] * s * g * (1 - g)
        dh = (weight[:, None] * dz[of] + ds @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ ds, "u": h.T @ dg, "a": (s * g).T @ de, "c": z.T @ out, "d": out.sum(keepdims=True)}

    def __call__(self, bags: list[np.ndarray]) -> np.ndarray:
        return self._forward(bags)[6]


def fit(docs: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int) -> Network | None:
    texts, known = common.labelled_sample(docs, labels, label, modulus, left_out, SAMPLE, SAMPLE_BYTES)
    if len(set(known)) < 2:
        return None
    return Network([encode(t) for t in texts], np.array(known, float))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, left_out: int = 0, train_docs: DataFrame | None = None) -> DataFrame:
    """The rows of docs in the struct ``row``, with held_out, score and predicted; texts of labelled rows come from train_docs."""
    network = fit(docs if train_docs is None else train_docs, labels, label, modulus, left_out)
    held_out = (~common.in_training(F.col("doc_id"), modulus, left_out)).alias("held_out")
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    if network is None:
        return docs.select(row, held_out, F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def judge(texts):
        out = np.empty(len(texts))
        # a few texts at a time, so that long ones do not meet in memory
        for lo in range(0, len(texts), 64):
            out[lo : lo + 64] = shared.value([encode(t) for t in texts.iloc[lo : lo + 64]])
        return type(texts)(out)

    scored = docs.select(row, held_out, judge(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_AT).cast("int"))


def good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    return score(docs, labels, **options).where("predicted = 1").select("row.*")
