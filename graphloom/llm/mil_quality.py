"""Quality classifier: gated attention-based multiple-instance learning (Ilse et al.) over a document's passages.

A document is a bag of passages of PASSAGE_BYTES bytes. Each passage is encoded by shares of its bytes' classes and by
word statistics; a small layer makes it an embedding, gated attention gives it a weight, and the weighted mean of the
embeddings is scored. Only document labels are needed, also for the attention.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batched, chunks, lean, word_hashes
from .toxicity_lexicon import fold_of, labelled_sample

PASSAGE_BYTES = 600
HIDDEN, GATE = 16, 12

# Classes of bytes: a-z, A-Z, digits, blank, line break, each of these signs, other ASCII, and the rest.
_SIGNS = b".,!?|*&%$#<>=-\"'/:@"
_CLASS = np.full(256, 5 + len(_SIGNS), np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]], _CLASS[[10, 13]] = 3, 4
for _i, _c in enumerate(_SIGNS):
    _CLASS[_c] = 5 + _i
_CLASS[128:] = 6 + len(_SIGNS)
_KINDS = 7 + len(_SIGNS)
FEATURES = _KINDS + 6


def encode(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, passages of each text); a text has one passage at least, an empty one all zeros.

    Besides the shares of byte classes: words a byte, distinct words among the passage's and among the document's words
    (by hash), the share of words equal to the word before, the document's length, and whether it is short.
    """
    lengths = np.array([len(b) for b in encoded], np.int64)
    parts = np.maximum(1, -(-lengths // PASSAGE_BYTES))
    first = np.cumsum(parts) - parts
    a = np.frombuffer(b"".join(encoded), np.uint8)
    doc = np.repeat(np.arange(len(encoded)), lengths)
    inside = np.arange(len(a)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    passage = first[doc] + inside // PASSAGE_BYTES
    n = int(parts.sum())
    x = np.zeros((n, FEATURES), np.float32)
    counts = np.bincount(passage * _KINDS + _CLASS[a], minlength=n * _KINDS).reshape(n, _KINDS)
    total = np.maximum(1, counts.sum(1))
    x[:, :_KINDS] = np.sqrt(counts / total[:, None])
    h, words = word_hashes(encoded)
    owner = np.repeat(np.arange(len(encoded)), words)
    # words are dealt evenly to their document's passages
    rank = np.arange(len(h)) - np.repeat(np.cumsum(words) - words, words)
    place = first[owner] + rank * parts[owner] // np.maximum(1, words[owner])
    in_passage = np.maximum(1, np.bincount(place, minlength=n))
    distinct = lambda by, size: np.bincount(by[np.unique(mixed(h, by), return_index=True)[1]], minlength=size)
    x[:, _KINDS] = 6 * in_passage / total
    x[:, _KINDS + 1] = distinct(place, n) / in_passage
    x[:, _KINDS + 2] = np.repeat(distinct(owner, len(encoded)) / np.maximum(1, words), parts)
    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (place[1:] == place[:-1])
        x[:, _KINDS + 3] = np.bincount(place[1:][same], minlength=n) / in_passage
    x[:, _KINDS + 4] = np.repeat(np.log1p(words) / 8, parts)
    x[:, _KINDS + 5] = np.repeat(words < 50, parts)
    return x, parts


def mixed(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    return h ^ (by.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Model:
    """Gated attention over passage embeddings; p = sigmoid(c . sum_i a_i h_i + d)."""

    names = ("w", "b", "v", "u", "t", "c", "d")

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        s = lambda *n: r.normal(0, 1 / np.sqrt(n[0]), n)
        self.p = {"w": s(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "v": s(HIDDEN, GATE), "u": s(HIDDEN, GATE), "t": s(GATE, 1)[:, 0], "c": s(HIDDEN, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.scale, self.shift = np.zeros(FEATURES), np.ones(FEATURES), 0.0

    def forward(self, x: np.ndarray, parts: np.ndarray) -> dict:
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        g1, g2 = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-h @ p["u"]))
        e = (g1 * g2) @ p["t"]
        first = np.cumsum(parts) - parts
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), parts))
        a = e / np.repeat(np.add.reduceat(e, first), parts)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "h": h, "g1": g1, "g2": g2, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0] + self.shift, -30, 30)))}

    def gradients(self, f: dict, parts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p, first = self.p, np.cumsum(parts) - parts
        dy = weight * (f["y"] - y) / weight.sum()
        dz = dy[:, None] * p["c"]
        da = (np.repeat(dz, parts, 0) * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), parts))
        dg = de[:, None] * p["t"]
        k1, k2 = dg * f["g2"] * (1 - f["g1"] ** 2), dg * f["g1"] * f["g2"] * (1 - f["g2"])
        dh = np.repeat(dz, parts, 0) * f["a"][:, None] + k1 @ p["v"].T + k2 @ p["u"].T
        ds = dh * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ ds, "b": ds.sum(0), "v": f["h"].T @ k1, "u": f["h"].T @ k2, "t": (f["g1"] * f["g2"]).T @ de, "c": f["z"].T @ dy, "d": np.array([dy.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4, seed: int = 2) -> Model:
        """Adam over shuffled batches of bags, the same on every run."""
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        self.p["d"][0] = np.log((weight @ y + 1) / (weight @ (1 - y) + 1))
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, epochs * -(-len(bags) // batch)
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                parts = np.array([len(bags[i]) for i in some])
                f = self.forward(np.concatenate([bags[i] for i in some]), parts)
                g = self.gradients(f, parts, y[some], weight[some])
                step += 1
                now = rate * (1 - step / (steps + 1))
                for k in self.names:
                    grad = g[k] + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    s[k] = 0.99 * s[k] + 0.01 * grad**2
                    self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def predict(self, encoded: list[bytes]) -> np.ndarray:
        return self.forward(*encode(encoded))["y"]


def train(docs: DataFrame, labels: DataFrame, keep, bound: int = 1500) -> Model:
    """A model of at most bound labelled rows of each label that pass keep."""
    texts, y, weight = labelled_sample(docs, labels, "quality", keep, bound)
    model = Model()
    if not texts:
        model.p["c"][:] = 0.0
        return model
    bags = []
    for _, some in chunks(texts):
        x, parts = encode(some)
        bags += np.split(x, np.cumsum(parts)[:-1])
    return model.fit(bags, y, weight / weight.mean())


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = 0.3, bound: int = 1500) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, learned from labels outside the held-out fold.

    Whole texts are scored, and nothing but them. Null and empty texts are one empty passage. Repeated rows score alike;
    labels without a document, null labels and null ids teach nothing; without labels every score is 0.5. Of several texts
    of a labelled id the smallest teaches. Other columns are ignored; an empty table gives no rows.
    """
    model = train(docs, labels, fold_of(F.col("doc_id"), folds) != held, bound)

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def work(parts):
            for texts in parts:
                p = [model.predict(some) for _, some in chunks((v.as_py() for v in texts), 1 << 19)]
                yield pa.array(np.concatenate(p) if p else np.zeros(0), pa.float64())

        yield from lean(work)(batches)

    scored = batched(docs).select(F.col("doc_id").cast("long"), F.arrow_udf(each, "double")("text").alias("score"))
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
