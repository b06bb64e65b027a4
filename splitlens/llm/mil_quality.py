"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages (``PASSAGE`` words each, the last one shorter). Every passage is
described by counts over its bytes and words, encoded by one hidden layer, and weighted by gated
attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))``; the weighted sum of the encodings is the
document's representation, and a logistic unit scores it. Encoder, attention and score are
learned together from document labels alone. Training takes a bounded sample of labelled
documents to the driver as passage vectors; scoring is one pass over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

PASSAGE = 64
#: Documents that training reads at most, and of each so many passages at most, picked over the
#: whole text by a hash of their place (scores use all).
SAMPLE, SAMPLE_PASSAGES = 6000, 256
BUCKETS = 32
HIDDEN, GATE = 24, 12
THRESHOLD = 0.3

_CLASSES = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "space": [0x20, 0x09], "line": [0x0A],
    "stop": [0x2E, 0x2C], "shout": [0x21, 0x3F], "symbol": list(b"#*$%&|<>"), "bracket": list(b"()[]{}/\\=_+~^@"),
    "quote": list(b"'\"`:;-"), "wide": range(0x80, 0x100), "control": [*range(0x00, 0x09), *range(0x0B, 0x20), 0x7F],
}
_CLASS_OF = np.zeros(256, np.int64)
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _k
N_FEATURES = len(_CLASSES) + 9 + BUCKETS


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages back to back, and each text's n+1 bounds. A text without words,
    null too, is one passage of its bytes."""
    data, offs = W.text_bytes(column)
    out, bounds = [np.zeros((0, N_FEATURES), np.float32)], [np.zeros(1, np.int64)]
    for lo, hi in W.chunks(offs):
        x, n = _chunk(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
        out.append(x)
        bounds.append(np.cumsum(n) + bounds[-1][-1])
    return np.concatenate(out), np.concatenate(bounds)


def _chunk(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = W.word_starts(data, offs, W.SPACE)
    hashes, at = W.word_hashes(data, offs)
    exact, _ = W.word_hashes(data, offs, lower=False)
    n_words = np.diff(at)
    n = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(n) - n
    total = int(n.sum())
    doc = np.repeat(np.arange(len(n)), n)
    rank = np.arange(total) - first[doc]
    # bytes: a passage reaches from its first word (or its text's start) to the next passage
    begin = offs[doc].copy()
    later = rank > 0
    begin[later] = starts[at[doc[later]] + PASSAGE * rank[later]]
    end = np.append(begin[1:], len(data))
    size = np.maximum(1, end - begin).astype(np.float64)
    kinds = np.zeros((total, len(_CLASSES)))
    owner = np.repeat(np.arange(total), end - begin)
    kinds += np.bincount(owner * len(_CLASSES) + _CLASS_OF[data], minlength=total * len(_CLASSES)).reshape(total, -1)
    # words
    word_doc = np.repeat(np.arange(len(n_words)), n_words)
    own = first[word_doc] + (np.arange(len(hashes)) - at[word_doc]) // PASSAGE
    count = np.bincount(own, minlength=total).astype(np.float64)
    some = np.maximum(1, count)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    ends = np.minimum(ends, offs[word_doc + 1]) if len(starts) else ends
    initial = data[starts] if len(starts) else np.zeros(0, np.uint8)
    capital = (initial >= 0x41) & (initial <= 0x5A)
    changed = exact != hashes
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    order = np.lexsort((hashes, own))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (own[order][1:] != own[order][:-1])
    distinct = np.bincount(own[order][fresh], minlength=total)
    share = lambda mask: np.bincount(own[mask], minlength=total) / some
    length = (ends - starts).astype(np.float64)  # up to the next word
    mean = np.bincount(own, length, minlength=total) / some
    spread = np.sqrt(np.maximum(0, np.bincount(own, length ** 2, minlength=total) / some - mean ** 2))
    bag = np.bincount(own * BUCKETS + (hashes >> np.uint64(59)).astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS)
    style = np.stack([np.log1p(count), np.log1p(size), mean, spread, distinct / some, share(same), share(capital), share(changed),
                      np.log1p(n_words[doc])], axis=1)
    return np.concatenate([kinds / size[:, None], style, bag / some[:, None]], axis=1).astype(np.float32), n


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(p: dict, x: np.ndarray, at: np.ndarray):
    """Scores of bags; ``at`` has the start of each bag, none empty."""
    h = np.tanh(x @ p["E"] + p["e"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    a = (t * g) @ p["w"]
    bag = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(x))))
    a = np.exp(a - np.maximum.reduceat(a, at)[bag])
    a = a / np.add.reduceat(a, at)[bag]
    z = np.add.reduceat(h * a[:, None], at)
    return _sigmoid(z @ p["c"] + p["b"]), (h, t, g, a, bag, z)


def score(model: dict, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if len(bounds) < 2:
        return np.zeros(0)
    return _forward(model, (x - model["mean"]) / model["scale"], bounds[:-1])[0]


def train(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 0.005,
          decay: float = 1e-2, seed: int = 1) -> dict:
    """Learn all parameters by Adam on the mean log loss. Without examples the model scores 0.5;
    with one label only it learns that label's bias."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = {"E": rng.normal(0, d ** -0.5, (d, HIDDEN)), "e": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
         "U": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "w": rng.normal(0, GATE ** -0.5, GATE), "c": np.zeros(HIDDEN), "b": np.zeros(1)}
    out = {"mean": x.mean(axis=0) if len(x) else np.zeros(d), "scale": (x.std(axis=0) if len(x) else np.ones(d)) + 1e-3}
    x = (x - out["mean"]) / out["scale"]
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step, n = 0, len(y)
    for _ in range(epochs if n else 0):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            pick = order[lo:lo + batch]
            size = (bounds[1:] - bounds[:-1])[pick]
            at = np.cumsum(size) - size
            rows = np.repeat(bounds[pick] - at, size) + np.arange(int(size.sum()))
            xb = x[rows]
            s, (h, t, g, a, bag, z) = _forward(p, xb, at)
            dz = (s - y[pick])[:, None] / len(pick)
            grad = {"c": (z * dz).sum(axis=0), "b": dz.sum(axis=0)}
            dz = dz * p["c"]
            da = (h * dz[bag]).sum(axis=1)
            da = a * (da - np.add.reduceat(a * da, at)[bag])
            grad["w"] = (t * g).T @ da
            dtg = da[:, None] * p["w"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            grad["V"], grad["U"] = h.T @ dt, h.T @ dg
            dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grad["E"], grad["e"] = xb.T @ dh, dh.sum(axis=0)
            step += 1
            for k in p:
                q = grad[k] + decay * p[k] * (p[k].ndim > 1)
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return out | p


def held_out(doc_id):
    """Rows kept from training: crc32 of doc_id as text divisible by 5; a null id never is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _picked(n: int) -> np.ndarray:
    """Which of ``n`` passages training reads, in order: all, or those of the least hashes."""
    with np.errstate(over="ignore"):
        order = np.argsort(W.mix(np.arange(1, n + 1, dtype=np.uint64) * W.GOLDEN), kind="stable")
    return np.sort(order[:SAMPLE_PASSAGES])


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage vectors, bounds and labels of at most ``limit`` labelled documents that are not
    held out, the first by a hash of doc_id. A document with several labels has the largest.
    Only doc_id and text of ``docs`` are read."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    own = own.select(F.col("doc_id").alias("_its"), F.col(label).cast("int").alias("y")).groupBy("_its").agg(F.max("y").alias("y"))
    own = own.orderBy(F.xxhash64("_its"), "_its").limit(limit)
    picked = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("_its")).select("doc_id", "text", "y")  # at most limit rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = passages(batch.column("text"))
            rows = [x[a:b][_picked(b - a)].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(rows, pa.binary())], names=["doc_id", "y", "x"])

    rows = sorted(picked.mapInArrow(run, "doc_id long, y int, x binary").collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in rows]
    bounds = np.concatenate([[0], np.cumsum([len(a) for a in xs])]).astype(np.int64)
    return np.concatenate([*xs, np.zeros((0, N_FEATURES), np.float32)]), bounds, np.array([r.y for r in rows], float)


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` as doc_id, held_out, score, predicted (1 if score >= ``THRESHOLD``), n_passages.

    Every passage of the whole text counts. Null and empty texts are one empty passage and get a
    score like any other; equal texts get equal scores; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = passages(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.round(score(model, x, at), 12), pa.float64()),
                                              pa.array(np.diff(at), pa.int64())], names=["doc_id", "held_out", "score", "n_passages"])

    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    rows = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, n_passages long")
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Learn from ``labels`` (doc_id, quality) and score all of ``docs``."""
    return scored(docs, train(*sample(docs, labels, label)))
