"""The passage classifier: vectors by hand, gradients by differences, held-out accuracy."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from splitlens.llm import mil_quality as M
from splitlens.llm import words as W
from splitlens.llm.registry import QUERIES
from splitlens.llm.staging import prepare

from . import tables


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    prepare(spark)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op7_mil_quality"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    own = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    low, high = [s for s, y in own if y == 0], [s for s, y in own if y == 1]
    assert np.mean([a < b for a in low for b in high]) > 0.97
    assert np.mean([s < 0.3 for s in low]) > 0.9 and np.mean([s >= 0.3 for s in high]) > 0.98
    again = {r.doc_id: r.score for r in QUERIES["op7_mil_quality"](spark, sf).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)


def test_labels_of_held_out_rows_are_not_used(spark):
    prepare(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    x, at, y = M.sample(docs, labels)
    other = labels.withColumn("quality", (M.held_out("doc_id")).cast("int") * (1 - labels.quality) + (~M.held_out("doc_id")).cast("int") * labels.quality)
    x2, at2, y2 = M.sample(docs, other)
    assert (x == x2).all() and (at == at2).all() and (y == y2).all()
    assert len(M.sample(docs, labels, limit=5)[2]) == 5


def test_passages_by_hand():
    texts = ["a B! " * 100, None, "", "same same x1 #$ DONE"]
    x, at = M.passages(pa.array(texts))
    assert np.diff(at).tolist() == [4, 1, 1, 1]
    names = list(M._CLASSES)
    one, last = x[0], x[at[3]]
    assert one[names.index("upper")] == pytest.approx(1 / 5) and one[names.index("shout")] == pytest.approx(1 / 5)
    size = len(texts[3])
    assert last[names.index("symbol")] == pytest.approx(2 / size) and last[names.index("digit")] == pytest.approx(1 / size)
    k = len(names)
    assert last[k:k + 2] == pytest.approx([np.log1p(5), np.log1p(size)])
    lengths = [5, 5, 3, 3, 4]  # to the next word
    assert last[k + 2:k + 8] == pytest.approx([np.mean(lengths), np.std(lengths), 4 / 5, 1 / 5, 1 / 5, 1 / 5])
    assert last[-M.BUCKETS:].sum() == pytest.approx(1) and not x[at[1], :k].any()


def plain_passages(text):
    """The vectors of one text's passages by plain loops."""
    raw = (text or "").encode()
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    lower = lambda w: bytes(b + 32 if 65 <= b <= 90 else b for b in w)
    out = []
    for k in range(max(1, -(-len(spans) // M.PASSAGE))):
        own = spans[k * M.PASSAGE:(k + 1) * M.PASSAGE]
        begin = own[0][0] if k else 0
        end = spans[(k + 1) * M.PASSAGE][0] if (k + 1) * M.PASSAGE < len(spans) else len(raw)
        size, some = max(1, end - begin), max(1, len(own))
        kinds = [sum(b in set(c) for b in raw[begin:end]) / size for c in M._CLASSES.values()]
        words = [raw[a:b] for a, b in own]
        starts = [a for a, _ in spans] + [len(raw)]
        lengths = [starts[k * M.PASSAGE + i + 1] - a for i, (a, _) in enumerate(own)] or [0]
        low = [lower(w) for w in words]
        bag = [0.0] * M.BUCKETS
        for w in low:
            h = W.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]
            bag[int(h >> np.uint64(59))] += 1 / some
        style = [math.log1p(len(own)), math.log1p(size), np.mean(lengths), np.std(lengths), len(set(low)) / some,
                 sum(a == b for a, b in zip(low, low[1:])) / some, sum(65 <= w[0] <= 90 for w in words) / some,
                 sum(a != b for a, b in zip(words, low)) / some, math.log1p(len(spans))]
        out.append(np.array([*kinds, *style, *bag]))
    return out


def plain_score(model, text):
    """Gated attention over passages, one at a time."""
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    encoded, weights = [], []
    for x in plain_passages(text):
        x = (x - model["mean"]) / model["scale"]
        h = [math.tanh(sum(x[i] * model["E"][i][k] for i in range(len(x))) + model["e"][k]) for k in range(M.HIDDEN)]
        a = 0.0
        for k in range(M.GATE):
            t, g = (sum(h[i] * model[m][i][k] for i in range(M.HIDDEN)) for m in "VU")
            a += math.tanh(t) * sigmoid(g) * model["w"][k]
        encoded.append(h)
        weights.append(math.exp(a))
    z = [sum(w * h[k] for w, h in zip(weights, encoded)) / sum(weights) for k in range(M.HIDDEN)]
    return sigmoid(sum(a * b for a, b in zip(z, model["c"])) + model["b"][0])


def test_scores_by_plain_loops(spark):
    prepare(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40").select("doc_id", "text")
    model = M.train(*M.sample(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")), epochs=5)
    df = docs.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(tables.TEXTS) if t is None or len(t) < 5000], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in df.collect()}
    scores = {r.doc_id: r.score for r in M.scored(df, model).collect()}
    assert set(scores) == set(text) and len({round(s, 6) for s in scores.values()}) > 20
    for i, s in scores.items():
        assert s == pytest.approx(plain_score(model, text[i]), abs=1e-5)


def test_training_picks_passages_over_the_whole_text(spark):
    prepare(spark)
    assert M._picked(3).tolist() == [0, 1, 2] and len(M._picked(10 ** 4)) == M.SAMPLE_PASSAGES
    halves = [(M._picked(10 ** 4) < 5000).mean(), (M._picked(10 ** 4) > 9000).mean()]
    assert 0.35 < halves[0] < 0.65 and halves[1] > 0.03
    df = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    for order in ([(1, 0), (1, 1), (2, 0)], [(1, 1), (2, 0), (1, 0)]):
        labels = spark.createDataFrame(order, "doc_id long, quality int").repartition(3)
        assert M.sample(df, labels)[2].tolist() == [1.0, 0.0]


def test_gradients_by_differences():
    """One step of training follows the numeric gradient of the loss."""
    rng = np.random.default_rng(0)
    x, at, y = rng.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1])
    start = M.train(x, at, y, epochs=0)
    moved = M.train(x, at, y, epochs=1, batch=3, rate=1e-6, decay=0)
    loss = lambda m: -np.mean(np.log(np.where(y == 1, M.score(m, x, at), 1 - M.score(m, x, at))))
    for k in "EeVUwcb":
        flat = start[k].reshape(-1)
        for i in range(0, len(flat), 7):
            up, down = ({**start, k: start[k].copy()} for _ in range(2))
            up[k].reshape(-1)[i] += 1e-5
            down[k].reshape(-1)[i] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            change = (moved[k] - start[k]).reshape(-1)[i]
            assert abs(slope) < 1e-4 or np.sign(change) == -np.sign(slope)


def test_awkward_rows(spark):
    prepare(spark)
    df = tables.awkward(spark)
    labels = spark.createDataFrame([(1, 0), (3, None), (None, 1), (5, 1), (5, 1), (11, 0), (77, 1)], "doc_id long, quality int")
    out = M.classify(df, labels).collect()
    assert len(out) == df.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.held_out for r in out if r.doc_id is None} == {False}
    assert len({r.score for r in out if r.doc_id in (0, 1)}) == 1
    none = M.classify(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert M.classify(tables.empty(spark), labels).count() == 0
