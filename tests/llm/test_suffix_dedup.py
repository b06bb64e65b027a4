"""Suffix-array dedup against a scan of all strings, and the array against sorting."""

import random
import tracemalloc
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from splitlens.llm import suffix_array as A
from splitlens.llm import suffix_dedup as S
from splitlens.llm import words as W
from splitlens.llm.registry import QUERIES
from splitlens.llm.staging import prepare

from . import tables


@pytest.mark.parametrize("alphabet", [1024, 3])
def test_suffix_array_and_prefixes(monkeypatch, alphabet):
    monkeypatch.setattr(A, "INDUCED_ALPHABET", alphabet)
    rng = np.random.default_rng(7)
    for _ in range(150):
        t = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 80)), 0)
        order = A.suffix_array(t, int(t.max()) + 1)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        shared = A.permuted_common_prefixes(t.astype(np.uint8), order, 20)
        for a, b in zip(order, order[1:]):
            n = 0
            while n < 20 and max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert shared[b] == n


def check(got, docs):
    docs = sorted(docs)
    want = [(i, len((t or "").encode()), a, b, sha256(k).hexdigest()) for (i, t), (a, b, k) in zip(docs, S.removed_of(docs))]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_scan(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    check(QUERIES["op4_suffix_dedup"](spark, path).collect(), docs)


@pytest.mark.parametrize("hot", [512, 3])
def test_passages_periods_and_strides(spark, monkeypatch, hot):
    prepare(spark)
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "SHARD_BYTES", 4000)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(60), prose(25)
    texts = [prose(rng.randrange(10, 80)) + passage[rng.randrange(60):] + prose(5) for _ in range(25)]
    texts += [prose(5) + other + passage[:rng.randrange(90, 200)] for _ in range(10)]
    texts += [texts[0]] * 3 + ["a" * 400, "a" * 99, "a" * 100, "ab" * 300, passage * 3, "é" * 120, None, "", prose(3)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check(S.summary(df).collect(), docs)


def test_long_text_in_strides(spark):
    prepare(spark)
    rng = random.Random(4)
    block = " ".join(str(rng.randrange(10 ** 9)) for _ in range(50_000))
    docs = [(0, block + "x" * 700 + block), (1, "y" + block[300_000:]), (2, block)]
    got = S.summary(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check(got, docs)


def test_awkward_rows(spark):
    prepare(spark)
    df = tables.awkward(spark)
    got = {(r.doc_id, r.n_bytes): r for r in S.summary(df).collect()}
    assert got[(6, 21)].n_removed == 0 and S.summary(df).count() == df.count()
    long = got[(12, len(tables.LONG) + 5)]
    assert long.n_removed == len(tables.LONG)
    kept = S.without_repeats(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert len(rows) == df.count() and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert S.summary(tables.empty(spark)).count() == 0 and S.without_repeats(tables.empty(spark)).count() == 0
    copies = spark.createDataFrame([(1, tables.LONG), (2, tables.LONG), (None, tables.LONG), (2, tables.LONG)], "doc_id long, text string")
    assert [r.doc_id for r in S.without_repeats(copies).collect()] == [1]
    assert sorted(r.n_removed for r in S.summary(copies).collect()) == [0] + [len(tables.LONG)] * 3


def test_working_memory_is_bounded(spark):
    """Hashing takes memory by stride, not by batch, and batches of long texts are cut by bytes."""
    data = np.random.default_rng(3).integers(97, 123, 4 << 20).astype(np.uint8)
    data[::7] = 32
    offs = np.arange(0, len(data) + 1, 1 << 12)
    texts = pa.array([data[a:b].tobytes().decode() for a, b in zip(offs, offs[1:])])
    for work in (lambda: S.regions(data, offs), lambda: sum(1 for _ in W.shingle_sets(texts))):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 48 << 20

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([b.num_rows], pa.int64())})

    prepare(spark)
    docs = spark.createDataFrame([(i, "x" * 10_000) for i in range(1000)], "doc_id long, text string").coalesce(1)
    S.repeats(docs.limit(3))
    assert max(r.rows for r in docs.mapInArrow(sizes, "rows long").collect()) < 100
    prepare(spark)
