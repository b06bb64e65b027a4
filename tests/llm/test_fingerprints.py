"""Bottom-k sketches against exact sets, and the next documents against a plain list."""

from hashlib import sha256

import numpy as np
import pytest

from splitlens.llm import fingerprints as P
from splitlens.llm import words as W
from splitlens.llm.registry import QUERIES
from splitlens.llm.staging import prepare

from . import tables


def key(r):
    return str(r)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain_list(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect())
    got = sorted(QUERIES["op8_fingerprints"](spark, path).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [i for i, _ in docs]
    same, errors = {}, []
    for k, (r, (_, text)) in enumerate(zip(got, docs)):
        nxt = docs[(k + 1) % len(docs)][1]
        n = len(text) // 4
        changed = text[:len(text) - n] + nxt[:n]
        assert r.n_chars == len(text) and r.edited_sha256 == sha256(changed.encode()).hexdigest()
        assert same.setdefault(text, r.fingerprint) == r.fingerprint
        for want, have in ((P.near_of(text, changed), r.near_edited), (P.near_of(text, nxt), r.near_next)):
            errors.append(abs(want - have))
            assert 0 <= have <= 1
    assert max(errors) < 0.25 and np.mean(errors) < 0.03


def test_estimates_and_merging():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2 ** 64, 20000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.7], rng.integers(0, 2 ** 64, 3000, dtype=np.uint64)]))
    sa, sb = P.sketch(a), P.sketch(b)
    union = len(np.union1d(a, b))
    assert abs(P.resemblance(sa, sb) - len(np.intersect1d(a, b)) / union) < 0.15
    assert abs(P.containment(sa, sb) - 0.7) < 0.2
    assert abs(P.distinct(sa) - len(a)) < 0.35 * len(a)
    parts = [P.sketch(x) for x in np.array_split(rng.permutation(a), 5) for x in [np.sort(x)]]
    out = parts[0]
    for x in parts[1:]:
        out = P.merge(out, x)
    assert (out == sa).all() and (P.from_text(P.text_of(sa)) == sa).all()


def test_merged_sketches_of_groups(spark):
    prepare(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = P.fingerprints(docs).join(docs.select("doc_id", "source"), "doc_id")
    got = {r.source: np.array(r.sketch, np.int64).view(np.uint64) for r in P.merged(own, ["source"]).collect()}
    want = {}
    for r in own.collect():
        s = np.array(r.sketch, np.int64).view(np.uint64)
        want[r.source] = P.merge(want.get(r.source, np.zeros(0, np.uint64)), s)
    assert set(got) == set(want) and all((got[s] == want[s]).all() for s in want)


def test_awkward_rows(spark):
    prepare(spark)
    df = tables.awkward(spark)
    got = P.with_next(df).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(r.doc_id), len(r.text or "")) for r in df.collect())
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].edited_sha256 == sha256(b"").hexdigest() and by_id[0].near_edited == 1.0
    assert by_id[5].fingerprint == by_id[6].fingerprint
    assert P.with_next(tables.empty(spark)).count() == 0
    one = P.with_next(spark.createDataFrame([(7, "a b c d")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == sha256(b"a b c a").hexdigest()
    nulls = spark.createDataFrame([(None, f"text number {i}") for i in range(50)] + [(3, "x y")], "doc_id long, text string")
    assert P.with_next(nulls).count() == 51
    rows = P.fingerprints(df)
    assert W.shingle_hashes(np.zeros(0, np.uint64)).size == 0 and rows.count() == df.count()
