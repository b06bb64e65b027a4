"""The grouped prefix join against comparing all pairs."""

import random

import pytest

from splitlens.llm import ngram_join as J
from splitlens.llm.registry import QUERIES
from splitlens.llm.staging import prepare

from . import tables


def components(ids, links):
    comp = list(range(len(ids)))
    for i, near in enumerate(links):
        for j in near:
            a, b = comp[i], comp[j]
            if a != b:
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    least = {}
    for i, c in enumerate(comp):
        if ids[i] is not None:
            least[c] = min(least.get(c, ids[i]), ids[i])
    return [least.get(c) for c in comp]


def check(got, docs):
    """``docs``: (doc_id, text) rows."""
    links = J.links_of([t for _, t in docs])
    want = sorted(((i, c, len(k)) for (i, _), c, k in zip(docs, components([i for i, _ in docs], links), links)), key=str)
    have = sorted(((None if r.doc_id is None else r.doc_id, r.component_id, r.n_links) for r in got), key=str)
    assert have == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_all_pairs(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    check(QUERIES["op9_ngram_jaccard_join"](spark, path).collect(), docs)


def family(n, words, edits, rng):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10 ** 6)}"
        yield " ".join(copy)


def test_chains_blocks_and_passages(spark, monkeypatch):
    """A large family in many blocks, sets near the threshold, and a passage that all share."""
    prepare(spark)
    monkeypatch.setattr(J, "BLOCK_CLASSES", 8)
    rng = random.Random(5)
    texts = [*family(60, 80, 4, rng), *family(25, 30, 2, rng), *family(9, 300, 20, rng)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [" ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(5, 60))) + " " + passage for _ in range(60)]
    texts += [texts[3]] * 5 + [passage, passage.upper(), "a b", "A b", "a b c"]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(J.join(df).collect(), docs)
    check(J.join(df, few=3).collect(), docs)


def test_awkward_rows(spark):
    prepare(spark)
    df = tables.awkward(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    check(J.join(df).collect(), docs)
    assert J.join(tables.empty(spark)).count() == 0
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    links = J.links_of([r.text for r in rows])
    assert not any(links)
    wordless = [r for r in df.collect() if not (r.text or "").split()]
    assert len([r for r in rows if not (r.text or "").split()]) == len(wordless)
    assert {r.doc_id for r in rows} >= {3, 4, 5, 9, 10}
    assert J.keep_one(tables.empty(spark)).count() == 0
