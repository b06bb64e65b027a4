"""The corpus pipeline, every stage against brute force over the rows that its predecessor kept."""

import math
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as C
from splitlens.llm import mixing, ngram_join, quality_rules, sp_sampling, suffix_dedup
from splitlens.llm.staging import prepare, staged, tokenizer_path

from . import tables

SF = "/root/testdata/sf0.001"
V = sp_sampling.vocabulary(tokenizer_path(sp_sampling.VOCABULARY))


def carried(mix, seed=1):
    """Copies by document: along a source's documents (by falling size class, bucket, falling size
    and key) the rates add up, and each whole number passed is a copy."""
    hashed = mix.where("size > 0").select("doc_id", "source", "size", "taken", "key", F.xxhash64("key", F.lit(seed)).alias("deal"), F.xxhash64("source", F.lit(seed)).alias("start"))
    rows, unit = hashed.collect(), mixing._UNIT
    assert len({r.key for r in rows}) == len(rows)  # no equal rows, which would share a rate
    buckets = 1 + len(rows) // mixing.CARRY_DOCS
    order = sorted(rows, key=lambda r: (-math.floor(2 * math.log(r["size"]) / math.log(2)), r.deal % buckets, -r["size"], r.key))
    sums, out = {}, Counter()
    for r in order:
        before = sums.setdefault(r.source, r.start % unit)
        sums[r.source] = before + math.floor(r.taken * unit / r["size"] + 0.5)
        out[r.doc_id] = sums[r.source] // unit - before // unit
    return +out


def test_stages_one_after_the_other(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for name, stage in C.STAGES:
        steps.append(staged(stage(spark, steps[-1], SF), "test"))
    rows = [sorted(s.collect(), key=lambda r: r.doc_id) for s in steps]
    assert all(s.columns == columns for s in steps[:-1]) and len(C.STAGES) == 5

    good = {r.doc_id for r in quality_rules.apply_rules(docs).where("kept").collect()}
    base = {r.doc_id: quality_rules.base_counts(r.text) for r in rows[0]}
    assert {r.doc_id for r in rows[1]} == good
    assert not any(base[i][0] < 10 or 100 * base[i][4] > 20 * base[i][0] for i in good)

    links, left = ngram_join.links_of([r.text for r in rows[1]]), []
    reached: set[int] = set()
    for i in range(len(rows[1])):
        if i not in reached:
            left.append(rows[1][i])
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in reached:
                    reached.add(k)
                    todo += links[k]
    assert rows[2] == left

    kept = [(r, k.decode("utf-8", "ignore")) for r, (_, _, k) in zip(rows[2], suffix_dedup.removed_of([(r.doc_id, r.text) for r in rows[2]]))]
    assert [(r.doc_id, r.text, r.n_chars) for r in rows[3]] == [(r.doc_id, t, len(t)) for r, t in kept if t]

    assert Counter(r.doc_id for r in rows[4]) == carried(mixing.mix(steps[3]))

    text = {r.doc_id: r.text for r in rows[4]}
    assert {r.doc_id for r in rows[5]} == set(text)
    assert all(V.decode(r.ids) == text[r.doc_id] for r in rows[5])
    assert sorted(C.run(spark, SF).collect(), key=str) == sorted(rows[5], key=str)


CLASHES = ["rid", "quality", "samples", "license", "_h", "_id", "_row", "_hash", "_key", "_its", "_rows", "_all", "_rank",
           "_copies", "_copy", "_runs", "_rid", "_quality", "text_hash", "words", "Block"]


def test_clashing_columns_come_through(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    more = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in CLASHES])
    for name, stage in C.STAGES[:4]:
        plain, out = staged(stage(spark, docs, SF), "test"), staged(stage(spark, more, SF), "test")
        assert out.columns == more.columns
        rows = out.collect()
        assert Counter(tuple(r[c] for c in docs.columns) for r in rows) == Counter(map(tuple, plain.collect()))
        assert all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHES)
        docs, more = plain, out
    assert sp_sampling.encode(more).columns[-1] == "samples"


def test_awkward_rows(spark):
    prepare(spark)
    for df in (tables.awkward(spark).drop("kept"), tables.empty(spark)):
        for _, stage in C.STAGES:
            df = staged(stage(spark, df, SF), "test")
        rows = df.collect()
        assert all(V.decode(r.ids) for r in rows)
