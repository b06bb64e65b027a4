"""Mixing: targets against resharing by hand, draws against their rules."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from splitlens.llm import mixing as M
from splitlens.llm.registry import QUERIES
from splitlens.llm.staging import prepare

from . import tables


def size_of(text):
    return len(re.findall(M.WORD, text or ""))


def check(rows, docs, near=0.05):
    sizes = defaultdict(int)
    for _, source, text in docs:
        sizes[source] += size_of(text)
    want, taken = M.targets_of(sizes), Counter()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((i, s, size_of(t)) for i, s, t in docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= M.MAX_REPEATS * r.size
        taken[r.source] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= near * target + 2 * M.BLOCK
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_meets_targets_and_reruns_agree(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    first = QUERIES["op1_source_mixing"](spark, path).collect()
    check(first, docs)
    again = M.mix(spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(7), block=32, shard_slots=8192).collect()
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in again)


def test_capped_sources(spark):
    prepare(spark)
    docs = [(i, f"s{i % 7}", "w " * (3 if i % 7 < 3 else 400)) for i in range(700)] + [(999, None, "w " * 5000)]
    check(M.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect(), docs)


def test_permutations_are_bijections(spark):
    for n in (1, 2, 3, 10, 1000):
        df = spark.range(n).withColumn("n", F.lit(n).cast("long"))
        got = [r.to for r in M.permuted(df, "id", "n", F.lit(5), "to").orderBy("id").collect()]
        assert sorted(got) == list(range(n))
    assert got != sorted(got)


def replayed(sources, hashes, permutation, shard_slots):
    """The slots (shard, sid, pass, block) by the rules, from the hashes of all draws."""
    some = sorted((r for r in sources if r.slots > 0), key=lambda r: r.sid)
    shards = -(-sum(r.slots for r in some) // shard_slots)
    free = [r for r in some if not r.limited]
    whole = sum(r.slots for r in free)
    found, numbers, late = [], Counter(), []
    for r in some:
        if r.limited:
            found += [(int(n / r.slots * shards), r, n) for n in range(r.slots)]
    for j in range(shards):
        size = whole // shards + (j < whole % shards)
        rests = []
        for r in free:
            sure, rest = divmod(size * r.slots, whole)
            rests.append(rest)
            for _ in range(sure):
                found.append((j, r, numbers[r.sid]))
                numbers[r.sid] += 1
        for d in range(sum(rests) // whole if whole else 0):
            u, k = hashes[j, d] % sum(rests), 0
            while u >= rests[k]:
                u -= rests[k]
                k += 1
            late.append((j, free[k]))
    for j, r in late:
        found.append((j, r, numbers[r.sid]))
        numbers[r.sid] += 1
    return Counter((j, r.sid, n // r.blocks, permutation(r, n // r.blocks)[n % r.blocks]) for j, r, n in found if n < M.MAX_REPEATS * r.blocks)


def replay(spark, sources, shard_slots, seed):
    rows = sources.collect()
    shards = -(-sum(r.slots for r in rows) // shard_slots)
    draws = spark.range(shards).select(F.col("id").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(rows)).cast("long"))).alias("d"))
    hashes = {(r.j, r.d): r.h for r in draws.select("j", "d", F.xxhash64(F.lit(seed), "j", "d").alias("h")).collect()}
    grid = sources.select("sid", "blocks", F.explode(F.expr("sequence(0L, 2L)")).alias("pass")).select("*", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("index"))
    grid = M.permuted(grid, "index", "blocks", F.xxhash64(F.lit(seed), "sid", "pass"), "to")
    to = {(r.sid, r["pass"], r["index"]): r.to for r in grid.collect()}
    return replayed(rows, hashes, lambda r, p: [to[r.sid, p, i] for i in range(r.blocks)], shard_slots)


@pytest.mark.parametrize("shard_slots, seed", [(37, 2), (10 ** 6, 1)])
def test_draws_replayed(spark, shard_slots, seed):
    """Counts drawn per shard, blocks mapped and words taken, against the rules step by step."""
    prepare(spark)
    docs = [(i, f"s{i % 7}", "w " * (3 if i % 7 < 2 else 90 + i)) for i in range(250)] + [(900, None, "w " * 70)]
    rows = M.sized(spark.createDataFrame(docs, "doc_id long, source string, text string"))
    sources = M.targets(rows)
    want = replay(spark, sources, shard_slots, seed)
    drawn = M.slots(sources, shard_slots, seed).collect()
    assert Counter((r.shard, r.sid, r["pass"], r.block) for r in drawn) == want
    places = Counter((r.shard, r.slot) for r in drawn)
    per_shard = Counter(r.shard for r in drawn)
    assert max(places.values()) == 1 and all(s < per_shard[k] for k, s in places)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1 + 2 * len(sources.collect())

    times = Counter()
    for (_, sid, _, block), n in want.items():
        times[sid, block] += n
    taken = Counter()
    for r in M.packing(rows, sources).collect():
        taken[r.doc_id] += r.words * times[r.sid, r.block]
    got = {r.doc_id: r.taken for r in M.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), shard_slots=shard_slots, seed=seed).collect()}
    assert got == {i: taken[i] for i, _, _ in docs}


def test_draws_decide_and_vary_between_shards(spark):
    prepare(spark)
    docs = [(i, f"s{i % 3}", "w " * 500) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    sources = M.targets(M.sized(df))
    counts = Counter((r.shard, r.sid) for r in M.slots(sources, 50).collect())
    shards = 1 + max(j for j, _ in counts)
    own = [counts[j, 0] for j in range(shards)]
    assert len(set(own)) > 1 and max(own) - min(own) <= 4
    taken = [sorted((r.doc_id, r.taken) for r in M.mix(df, shard_slots=n, seed=s).collect()) for n, s in ((50, 1), (7, 1), (50, 2))]
    assert taken[0] != taken[1] and taken[0] != taken[2]


def test_awkward_rows(spark):
    prepare(spark)
    df = tables.awkward(spark)
    check(M.mix(df).collect(), [(r.doc_id, r.source, r.text) for r in df.collect()], near=0.1)
    assert M.mix(tables.empty(spark)).count() == 0
    assert M.mixed_documents(df).columns == df.columns
    none = spark.createDataFrame([(1, "a", ""), (2, None, None), (2, None, None)], "doc_id long, source string, text string")
    assert [(r.target, r.taken) for r in M.mix(none).collect()] == [(0.0, 0)] * 3
    assert M.mixed_documents(tables.empty(spark)).count() == 0


def test_whole_copies_meet_the_targets(spark):
    """Documents of many blocks, whose rates lie near their source's ratio of target to size."""
    prepare(spark)
    docs = [(i, f"s{i % 6}", f"t{i} " + "w " * (300 + 37 * (i % 40))) for i in range(1200)]
    docs += [(5000 + i, "s1", f"t{i} " + "w " * 900) for i in range(700)] + [(7, "s1", docs[7][2])] * 3
    out = M.mixed_documents(spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(5)).collect()
    sizes, words = defaultdict(int), Counter()
    for _, s, t in docs:
        sizes[s] += size_of(t)
    for r in out:
        words[r.source] += size_of(r.text)
    want = M.targets_of(sizes)
    assert min(want[s] / sizes[s] for s in want) < 0.45
    for s, target in want.items():
        assert abs(words[s] - target) <= 0.03 * target
    had, got = Counter(docs), Counter((r.doc_id, r.source, r.text) for r in out)
    assert all(n <= M.MAX_REPEATS * had[d] for d, n in got.items())


def test_sources_at_their_limit_are_taken_whole(spark):
    """Sources of less than a block, or with a short last one, beside a hot source."""
    prepare(spark)
    docs = [(n, f"s{n:03}", "w " * n) for n in (1, 5, 10, 20, 64, 65, 100, 130)] + [(1000 + i, "z", "w " * 500) for i in range(200)]
    out = M.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    small = [r for r in out if r.source != "z"]
    assert len(small) == 8 and all(r.target == M.MAX_REPEATS * r.size == r.taken for r in small)
    hot = [r for r in out if r.source == "z"]
    assert abs(sum(r.taken for r in hot) - hot[0].target) <= M.BLOCK
