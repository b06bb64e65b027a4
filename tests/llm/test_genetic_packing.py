"""Packing: pieces against the whole-text tokenizer, bins against exhaustive search."""

import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from splitlens.llm import genetic_packing as G
from splitlens.llm.registry import QUERIES
from splitlens.llm.staging import prepare, tokenizer_path

from . import tables

TOKENIZER = Tokenizer.from_file(tokenizer_path(G.VOCABULARY))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def cut(doc_id, text, capacity=2048):
    ids = ids_of(text)
    return [(str(doc_id), k // capacity, k, len(ids[k:k + capacity]), crc32(np.array(ids[k:k + capacity], "<u4").tobytes())) for k in range(0, len(ids), capacity)]


def gapless(rows, capacity=2048):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def fewest(lengths, capacity):
    """The least number of bins, by trying every bin for every piece."""
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def put(i, free):
        if len(free) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(free)
            return
        for b in {room: k for k, room in enumerate(free) if room >= lengths[i]}.values():
            free[b] -= lengths[i]
            put(i + 1, free)
            free[b] += lengths[i]
        put(i + 1, [*free, capacity - lengths[i]])

    put(0, [])
    return best[0]


def valid(bins, lengths, capacity):
    assert sorted(i for own in bins for i in own) == list(range(len(lengths)))
    assert all(own and sum(lengths[i] for i in own) <= capacity for own in bins)


def test_bounds_and_operators_on_small_regions():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([20, 50, 100])
        lengths = sorted((rng.randint(1, capacity - 1) for _ in range(rng.randint(1, 9))), reverse=True)
        least = fewest(lengths, capacity)
        bound = G.lower_bound(np.array(lengths), capacity)
        assert -(-sum(lengths) // capacity) <= bound <= least
        first = G.seeded(lengths, rng, capacity=capacity)
        for p in first:
            valid(p, lengths, capacity)
        for p in (G.crossover(first[0], first[-1], lengths, rng, capacity), G.mutated(first[0], lengths, rng, capacity)):
            valid(p, lengths, capacity)
        last = G.evolved(first, lengths, bound, rng, capacity=capacity)
        valid(last[0], lengths, capacity)
        assert least <= len(last[0]) <= len(first[0])


def test_crossover_keeps_injected_bins():
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 90) for _ in range(60)), reverse=True)
    one, other = G.seeded(lengths, rng, 2, 100)
    full = [set(b) for b in other if sum(lengths[i] for i in b) == 100]
    child = G.crossover(one, other, lengths, rng, 100)
    assert full and any(set(b) in full for b in child)


def test_evolution_beats_best_fit_decreasing():
    """Triplets: every bin holds exactly three pieces, and best-fit decreasing wastes bins."""
    won = 0
    for seed in range(4):
        rng = random.Random(seed)
        lengths = []
        for _ in range(20):
            a, b = rng.randint(380, 490), rng.randint(250, 300)
            lengths += [a, b, 1000 - a - b]
        lengths.sort(reverse=True)
        first = G.seeded(lengths, rng, 12, 1000)
        last = G.evolved(first, lengths, 20, rng, 300, 1000)
        valid(last[0], lengths, 1000)
        won += len(G.best_fit(list(range(60)), lengths, [], 1000)) > len(last[0])
    assert won >= 2


def test_islands_through_spark(spark):
    prepare(spark)
    rng = random.Random(8)
    regions = []
    for region in range(4):
        lengths = []
        for _ in range(12):
            a, b = rng.randint(380, 490), rng.randint(250, 300)
            lengths += [a, b, 1000 - a - b]
        regions.append((region, sorted(lengths, reverse=True)))
    df = spark.createDataFrame(regions, "region long, lengths array<int>")
    runs = [sorted((r.region, r.best) for r in G.solve(df, 1000, epochs=3, generations=20).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and [r for r, _ in runs[0]] == [0, 1, 2, 3]
    before = after = 0
    for (_, lengths), (_, best) in zip(regions, runs[0]):
        bins = G._bins(best)
        valid(bins, lengths, 1000)
        before += len(G.best_fit(list(range(len(lengths))), lengths, [], 1000))
        after += len(bins)
    assert after < before


def test_levels_join_what_regions_leave(spark):
    prepare(spark)
    rng = random.Random(4)
    rows = [(i, rng.choice([2048, 700, 300, 130, 40, 9])) for i in range(3000)]
    df = spark.createDataFrame(rows, "row long, length int")
    got = G.pack(df, region=100).join(df, "row").collect()
    assert sorted((r.row, r.length) for r in got) == sorted(rows)
    least = G.lower_bound(np.array([n for _, n in rows]))
    assert least <= gapless(got) <= least + 2  # 30 regions would leave about 15 more


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_whole_texts(spark, sf):
    path = f"/root/testdata/{sf}"
    got = QUERIES["op12_genetic_packing"](spark, path).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(x for r in docs for x in cut(r.doc_id, r.text))
    assert gapless(got) <= 1 + G.lower_bound(np.array([r.length for r in got]))


def test_awkward_rows_and_sequences(spark):
    prepare(spark)
    rng = random.Random(1)
    mixed = ["".join(rng.choice("ab1'2.,-<|>\"sStT ré’\x1c\u0301\u00a0") for _ in range(300)) for _ in range(40)]
    more = [(100 + i, t) for i, t in enumerate(mixed)] + [(140, "it's '90s rock'n'roll 'tis dogs' \"'re\" x'll'd 1'2st a.b'ce 'S")]
    more += [(70, "<|endoftext|> in<|startoftext|>side"), (71, "don't 've ΣΑΣ ΑΣ İ"), (72, "é ́x A B　C"), (73, "z" * 9000)]
    df = tables.awkward(spark).unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = G.packed(df).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(x for r in df.collect() for x in cut(r.doc_id, r.text))
    gapless(got)
    assert G.packed(tables.empty(spark)).count() == 0
    own = G.sequences(df).collect()
    assert all(0 < len(r.ids) <= 2048 for r in own)
    assert sorted(t for r in own for t in r.ids) == sorted(t for r in df.collect() for t in ids_of(r.text))


def test_words_are_encoded_many_at_once(monkeypatch):
    path = tokenizer_path(G.VOCABULARY)
    known, texts = G._Known(path), []
    monkeypatch.setitem(G._models, path, known)
    rng = random.Random(5)
    signs = ["ab", "Z", "7", "'s", "'", "-", "<|", "<|endoftext|>", "\x01", "\x02", "\x1c", " ", "é", "é", "́", "ς", "中", "😀", "½"]
    odd = ["".join(rng.choices(signs, k=rng.randint(1, 6))) for _ in range(3000)]
    plain = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(3000)]
    words = list(dict.fromkeys([*odd, *plain, "'s", " "]))
    want = [e.ids for e in known.model.encode_batch(words, add_special_tokens=False)]
    encoded = known._encoded
    monkeypatch.setattr(known, "_encoded", lambda x: texts.extend(x) or encoded(x))
    for _ in range(2):
        ids, first, many = G._ids(path, pa.array(words, pa.large_string()))
        assert [ids[a:a + n].tolist() for a, n in zip(first, many)] == want
    assert len(plain) > 2900 and len(texts) < len(words) - 2900
