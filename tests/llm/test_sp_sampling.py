"""SentencePiece sampling: exact round trips, and frequencies against all segmentations."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from splitlens.llm import sp_sampling as S
from splitlens.llm.registry import QUERIES
from splitlens.llm.staging import prepare, tokenizer_path

from . import tables

V = S.vocabulary(tokenizer_path(S.VOCABULARY))


def paths(g, pos):
    for e in range(g.first[pos], g.stop[pos]):
        for rest, p in [((), 1.0)] if g.last[e] else paths(g, g.end[e]):
            yield (e, *rest), p * g.p[e]


def test_lattice_has_all_segmentations_with_their_weights():
    g = S.lattices(S.units_of("abbd"), V)
    found = dict(paths(g, 0))
    pieces = {V.text[i]: i for i in range(259, len(V.text)) if V.text[i]}
    weight = {int(V.piece[n]): V.weight[n] for n in range(len(V.piece)) if V.piece[n] >= 0}

    def splits(t):
        if not t:
            yield ()
        for i in range(1, len(t) + 1):
            if t[:i] in pieces:
                yield from ((pieces[t[:i]], *r) for r in splits(t[i:]))

    want = {s: np.prod([weight[i] for i in s]) for s in splits(b" abbd")}
    total = sum(want.values())
    got = {tuple(g.piece[list(e)].tolist()): p for e, p in found.items()}
    assert set(got) == set(want) and all(got[s] == pytest.approx(w / total) for s, w in want.items())


@pytest.mark.parametrize("text", ["abbd", "of it"])
def test_pairs_come_as_often_as_without_replacement(text):
    units = S.units_of(text)
    g = S.lattices(units, V)
    every = [((), 1.0)]
    for k in range(len(units)):
        every = [(a + b, p * q) for a, p in every for b, q in paths(g, g.start[k])]
    prob, n = dict(every), 8000
    rows = S.sample(np.tile(np.arange(len(units)), n), np.arange(n + 1) * len(units), np.arange(n).astype(np.uint64) * np.uint64(977), g, 2)
    one, two, included, estimate = Counter(), Counter(), Counter(), Counter()
    for (a, b), threshold in rows:
        assert a.value >= b.value >= threshold
        a_, b_ = tuple(a.edges.tolist()), tuple(b.edges.tolist())
        one[a_] += 1
        two[a_, b_] += 1
        for path, edges in ((a, a_), (b, b_)):
            included[edges] += 1
            estimate[edges] += prob[edges] / np.exp(S.log_inclusion(float(path.log_p.sum()), threshold))
    for a, p in prob.items():
        assert abs(one[a] - n * p) < 5 * np.sqrt(n * p * (1 - p)) + 1
        for b, q in prob.items():
            if a != b:
                x = p * q / (1 - p)
                assert abs(two[a, b] - n * x) < 5 * np.sqrt(n * x) + 2
    # weights p / inclusion make sums over samples unbiased: the total probability is 1
    assert sum(estimate.values()) / n == pytest.approx(1, abs=0.05)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.integers(1, 4))
def test_round_trip_of_any_text(text, k):
    text = text.encode("utf-8", "ignore").decode()
    rows = next(iter(S.encodings([text], np.array([5], np.uint64), V, k)))
    assert all(V.decode(ids.tolist()) == text for ids, *_ in rows)
    assert len({ids.tobytes() for ids, *_ in rows}) == len(rows) <= k
    assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)


def test_ids_are_the_library_s(spark):
    prepare(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(S.VOCABULARY))
    texts = ["It was a fine day.", "Größe und\nMaß", "naïve 你好"]
    for t, rows in zip(texts, S.encodings(texts, np.arange(3, dtype=np.uint64), V, 3)):
        for ids, *_ in rows:
            assert sp.decode(ids.tolist()) == t


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_decodes_every_text(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = QUERIES["op2_sentencepiece_sampling"](spark, path).collect()
    assert len(rows) == docs.count()
    assert all(r.decoded and r.n_distinct == r.n_samples for r in rows)
    again = S.digests(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.ids_crc32, r.log_inclusions) for r in rows) == sorted((r.doc_id, r.ids_crc32, r.log_inclusions) for r in again)


def test_awkward_rows(spark):
    prepare(spark)
    df = tables.awkward(spark)
    out = S.encode(df, k=3)
    rows = out.collect()
    assert out.columns == [*df.columns, "samples"] and len(rows) == df.count()
    for r in rows:
        assert all(V.decode(s.ids) == (r.text or "") for s in r.samples)
        if not r.text:
            assert [(list(s.ids), s.log_inclusion) for s in r.samples] == [([], 0.0)]
    from pyspark.sql import functions as F

    flat = out.select("text", F.explode("samples").alias("s")).select("text", "s.ids")
    assert all(r.decoded == (r.text or "") for r in S.decode(flat).collect())
    assert S.encode(tables.empty(spark)).count() == 0 and S.digests(tables.empty(spark)).count() == 0


def test_units_are_numbered_in_one_pass_and_ids_leave_in_slices(spark, monkeypatch):
    lists = [["a", "b", "a"], [], ["c", "b"]]
    own, known = S._numbered(lists)
    assert [x.tolist() for x in own] == [[0, 1, 0], [], [2, 1]] and list(known) == ["a", "b", "c"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(S.ROWS))
    docs = spark.createDataFrame([(i, f"word {i} again and {i % 7} more") for i in range(700)], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in S.encode(docs).collect()}
    assert len(rows) == 700 and all(V.decode(x.ids) == r.text for r in rows.values() for x in r.samples)
    handed = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: handed.append(run) or self)
    S.encode(docs)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(700), pa.int64()), "text": pa.array([rows[i].text for i in range(700)]),
                                        "_key": pa.array(range(700), pa.int64())})
    assert [b.num_rows for b in handed[0](iter([batch]))] == [256, 256, 188]


def test_a_group_s_units_are_cut_and_numbered_as_arrays_with_the_samples_as_they_were():
    texts = ["It was a fine day.\nIt was a fine night.", "", "zero\0 and ▁ mark, 你好 " + "x" * 150, None, "\n", "a  a\n\n\0▁ \n😀", " "]
    lists, known = S._numbered([S._cut(S.units_of(t or "")) for t in texts])
    units, bounds, chars, size = S._split(texts)
    assert [units[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [x.tolist() for x in lists]
    whole, ends = "".join(map(chr, chars)), np.cumsum(size)
    assert [whole[b - n:b] for b, n in zip(ends, size)] == list(known)
    assert [len(x) for x in S._split([])] == [0, 1, 0, 0] and S._split([None, ""])[1].tolist() == [0, 0, 0]
    found = list(S.encodings(texts[:3], np.arange(3, dtype=np.uint64), V, 3))
    assert [[(len(ids), zlib.crc32(ids.tobytes()), round(p, 6)) for ids, p, *_ in rows] for rows in found] == [
        [(15, 3290854281, -7.747455), (14, 144050380, -2.490801), (13, 357657321, -1.206426)],
        [(0, 0, 0.0)],
        [(67, 1102408069, -29.503398), (68, 2879038519, -35.028144), (68, 2966624237, -33.500747)],
    ]


def whole_lattice(text, v=V):
    units, _, chars, size = S._split([text], v)
    return units, S._lattices(chars, size, v)


def log_weights(text):
    """Log of the sum over all segmentations of a text, and of one given as ids, piece by piece."""
    weight = {V.text[i].decode(): float(V.weight[n]) for n, i in enumerate(V.piece.tolist()) if i >= 0}
    marked, total = " " + text, [0.0]
    for b in range(1, len(marked) + 1):
        ways = [total[a] + np.log(weight[marked[a:b]]) for a in range(max(0, b - 16), b) if marked[a:b] in weight]
        if marked[b - 1] not in weight:
            ways.append(total[b - 1] + np.log(V.fallback))
        total.append(np.logaddexp.reduce(ways))
    return total[-1], lambda ids: sum(np.log(weight.get(V.text[i].decode(), V.fallback)) for i in ids)


UNSPACED = ["x" * 150, "a  b", "    return  x   ", "=" * 70 + "\n" + " " * 40 + "y", "https://example.com/" + "aGVsbG8gd29ybGQ" * 9, "xy" * 3000]


def test_samples_are_of_the_whole_lattice_of_long_units_and_runs_of_spaces(spark):
    prepare(spark)
    docs = spark.createDataFrame(list(enumerate(UNSPACED)), "doc_id long, text string").coalesce(1)
    short = {r.doc_id: r for r in S.digests(docs, k=3).collect()}
    for r in S.encode(docs, k=3).collect():
        total, of = log_weights(r.text)
        assert len(r.samples) == 3 and all(V.decode(s.ids) == r.text for s in r.samples)
        assert [s.log_prob for s in r.samples] == pytest.approx([of(s.ids) - total for s in r.samples], abs=1e-6)
        assert short[r.doc_id].log_probs == ",".join(f"{s.log_prob:.6f}" for s in r.samples) and short[r.doc_id].decoded


def test_the_library_s_encoding_is_a_path_of_the_lattice():
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(S.VOCABULARY))
    for text in [*UNSPACED, "你好世界" * 40, "  \n\n  a", "é" * 100]:
        units, g = whole_lattice(text)
        want, i = sp.encode(text), 0
        for pos in g.start[units].tolist():
            while pos < len(g.chars):
                edges = {tuple(V.tokens(g, np.array([e])).tolist()): e for e in range(g.first[pos], g.stop[pos])}
                ids, = (x for x in edges if tuple(want[i:i + len(x)]) == x)
                pos, i = int(g.end[edges[ids]]), i + len(ids)
        assert i == len(want) and V.decode(want) == text


@pytest.mark.parametrize("text,unlikely,levels", [("a  b", -60.0, 4096), ("abbd", 1.0, 4096), ("of  it", -1.0, 4096), ("abbd", -1.0, 1)])
def test_pairs_come_as_often_with_runs_of_spaces_split_tails_and_single_steps(monkeypatch, text, unlikely, levels):
    monkeypatch.setattr(S, "UNLIKELY", unlikely)
    monkeypatch.setattr(S, "PLAIN", 0)
    monkeypatch.setattr(S, "LEVELS", levels)
    units, g = whole_lattice(text)
    every = [((), 1.0)]
    for u in units:
        every = [(a + b, p * q) for a, p in every for b, q in paths(g, g.start[u])]
    prob, n = dict(every), 8000
    rows = S.sample(np.tile(units, n), np.arange(n + 1) * len(units), np.arange(n).astype(np.uint64) * np.uint64(977), g, 2)
    two, estimate = Counter(), Counter()
    for (a, b), threshold in rows:
        assert a.value >= b.value >= threshold
        two[tuple(a.edges.tolist()), tuple(b.edges.tolist())] += 1
        for path in (a, b):
            edges = tuple(path.edges.tolist())
            estimate[edges] += prob[edges] / np.exp(S.log_inclusion(float(path.log_p.sum()), threshold))
    for a, p in prob.items():
        for b, q in prob.items():
            x = p * q / (1 - p)
            assert two[a, b] == 0 if a == b else abs(two[a, b] - n * x) < 5 * np.sqrt(n * x) + 2
    assert sum(estimate.values()) / n == pytest.approx(1, abs=0.05)


def test_sums_by_powers_and_one_by_one_are_the_plain_ones(monkeypatch):
    units = ["▁" + "x" * 30, "▁▁▁▁▁▁▁ab", "▁hello", "▁" + "é==" * 9]
    plain = S.lattices(units, V)
    for least, levels in ((0, 4096), (0, 3), (3, 8)):
        monkeypatch.setattr(S, "PLAIN", least)
        monkeypatch.setattr(S, "LEVELS", levels)
        g = S.lattices(units, V)
        assert g.p.tolist() == pytest.approx(plain.p.tolist(), rel=1e-12)
        assert all(np.array_equal(a, b) for a, b in ((g.chars, plain.chars), (g.end, plain.end), (g.piece, plain.piece)))


def test_segmentations_that_are_next_to_impossible_are_still_drawn():
    sharp = S.Vocabulary(tokenizer_path(S.VOCABULARY), alpha=8.0)
    for text in ("of", "the  of"):
        units, g = whole_lattice(text, sharp)
        every = int(np.prod([len(list(paths(g, g.start[u]))) for u in units]))
        rows = next(S.encodings([text], np.array([5], np.uint64), sharp, every + 1, whole=True))
        assert len({ids.tobytes() for ids, *_ in rows}) == len(rows) == every > 2
        assert all(sharp.decode(ids.tolist()) == text for ids, *_ in rows)


def test_few_walks_one_by_one_take_the_steps_of_many(monkeypatch):
    texts, keys = [*UNSPACED, "plain words"], np.arange(len(UNSPACED) + 1, dtype=np.uint64)
    found = []
    for narrow in (0, 32):
        monkeypatch.setattr(S, "NARROW", narrow)
        found.append([[(ids.tolist(), *x) for ids, *x in rows] for rows in S.encodings(texts, keys, V, 3, whole=True)])
    assert found[0] == found[1]
    for text, key, rows in zip(texts, keys, found[0]):
        assert [ids for ids, *_ in rows] == [ids.tolist() for ids, *_ in next(S.encodings([text], np.array([key]), V, 3, whole=True))]
