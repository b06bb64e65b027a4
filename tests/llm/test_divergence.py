"""Transducers against sorted lists, and the audit against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from splitlens.llm import divergence, transducer
from splitlens.llm.staging import prepare

from . import tables

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def plain(rows, min_docs, top):
    """The audit of (text, lang, source) rows in whole numbers."""
    docs = [(Counter(lower(x) for x in TERM.findall(t or "")), a or "", s or "") for t, a, s in rows]
    found = defaultdict(Counter)
    for words, lang, _ in docs:
        found[lang].update(set(words))
    out = []
    for lang in {a for _, a, _ in docs}:
        kept = sorted((w for w, n in found[lang].items() if n >= min_docs), key=lambda w: w.encode())
        counts = defaultdict(Counter)
        for words, a, s in docs:
            if a == lang:
                counts[s].update({w: words[w] for w in kept if words[w]})
        whole = sum(counts.values(), Counter())

        def shares(c):
            return {w: 1 + 1000000000 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in p:
            apart = sorted(((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in p if o != s))
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(apart)]
            above = sorted((q[w] - p[s][w], w.encode()) for w in kept if counts[s][w] and p[s][w] > q[w])
            out += [(lang, s, "term", w.decode(), -v, k + 1) for k, (v, w) in enumerate(above[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé你", max_size=6), max_size=60))
def test_transducer_against_list(found):
    words = sorted(w.encode() for w in found)
    t = transducer.build(words)
    asked = [*words, b"zz", "aé".encode(), b"", b"abab"]
    data, offs = np.frombuffer(b"".join(asked), np.uint8), np.cumsum([0, *map(len, asked)])
    assert t.ordinals(data, offs).tolist() == [words.index(w) if w in words else -1 for w in asked]
    assert [t.string(i) for i in range(len(words))] == words
    rests = {}  # a minimal automaton has a state for each set of rests
    for w in {w[:i] for w in words for i in range(len(w) + 1)}:
        rests[w] = frozenset(x[len(w):] for x in words if x.startswith(w))
    assert len(t.final) == max(1, len(set(rests.values())))


def test_order_is_asked_for():
    for bad in ([b"b", b"a"], [b"a", b"a"]):
        with pytest.raises(ValueError):
            transducer.build(bad)


def test_shards_find_their_terms():
    words = sorted({f"{a}{b}" for a in "aébcz" for b in range(40)}, key=str.encode)
    rows, base = [], 0
    for k in range(0, len(words), 37):
        t = transducer.build([w.encode() for w in words[k:k + 37]])
        rows.append({"lang": "x", "shard": k // 37, "first": words[k], "base": base, "size": t.size, "start": t.start,
                     **{c: getattr(t, c).tobytes() for c in ("keys", "target", "skip", "final")}})
        base += t.size
    known = divergence.Vocabulary(rows[::-1])
    asked = [*words, "", "a", "zzz", "b1x", "é"]
    assert known.ordinals("x", pa.array(asked, pa.large_string())).tolist() == [words.index(w) if w in words else -1 for w in asked]
    assert known.ordinals("y", pa.array(["a1"])).tolist() == [-1]


def small(spark):
    import random

    rng, words = random.Random(3), ["alpha", "Beta", "GAMMA", "été", "你好", "a", "zeta", "eta", "x-y", "éa"]
    rows = []
    for i in range(160):
        text = " ".join(rng.choices(words, [9, 5, 4, 3, 3, 2, 2, 1, 1, 1], k=rng.randint(0, 12)))
        rows.append((None if i % 31 == 0 else text, [None, "", "en", "de"][i % 4], [None, "", "s1", "s2", "sé"][i % 5]))
    rows += [("alpha beta", "fr", "lone"), ("only here", "it", "a"), (None, "it", "b"), ("", "it", None)]
    return spark.createDataFrame(rows, "text string, lang string, source string"), rows


def test_both_ways_of_recounting(spark):
    prepare(spark)
    df, rows = small(spark)
    want = plain(rows, 8, 4)
    assert want and {r[2] for r in want} == {"pair", "term"}
    assert rows_of(divergence.audit(df, 8, 4)) == want
    assert rows_of(divergence.audit(df, 8, 4, broadcast_bytes=0, shard_terms=2)) == want
    assert rows_of(divergence.audit(df, 8, 4, shard_terms=3, block=3, tile=2)) == want


def test_awkward_rows(spark):
    prepare(spark)
    df = tables.awkward(spark)
    for least in (1, 30):
        want = plain([(r.text, r.lang, r.source) for r in df.collect()], least, 50)
        assert rows_of(divergence.audit(df, least)) == want
    assert divergence.audit(tables.empty(spark)).count() == 0


def test_shares_beyond_long(spark):
    n, total, size = 3 * 10 ** 13, 8 * 10 ** 13, 5 * 10 ** 7
    got = spark.createDataFrame([(n, total, size)], "n long, total long, size long").select(divergence.share(F.col("n"), F.col("total"), F.col("size"))).first()[0]
    assert got == 1 + 10 ** 9 * (n + 5) // (total + 5 * size)
