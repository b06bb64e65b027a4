"""License scans against a plain scan of all blocks."""

import random
import re
from math import ceil

import pytest

from splitlens.llm import license_scan as L
from splitlens.llm.registry import QUERIES
from splitlens.llm.staging import prepare

from . import tables


def sets_of(templates):
    own = [(label, len(t.split()), set(t.split())) for label, t in templates]
    need = [ceil(0.9 * len(t) - 1e-9) for _, _, t in own]
    near = [[o for o, (other, _, u) in enumerate(own) if other != label and len(t & u) >= need[k]] for k, (label, _, t) in enumerate(own)]
    must = [set().union(*(t - own[o][2] for o in near[k])) for k, (_, _, t) in enumerate(own)]
    return own, need, near, must


SETS = sets_of(L.TEMPLATES)


def scan_of(text, sets=SETS):
    """One text by plain string work over every block of every template."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(label, i) for label, p in L.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    base = {x for x, _ in places}
    blocks = []
    for k, ((_, n, t), need, must) in enumerate(zip(*(sets[i] for i in (0, 1, 3)))):
        starts = [i for i, x in enumerate(w) if x in t]
        good = []
        if len(starts) >= need:
            for i in starts:
                seen = t.intersection(w[i:i + 2 * n])
                if len(seen) >= need and must <= seen:
                    good.append((i, len(seen)))
        while good:
            stretch = [(i, m) for i, m in good if i < good[0][0] + 2 * n]
            i, m = max(stretch, key=lambda x: (x[1], -x[0]))
            first = {}
            for at in range(i, min(i + 2 * n, len(w))):
                if w[at] in t:
                    first.setdefault(w[at], at)
            end = max(first.values()) + 1
            while w[i] not in t or w[i] in w[i + 1:end]:
                i += 1
            blocks.append((k, i, end, m))
            good = [g for g in good if g[0] >= end]
    kept = [(k, a, z, n) for k, a, z, n in blocks
            if not any(o in sets[2][k] and m > n and a < e and s < z for o, s, e, m in blocks)]
    labels = base | {sets[0][k][0] for k, *_ in kept}
    score = max([1.0] * bool(base) + [n / len(sets[0][k][2]) for k, _, _, n in kept], default=0.0)
    at = [i for _, i in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def row(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_plain_scan(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = QUERIES["op5_license_scan"](spark, path).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert row(r) == scan_of(docs[r.doc_id])
    if sf == "sf0.01":
        assert {"gpl-3", "apache-2"} <= {x for r in got for x in r.labels.split(",")}


def test_shuffled_and_partial_templates(spark):
    prepare(spark)
    rng = random.Random(9)
    vocabulary = [w for _, t in L.TEMPLATES for w in t.split()]
    texts = []
    for _ in range(150):
        _, t = rng.choice(L.TEMPLATES)
        w = t.split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(["other", "Straße", "x"])
        noise = lambda: [rng.choice([*vocabulary, "ja", "nein", "été"]) for _ in range(rng.randrange(40))]
        texts.append(rng.choice([" ", ", ", "\n"]).join([*noise(), *w, *noise()]).upper())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in L.scan(df).collect():
        assert row(r.license) == scan_of(r.text)


def test_awkward_rows(spark):
    prepare(spark)
    df = tables.awkward(spark)
    out = L.scan(df).collect()
    assert len(out) == df.count()
    for r in out:
        assert row(r.license) == scan_of(r.text)
    assert L.scan(tables.empty(spark)).count() == 0
    with_phrase = spark.createDataFrame([(1, "CC BY-NC, cc by\nnc; under the MIT-License cc by"), (2, "under the MIT"), (3, "License cc")], "doc_id long, text string")
    got = {r.doc_id: r.license for r in L.scan(with_phrase).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 6, "cc-by-nc,mit")
    assert got[2].n_base == 0 and got[3].first_word is None


def test_a_notice_has_its_label_at_every_offset(spark):
    prepare(spark)
    notices = [("gpl-3", "licensed under the terms of the GNU General Public License version 3"), ("mit", "licensed under the terms of the MIT license"),
               ("apache-2", "licensed under the terms of the Apache license, version 2.0")]
    rows = [(label, k, "word " * k + notice + " tail" * 30, len(notice.replace(".", " ").split())) for label, notice in notices for k in range(50)]
    rows += [(label, k, "word " * k + notice, len(notice.replace(".", " ").split())) for label, notice in notices for k in range(20)]
    df = spark.createDataFrame(rows, "want string, k int, text string, n int")
    labels = {label: set() for label, _ in notices}
    for r in L.scan(df).collect():
        assert r.want in r.license.labels.split(","), (r.k, r.text)
        assert row(r.license) == scan_of(r.text)
        assert [(m.first, m.end) for m in r.license.matches if m.label == r.want] == [(r.k, r.k + r.n)]
        labels[r.want].add(r.license.labels)
    assert all(len(x) == 1 for x in labels.values())
    two = L.scan(spark.createDataFrame([(" ".join(["x"] * 3 + [notices[1][1]] + ["y"] * 2 + [notices[1][1]] * 2),)], "text string")).first().license
    assert [(m.first, m.end) for m in two.matches if m.label == "mit"] == [(3, 11), (13, 21), (21, 29)]


EXACT = [
    ("gpl-3", "This program is licensed under the GNU General Public License version 3."),
    ("gpl-3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License version 3"),
    ("lgpl-3", "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("agpl-3", "licensed under the GNU Affero General Public License version 3"),
    ("agpl-3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("mit", "licensed under the terms of the MIT license"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("apache-2,mit", "licensed under the MIT license or the Apache License, Version 2.0"),
    ("agpl-3,gpl-3", "licensed under the GNU Affero General Public License version 3" + " and more words here" * 8 + " licensed under the GNU General Public License version 3"),
    ("bsd", L._BSD),
    ("bsd-2", L._BSD + ": * " + L._BSD_2),
    ("bsd-3", L._BSD + ": 1. " + L._BSD_2 + " 3. " + L._BSD_3.replace("the nor", "the copyright holder nor")),
    ("", "the general public may license this version of the song"),
]


def test_each_license_has_its_own_label_at_every_offset(spark):
    prepare(spark)
    rows = [(label, k, "word " * k + notice + " tail" * (k % 7)) for label, notice in EXACT for k in range(25)]
    for r in L.scan(spark.createDataFrame(rows, "want string, k int, text string")).collect():
        assert r.license.labels == r.want, (r.k, r.text)
        assert row(r.license) == scan_of(r.text)


def test_required_words_and_a_clashing_column(spark):
    prepare(spark)
    named = dict(zip([t for _, t in L.TEMPLATES], SETS[3]))
    assert named["licensed under the gnu lesser general public license version 3"] == {"lesser"}
    df = spark.createDataFrame([("licensed under the MIT license", 5)], "text string, license int")
    assert L.scan(df).first().license.labels == "mit"
