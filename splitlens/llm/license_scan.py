"""License scans: text blocks that contain nearly all words of a license template.

An exact containment join between the templates' word sets and the corpus' text blocks. A
template of n words is looked for in every block of 2 n words, wherever it starts; blocks that
start at one of the template's words are enough, as others hold no more of them. Template words
are ordered by their frequency in the whole corpus, rare ones first. A block that reaches the
threshold t shares a word with the prefix, the first ``|T| - ceil(t |T|) + 1`` template words;
only blocks around such words are looked at (prefix filter). A block with too few template
words, repeats included, is dropped (length filter), and so is one whose rarest template word
stands so late in the order that the words behind it, in the template or in the block, are too
few (positional filter). The distinct words of the rest are counted.

Licenses of one family differ in a word. If nearly all words of a template T are words of
another label's template U, then T's words that U lacks are required, whatever the threshold;
and where blocks of both overlap, the one with fewer template words is dropped, as U's text
alone would have matched T.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

THRESHOLD = 0.9
#: Phrases whose every place counts.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
_BSD = ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met")
_BSD_2 = ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
          "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
          "disclaimer in the documentation and or other materials provided with the distribution")
_BSD_3 = ("neither the name of the nor the names of its contributors may be used to endorse or promote products derived from this "
          "software without specific prior written permission")
#: Notices by label; a label may have several.
TEMPLATES = [
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
                 "http www apache org licenses license 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc0", "dedicated to the public domain under the cc0 1 0 universal public domain dedication"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-2", "gnu general public license version 2 june 1991"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-3", "gnu general public license version 3 29 june 2007"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("lgpl-3", "gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("agpl-3", "gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007"),
    ("bsd", f"{_BSD}"),
    ("bsd-2", f"{_BSD} {_BSD_2}"),
    ("bsd-3", f"{_BSD} {_BSD_2} {_BSD_3}"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


def _hashes(words: list[str]) -> np.ndarray:
    """Hashes of single words, as ``words.word_hashes`` gives them."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return W.word_hashes(data, offs, W.ASCII_OTHER)[0]


class Vocabulary:
    """Numbers of the words that templates and phrases use."""

    def __init__(self, templates=None, phrases=None):
        self.templates = [(label, text.split()) for label, text in (TEMPLATES if templates is None else templates)]
        self.phrases = [(label, text.split()) for label, text in (PHRASES if phrases is None else phrases).items()]
        self.words = sorted({w for _, t in self.templates + self.phrases for w in t})
        h = _hashes(self.words)
        self.order = np.argsort(h)
        self.sorted = h[self.order]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for others."""
        if not len(self.sorted):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)


def _chunks(column: pa.Array, vocabulary: Vocabulary):
    """Per chunk of rows: word numbers back to back, and each row's bounds in them."""
    data, offs = W.text_bytes(column)
    for lo, hi in W.chunks(offs):
        hashes, at = W.word_hashes(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], W.ASCII_OTHER)
        yield vocabulary.ids(hashes), at


def frequencies(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> np.ndarray:
    """How often each word of the vocabulary stands in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            for ids, _ in _chunks(batch.column(0), vocabulary):
                total += np.bincount(ids[ids >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    out = np.zeros(len(vocabulary.words), np.int64)
    for r in docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return out


class Scanner:
    """Templates in corpus order, ready to scan chunks."""

    def __init__(self, vocabulary: Vocabulary, counts: np.ndarray, threshold: float = THRESHOLD):
        number = {w: k for k, w in enumerate(vocabulary.words)}
        self.rank = np.empty(len(counts), np.int64)
        self.rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        self.phrases = [(label, [number[w] for w in ws]) for label, ws in vocabulary.phrases]
        self.templates = []
        for label, ws in vocabulary.templates:
            own = sorted({number[w] for w in ws}, key=lambda k: self.rank[k])
            need = ceil(threshold * len(own) - 1e-9)
            self.templates.append((label, len(ws), own, need))
        self.required: list[set[int]] = []
        self.confused: list[set[int]] = []
        for label, _, own, need in self.templates:
            near = [k for k, (other, _, its, _) in enumerate(self.templates) if other != label and len({*own} & {*its}) >= need]
            self.confused.append(set(near))
            self.required.append(set().union(*({*own} - {*self.templates[k][2]} for k in near)))
        self.members = np.zeros((len(self.templates), len(counts) + 1), bool)
        self.prefixes = np.zeros((len(self.templates), len(counts) + 1), bool)  # last column: other words
        for k, (_, _, own, need) in enumerate(self.templates):
            self.members[k, own] = True
            self.prefixes[k, own[:len(own) - need + 1]] = True

    def blocks(self, ids: np.ndarray, at: np.ndarray):
        """Yield (row, template, first word, end word, containment) of the blocks that meet the
        threshold and no block of a confused template covers better, row by row."""
        found: dict[int, list] = {}
        for k in range(len(self.templates)):
            for r, *block in self._blocks_of(k, ids, at):
                found.setdefault(r, []).append((k, *block))
        for r, own in sorted(found.items()):
            for k, a, z, n in own:
                better = any(o in self.confused[k] and m > n and a < end and first < z for o, first, end, m in own)
                if not better:
                    yield r, k, a, z, n / len(self.templates[k][2])

    def _candidates(self, k: int, ids: np.ndarray, at: np.ndarray):
        """Places of the template's words, the end (as a place) of the block from each, and the
        blocks that pass the filters."""
        _, length, own, need = self.templates[k]
        hits = np.flatnonzero(self.prefixes[k][ids])
        p = np.flatnonzero(self.members[k][ids]) if len(hits) else hits
        if not len(p):
            return p, p, p, p
        row = np.searchsorted(at, p, side="right") - 1
        i = np.arange(len(p))
        j = np.searchsorted(p, np.minimum(p + 2 * length, at[row + 1]))  # a block is p[i:j]
        behind = np.append(p, len(ids))[j - 1]
        some = np.flatnonzero((j - i >= need) & (np.searchsorted(hits, behind, side="right") > np.searchsorted(hits, p)))
        word = ids[p]

        def inside(w: int) -> np.ndarray:
            upto = np.append(0, np.cumsum(word == w))
            return upto[j[some]] - upto[some]

        if len(some):
            most, open_ = np.zeros(len(some), np.int64), np.ones(len(some), bool)
            for place, w in enumerate(own[:len(own) - need + 1]):  # the rarest word present
                n = inside(w)
                first = open_ & (n > 0)
                most[first] = 1 + np.minimum(len(own) - place - 1, j[some][first] - some[first] - n[first])
                open_ &= n == 0
            some = some[most >= need]
        for w in self.required[k]:
            some = some[inside(w) > 0] if len(some) else some
        return p, row, j, some

    def _blocks_of(self, k: int, ids: np.ndarray, at: np.ndarray):
        """Yield (row, first word, end word, template words) of one template's blocks, each cut to
        the words that count: in every stretch of overlapping blocks the first one with the most
        template words, and again behind it."""
        _, length, _, need = self.templates[k]
        p, row, j, some = self._candidates(k, ids, at)
        if not len(some):
            return
        word = ids[p]
        order = np.lexsort((np.arange(len(p)), word))
        last = np.full(len(p), -1)  # the place before of the same word
        again = word[order][1:] == word[order][:-1]
        last[order[1:][again]] = order[:-1][again]
        found = np.array([np.count_nonzero(last[a:j[a]] < a) for a in some.tolist()])
        some, found = some[found >= need], found[found >= need]
        n = 0
        while n < len(some):
            near = n + int(np.searchsorted(p[some[n:]], min(p[some[n]] + 2 * length, at[row[some[n]] + 1])))
            best = n + int(found[n:near].argmax())
            a = int(some[best])
            z = a + int(np.flatnonzero(last[a:j[a]] < a)[-1]) + 1
            while (word[a + 1:z] == word[a]).any():
                a += 1
            r = int(row[a])
            yield r, int(p[a] - at[r]), int(p[z - 1] + 1 - at[r]), int(found[best])
            n = int(np.searchsorted(some, z))

    def places(self, ids: np.ndarray, at: np.ndarray):
        """Yield (row, phrase, words) for every phrase that stands in a row."""
        for k, (_, phrase) in enumerate(self.phrases):
            m = len(phrase)
            n = len(ids) - m + 1
            if n <= 0:
                continue
            here = ids[:n] == phrase[0]
            for j in range(1, m):
                here &= ids[j:j + n] == phrase[j]
            p = np.flatnonzero(here)
            row = np.searchsorted(at, p, side="right") - 1
            inside = p + m <= at[row + 1]
            p, row = p[inside], row[inside]
            for r in np.unique(row):
                yield int(r), k, p[row == r] - at[r]


_MATCHES = "array<struct<label: string, template: int, first: long, end: long, containment: double>>"


def _scan(vocabulary: Vocabulary, counts: np.ndarray, threshold: float, names: list[str], at_text: int):
    match = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), match]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(vocabulary, counts, threshold)
        for batch in batches:
            out = []
            for ids, at in _chunks(batch.column(at_text), vocabulary):
                base: dict[int, list] = {}
                for r, k, p in scanner.places(ids, at):
                    base.setdefault(r, []).append((scanner.phrases[k][0], p))
                blocks: dict[int, list] = {}
                for r, k, a, b, c in scanner.blocks(ids, at):
                    blocks.setdefault(r, []).append({"label": scanner.templates[k][0], "template": k, "first": a, "end": b, "containment": c})
                for r in range(len(at) - 1):
                    p = np.concatenate([x for _, x in base[r]]) if r in base else None
                    own, more = {x for x, _ in base.get(r, [])}, blocks.get(r, [])
                    labels = own | {x["label"] for x in more}
                    score = max([1.0] * bool(own) + [x["containment"] for x in more], default=0.0)
                    out.append((int(at[r + 1] - at[r]), 0 if p is None else len(p), None if p is None else int(p.min()), None if p is None else int(p.max()),
                                ",".join(sorted(own)), ",".join(sorted(labels)), score, more))
            columns = list(zip(*out)) if out else [()] * len(kinds)
            struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                                names=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*names, "license"])
    return run


def scan(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, templates=None, phrases=None) -> DataFrame:
    """``docs`` with a struct ``license``: n_words, n_base, first_word, last_word, base_labels,
    labels, score and the matching blocks.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; whole texts are read.
    Null and empty texts have no words, labels '' and score 0. The score is the largest
    containment of a block found, 1 where a phrase stands. Repeated rows are scanned each; other
    columns pass through, but for one named ``license``, which the result replaces. Words of equal frequency
    are ordered by name, so results do not depend on the partitioning; they do not depend on the
    frequencies either, which only decide how many blocks are looked at.
    """
    docs = docs.drop("license")
    vocabulary = Vocabulary(templates, phrases)
    counts = frequencies(docs, vocabulary, text)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    out = (f"license struct<n_words: long, n_base: long, first_word: long, last_word: long, base_labels: string, labels: string, "
           f"score: double, matches: {_MATCHES}>")
    return docs.mapInArrow(_scan(vocabulary, counts, threshold, docs.columns, docs.columns.index(text)), f"{fields}, {out}")
