"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

1. *Pieces.* Every text's ids and a closing id are cut into pieces of at most ``CAPACITY``. Full
   pieces are sequences of their own.
2. *Regions.* The others are dealt by hash into regions of about ``REGION`` pieces, each a bin
   packing problem of its own; their number grows with the data. Best-fit decreasing packs a
   region first. If that uses as many bins as a lower bound asks for, the region is done.
3. *Islands.* Any other region is given to ``ISLANDS`` islands, each a row with a population of
   its own. A chromosome is a set of bins. Crossover injects whole well-filled bins of one
   parent into the other, removes the bins that hold one of their pieces too, and best-fits the
   displaced pieces; mutation dissolves ill-filled bins the same way. After every epoch each
   island's best goes to the next island of its region, by a window over the region's few rows.
4. *Levels.* Bins that stay too empty are dissolved, and their pieces dealt to new regions, as
   long as that makes fewer bins: at last no region's rest is left over.

Every epoch and level is a stage table, so a lost executor repeats one step of its regions.
"""

from __future__ import annotations

import os
import random
from collections.abc import Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .staging import staged, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END = 2048, 0
REGION = 2048
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 2, 6, 6
#: Bins with more free places are dissolved for the next level; levels end when fewer than this
#: share of the pieces leaves.
LOOSE, SHRINK, LEVELS = 16, 0.5, 7
_KNOWN_WORDS = 1 << 20
#: The vocabulary never joins a letter, a digit and another sign, nor two digits, but for what
#: follows an apostrophe; bytes of other scripts and controls are left to it.
_KINDS_OF_BYTES = np.zeros(256, np.uint8)
_KINDS_OF_BYTES[0x21:0x7F] = 3
_KINDS_OF_BYTES[ord("'")] = 0
_KINDS_OF_BYTES[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 2
_KINDS_OF_BYTES[0x30:0x3A] = 1
_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
#: Words encoded as one text, and the control sign that parts them there, one id of its own.
JOINED, _MARK = 128, "\x01"
_models: dict = {}

Bins = list[list[int]]


# -- pieces ----------------------------------------------------------------------------------
class _Known:
    """The vocabulary, and the ids of the words encoded so far: those of word number ``i`` are
    ``ids[first[i]:first[i + 1]]``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        pieces = self.model.get_vocab()
        self.last = np.zeros(max(pieces.values()) + 1, bool)  # ids that end a run
        self.last[[i for p, i in pieces.items() if p.endswith("</w>")]] = True
        self.mark = np.zeros(len(self.last), bool)
        mark = self._encoded([_MARK])[0]
        self.mark[mark] = len(mark) == 1
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words back to back, and how many each has; words encoded one by one."""
        found = self._encoded(words)
        size = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _runs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of visible ASCII signs, encoded as one text: if it has as many runs as
        words, every word is one."""
        ids = np.array(self._encoded([" ".join(words)])[0], np.uint32)
        last = np.flatnonzero(self.last[ids])
        return (ids, np.diff(last, prepend=-1)) if len(last) == len(words) else self._single(words)

    def _marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words without marks, encoded as one text with a mark after each."""
        ids = np.array(self._encoded([f" {_MARK} ".join([*words, ""])])[0], np.uint32)
        mark = np.flatnonzero(self.mark[ids])
        return (np.delete(ids, mark), np.diff(mark, prepend=-1) - 1) if len(mark) == len(words) else self._single(words)

    def add(self, words: list[str]) -> None:
        """Encode words that are not known."""
        alone, runs, marked = [], [], []
        for w in words:
            if _MARK in w or "<|" in w:  # special pieces are found before any cut
                alone.append(w)
            else:
                (runs if w.isascii() and w.isprintable() and "'" not in w else marked).append(w)
        found = [encode(own[lo:lo + JOINED]) for own, encode in ((alone, self._single), (runs, self._runs), (marked, self._marked))
                 for lo in range(0, len(own), JOINED)]
        self.number.update(zip(chain(alone, runs, marked), range(len(self.number), len(self.number) + len(words))))
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])
        self.first = np.append(self.first, self.first[-1] + np.cumsum(np.concatenate([size for _, size in found])))


def _model(path: str) -> _Known:
    """Vocabulary and known words, once per Python worker."""
    if path not in _models:
        _models[path] = _Known(path)
    return _models[path]


def _ids(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of known words back to back, and per word of ``words`` where its own start and how many
    they are. This vocabulary drops white space and encodes runs of letters, digits and other
    signs each by itself, so words may be encoded one by one, or many as one text."""
    known, words = _model(path), words.to_numpy(zero_copy_only=False).tolist()
    if len(known.number) > _KNOWN_WORDS:
        known.clear()
    at = np.fromiter(map(known.number.get, words, repeat(-1)), np.int64, len(words))
    new = np.flatnonzero(at < 0)
    if len(new):
        more = [words[i] for i in new.tolist()]
        known.add(more)
        at[new] = [known.number[w] for w in more]
    return known.ids, known.first[at], known.first[at + 1] - known.first[at]


_PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, with_ids: bool = False, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces: row (a number of its own), doc_id, piece, start, length,
    ids_crc32, and with ``with_ids`` the ids. Null and empty texts have the closing id alone. A
    row's number tells its place in the files read; other columns are not read."""
    path = vocabulary or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offs = W.text_bytes(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, hi in W.chunks(offs):
                part = data[offs[lo]:offs[hi]]
                special = any(x in part.tobytes() for x in _SPECIAL)  # these are found before any cut
                codes, at, words = W.word_codes(part, offs[lo:hi + 1] - offs[lo], kinds=None if special else _KINDS_OF_BYTES)
                flat, first, many = _ids(path, words)
                size = many[codes]
                ends = np.cumsum(size)
                tokens = flat[np.repeat(first[codes] - ends + size, size) + np.arange(int(size.sum()))]
                bound = np.append(0, ends)[at]
                out = []
                for i in range(hi - lo):
                    own = np.append(tokens[bound[i]:bound[i + 1]], np.uint32(END)).astype("<u4")
                    for k, start in enumerate(range(0, len(own), capacity)):
                        ids = own[start:start + capacity]
                        out.append((row, doc_ids[lo + i], k, start, len(ids), crc32(ids.tobytes()), ids))
                        row += 1
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = [c.split()[0] for c in _PIECES.split(", ")]
                cols = [pa.array(c, k) for c, k in zip(columns, kinds)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, columns[-1])]).astype(np.int32), pa.array(np.concatenate(columns[-1]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *(["ids"] if with_ids else [])])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES + (", ids array<int>" if with_ids else ""))


# -- one region's bins -----------------------------------------------------------------------
def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: by volume, and by pieces too long to share a bin (for each
    k, those above ``capacity - k`` stay alone, and what lies above half leaves room only for
    pieces of k or more)."""
    count = np.bincount(lengths, minlength=capacity + 1)[:capacity + 1]
    volume = np.append(0, np.cumsum(count * np.arange(capacity + 1)))  # below each length
    number = np.append(0, np.cumsum(count))
    half, best = capacity // 2, -(-int(volume[-1]) // capacity)
    for k in np.flatnonzero(count[:half + 1]).tolist():
        alone = number[-1] - number[capacity - k + 1]
        large = number[capacity - k + 1] - number[half + 1]
        room = large * capacity - (volume[capacity - k + 1] - volume[half + 1])
        rest = volume[half + 1] - volume[k]
        best = max(best, int(alone + large + max(0, -(-int(rest - room) // capacity))))
    return best


def best_fit(items: list[int], lengths: list[int], bins: Bins, capacity: int = CAPACITY) -> Bins:
    """``bins`` with ``items`` put, in their order, each into the fullest bin that has room, else
    into a new one. Bins are looked up by free places, the set of these being one integer."""
    free: dict[int, list[int]] = {}
    mask = 0
    for b, own in enumerate(bins):
        room = capacity - sum([lengths[i] for i in own])
        free.setdefault(room, []).append(b)
        mask |= 1 << room
    for i in items:
        size = lengths[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        free.setdefault(room - size, []).append(b)
        mask |= 1 << (room - size)
    return bins


def fitness(bins: Bins, lengths: list[int]) -> tuple[int, int]:
    """Fewer bins are better, then unequal ones: full bins, and others with room."""
    return -len(bins), sum(sum([lengths[i] for i in own]) ** 2 for own in bins)


def crossover(one: Bins, other: Bins, lengths: list[int], rng: random.Random, capacity: int = CAPACITY) -> Bins:
    """Well-filled whole bins of ``other`` injected into ``one``; pieces that lose their bin by
    that are best-fitted, longest first (pieces are numbered by falling length)."""
    filled = sorted(other, key=lambda own: -sum([lengths[i] for i in own]))
    top = filled[:max(1, len(filled) // 2)]
    injected = rng.sample(top, max(1, len(top) // 2))
    taken = {i for own in injected for i in own}
    kept, displaced = [list(own) for own in injected], []
    for own in one:
        if taken.isdisjoint(own):
            kept.append(list(own))
        else:
            displaced += [i for i in own if i not in taken]
    return best_fit(sorted(displaced), lengths, kept, capacity)


def mutated(bins: Bins, lengths: list[int], rng: random.Random, capacity: int = CAPACITY) -> Bins:
    """The emptiest bins and a few others dissolved, their pieces best-fitted again, mostly longest
    first."""
    order = sorted(range(len(bins)), key=lambda b: sum([lengths[i] for i in bins[b]]))
    few = max(1, len(bins) // 50)
    out = set(order[:few]) | set(rng.sample(order, min(len(order), 2 * few)))
    items = sorted(i for b in out for i in bins[b])
    for _ in range(len(items) // 10):
        a = rng.randrange(len(items))
        b = min(len(items) - 1, a + rng.randrange(8))
        items[a], items[b] = items[b], items[a]
    return best_fit(items, lengths, [list(own) for b, own in enumerate(bins) if b not in out], capacity)


def seeded(lengths: list[int], rng: random.Random, size: int = POPULATION, capacity: int = CAPACITY) -> list[Bins]:
    """A first population: best-fit of nearly falling orders."""
    out = []
    for k in range(size):
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * (1 + 0.1 * k * rng.random()))
        out.append(best_fit(order, lengths, [], capacity))
    return out


def evolved(population: list[Bins], lengths: list[int], bound: int, rng: random.Random, generations: int = GENERATIONS,
            capacity: int = CAPACITY) -> list[Bins]:
    """The population, best first, after some generations or once it has as few bins as possible."""
    size = len(population)
    ranked = sorted(population, key=lambda p: fitness(p, lengths), reverse=True)
    for _ in range(generations):
        if len(ranked[0]) <= bound:
            break
        children = []
        for _ in range(size):
            one, other = (min(rng.sample(range(len(ranked)), min(2, len(ranked)))) for _ in range(2))
            child = crossover(ranked[one], ranked[other], lengths, rng, capacity)
            children.append(mutated(child, lengths, rng, capacity) if rng.random() < 0.5 else child)
        ranked = sorted([*ranked, *children], key=lambda p: fitness(p, lengths), reverse=True)
        distinct = {fitness(p, lengths): p for p in reversed(ranked)}
        ranked = sorted(distinct.values(), key=lambda p: fitness(p, lengths), reverse=True)[:size]
    return ranked


# -- regions and islands ---------------------------------------------------------------------
def _bin_of(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for b, own in enumerate(bins):
        for i in own:
            out[i] = b
    return out


def _bins(bin_of: list[int]) -> Bins:
    out: Bins = [[] for _ in range(max(bin_of, default=-1) + 1)]
    for i, b in enumerate(bin_of):
        out[b].append(i)
    return out


_FIRST = "region long, lengths array<int>, bound int, bins int, best array<int>"
_STATE = "region long, island int, lengths array<int>, bound int, bins int, score long, population array<array<int>>"
_KINDS = {"region": pa.int64(), "island": pa.int32(), "lengths": pa.list_(pa.int32()), "bound": pa.int32(), "bins": pa.int32(), "score": pa.int64(),
          "best": pa.list_(pa.int32()), "population": pa.list_(pa.list_(pa.int32()))}


def _mapped(df: DataFrame, schema: str, row) -> DataFrame:
    """``df`` with ``row`` applied to each row, in short slices."""
    own = pa.schema([(c.split()[0], _KINDS[c.split()[0]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                yield pa.RecordBatch.from_pylist([row(r) for r in batch.slice(lo, 16).to_pylist()], own)

    return df.mapInArrow(run, schema)


def _first(capacity: int):
    def row(r: dict) -> dict:
        bins = best_fit(list(range(len(r["lengths"]))), r["lengths"], [], capacity)
        return r | {"bound": lower_bound(np.array(r["lengths"]), capacity), "bins": len(bins), "best": _bin_of(bins, len(r["lengths"]))}
    return row


def _epoch(k: int, generations: int, capacity: int):
    def row(r: dict) -> dict:
        lengths = r["lengths"]
        rng = random.Random(f"{r['region']}/{r['island']}/{k}")
        population = [_bins(p) for p in r["population"]] if r["population"] else seeded(lengths, rng, capacity=capacity)
        ranked = evolved(population, lengths, r["bound"], rng, generations, capacity)
        bins, score = fitness(ranked[0], lengths)
        return {c: r[c] for c in ("region", "island", "lengths", "bound")} | {
            "bins": -bins, "score": score, "population": [_bin_of(p, len(lengths)) for p in ranked]}
    return row


def solve(regions: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """region, best (the bin of every piece) for ``regions`` (region, lengths in falling order)."""
    first = staged(_mapped(regions.select("region", "lengths"), _FIRST, _first(capacity)), "first-fit")
    done = first.where("bins <= bound").select("region", "best")
    hard = first.where("bins > bound")
    if not hard.isEmpty():
        none = F.lit(None).cast("array<array<int>>")
        state = hard.select("region", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", "bound", "bins",
                            F.lit(0).cast("long").alias("score"), none.alias("population")).repartition("region", "island")
        found = []
        ring = Window.partitionBy("region").orderBy("island")
        whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        for k in range(epochs):
            state = staged(_mapped(state, _STATE, _epoch(k, generations, capacity)), "epoch")
            least = state.withColumn("least", F.min("bins").over(whole))
            over = F.col("least") <= F.col("bound") if k < epochs - 1 else F.lit(True)
            found.append(least.where(over))
            if k < epochs - 1:
                guest = F.coalesce(F.lag(F.col("population")[0]).over(ring), F.last(F.col("population")[0]).over(whole))
                state = least.where(~over).withColumn("population", F.concat(F.array(guest), "population")).drop("least").repartition("region", "island")
        best = found[0]
        for more in found[1:]:
            best = best.unionByName(more)
        best = best.groupBy("region").agg(F.min_by(F.col("population")[0], F.struct("bins", -F.col("score"), "island")).alias("best"))
        done = done.unionByName(best)
    return staged(done, "solved")


def pack(rows: DataFrame, capacity: int = CAPACITY, region: int = REGION, islands: int = ISLANDS, epochs: int = EPOCHS,
         generations: int = GENERATIONS) -> DataFrame:
    """row, sequence_id, offset for ``rows`` (row, length), ``row`` being unique: as few sequences
    as the algorithm finds, each with the pieces from offset 0 on without gaps."""
    rows = rows.select("row", F.col("length").cast("int").alias("length"))
    # sequences are numbered by piece or by region and bin, with the level in the last three bits
    out = rows.where(F.col("length") >= capacity).select("row", (F.col("row") * 8).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, before, level = staged(rows.where(F.col("length") < capacity), "open"), None, 0
    while True:
        n = left.count()
        parts = 1 + n // region
        dealt = left.groupBy(F.pmod(F.xxhash64("row", F.lit(level)), F.lit(parts)).alias("region")).agg(
            F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("l"), "row"))).alias("own"))
        dealt = staged(dealt.select("region", F.transform("own", lambda x: -x["l"]).alias("lengths"), F.transform("own", lambda x: x["row"]).alias("rows")), "regions")
        solved = dealt.join(solve(dealt, capacity, islands, epochs, generations), "region")
        each = solved.select("region", F.explode(F.arrays_zip("rows", "lengths", "best")).alias("x")).select("region", F.col("x.rows").alias("row"), F.col("x.lengths").alias("length"), F.col("x.best").alias("bin"))
        one = Window.partitionBy("region", "bin")
        placed = each.withColumn("fill", F.sum("length").over(one)).withColumn(
            "offset", F.sum("length").over(one.orderBy(F.col("length").desc(), "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
        placed = staged(placed.select("row", "length", ((F.col("region") * 2 * region + F.col("bin")) * 8 + level + 1).alias("sequence_id"), "offset", "fill"), "placed")
        bins = placed.where("offset = 0").count()
        if before is not None and bins >= before[1]:
            out = out.unionByName(before[0])
            break
        loose = placed.where(F.col("fill") < capacity - LOOSE)
        row = placed.select("row", "sequence_id", "offset")
        if parts == 1 or level == LEVELS - 1 or (released := loose.count()) > SHRINK * n or released == 0:
            out = out.unionByName(row)
            break
        out = out.unionByName(placed.where(F.col("fill") >= capacity - LOOSE).select("row", "sequence_id", "offset"))
        before = loose.select("row", "sequence_id", "offset"), loose.where("offset = 0").count()
        left, level = staged(loose.select("row", "length"), "open"), level + 1
    return out


def packed(docs: DataFrame, with_ids: bool = False, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of ``docs`` with its sequence_id and offset.

    Only documents above ``capacity`` are cut. Null texts count as empty, repeated rows and null
    ids are packed like others, other columns are not read; an empty table gives no rows. The
    same files, read in the same parts, are packed in the same way again.
    """
    found = staged(pieces(docs, with_ids, vocabulary, capacity), "pieces")
    return found.join(pack(found, capacity), "row").drop("row")


def sequences(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids (at most ``capacity``) and doc_ids of every sequence, in offset order."""
    own = packed(docs, True, vocabulary, capacity).groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("own"))
    return own.select("sequence_id", F.flatten(F.transform("own", lambda x: x["ids"])).alias("ids"), F.transform("own", lambda x: x["doc_id"]).alias("doc_ids"))
