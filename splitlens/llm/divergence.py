"""Source divergence audit: how far the sources of a language lie apart in their words.

1. *Kept terms.* Document frequencies are counted per language; tasks count their own texts
   first. Terms in at least ``min_docs`` documents are kept.
2. *Vocabulary.* The kept terms, sorted, are cut into ranges of at most ``SHARD_TERMS`` terms;
   each range becomes a minimal acyclic transducer (``transducer``). A range's first ordinal is
   the number of terms before it, so ordinals are the terms' places in the sorted vocabulary.
3. *Recounting.* Texts stream through the transducers, which give ordinals to the kept terms and
   nothing to others. The transducers go to all executors if they are measured to be below
   ``broadcast_bytes``; else the tasks' term counts are dealt to the ranges instead.
4. *Divergence.* Smoothed shares are whole numbers, computed exactly. Pairs of sources are
   summed in blocks of ``BLOCK`` ordinals by tiles of ``TILE`` sources, dense within a block, so
   no task holds more than that; ties between terms are broken by ordinal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .staging import staged
from .transducer import Transducer, build, joined

MIN_DOCS, TOP = 30, 50
SCALE, ADD = 1_000_000_000, 5
SHARD_TERMS = 1 << 16
BROADCAST_BYTES = 64 << 20
BLOCK, TILE = 1024, 128
#: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``: letters and all non-ASCII
OTHER = np.zeros(256, bool)
OTHER[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_ARRAYS = {"keys": np.int64, "target": np.int64, "skip": np.int64, "final": bool}


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Codes of a short text column, null as '', and the values that they name."""
    own = column.fill_null("").dictionary_encode()
    return own.indices.to_numpy().astype(np.int64), own.dictionary.to_pylist()


def _counted(batch: pa.RecordBatch, by: list[str], once: bool) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Per part of a batch: the groups by the columns ``by``, then group, term code and count of
    every pair that occurs, and the terms. With ``once`` a document counts once for a term."""
    data, offs = W.text_bytes(batch.column("text"))
    columns = [_codes(batch.column(c)) for c in by]
    width = [max(1, len(names)) for _, names in columns]
    group = np.zeros(batch.num_rows, np.int64)
    for (codes, _), w in zip(columns, width):
        group = group * w + codes
    for lo, hi in W.chunks(offs):
        codes, at, terms = W.word_codes(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], OTHER, lower=True)
        if not len(codes):
            continue
        row = np.repeat(np.arange(lo, hi), np.diff(at))
        if once:
            pairs = np.unique(row * len(terms) + codes)
            row, codes = pairs // len(terms), pairs % len(terms)
        pairs, n = np.unique(group[row] * len(terms) + codes, return_counts=True)
        seen, codes = pairs // len(terms), pairs % len(terms)
        which, place = np.unique(seen, return_inverse=True)
        names = []
        for g in which.tolist():
            name = []
            for (_, values), w in zip(columns[::-1], width[::-1]):
                name.append(values[g % w])
                g //= w
            names.append(tuple(name[::-1]))
        yield names, place, codes, n, terms


def _out(names: list, place: np.ndarray, by: list[str], more: dict) -> pa.RecordBatch:
    cols = [pa.array([x[i] for x in names], pa.string()).take(pa.array(place)) for i in range(len(by))]
    return pa.RecordBatch.from_arrays([*cols, *more.values()], names=[*by, *more])


def _terms_of(docs: DataFrame, by: list[str], once: bool) -> DataFrame:
    """``by``, term, n: counts of terms within tasks, added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, place, codes, n, terms in _counted(batch, by, once):
                yield _out(names, place, by, {"term": terms.take(pa.array(codes)).cast(pa.string()), "n": pa.array(n)})

    fields = ", ".join(f"{c} string" for c in by)
    found = docs.select("text", *by).mapInArrow(run, f"{fields}, term string, n long")
    return found.groupBy(*by, "term").agg(F.sum("n").alias("n"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, n (its documents) of the terms in at least ``min_docs`` documents of a language."""
    return _terms_of(docs, ["lang"], True).where(F.col("n") >= min_docs)


def vocabulary(kept: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The transducers of ``kept`` (lang, term): lang, shard, first (its first term), base (its
    first ordinal), size, start and the arrays as bytes; staged."""
    kept = staged(kept.select("lang", "term"), "kept")
    parts = 1 + kept.count() // shard_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, held = None, []

        def made() -> pa.RecordBatch:
            t = build(held)
            row = {"lang": lang, "first": held[0].decode(), "size": t.size, "start": t.start}
            return pa.RecordBatch.from_pylist([row | {c: getattr(t, c).tobytes() for c in _ARRAYS}])

        for batch in batches:
            for its, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist()):
                if held and (its != lang or len(held) >= shard_terms):
                    yield made()
                    held = []
                lang = its
                held.append(term.encode())
        if held:
            yield made()

    arrays = ", ".join(f"{c} binary" for c in _ARRAYS)
    shards = kept.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(
        run, f"lang string, first string, size long, start long, {arrays}")
    shards = staged(shards, "transducers")
    small = shards.select("lang", "first", "size")  # a row for thousands of terms
    order = Window.partitionBy("lang").orderBy("first")
    base = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = small.select("lang", "first", (F.row_number().over(order) - 1).alias("shard"), base.alias("base"))
    return staged(shards.join(placed, ["lang", "first"]), "vocabulary")


def _loaded(row: dict) -> Transducer:
    arrays = {c: np.frombuffer(row[c], kind) for c, kind in _ARRAYS.items()}
    return Transducer(**arrays, start=row["start"], size=row["size"])


def _fixed(data: np.ndarray, offs: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` bytes of each string as a fixed-width array, which orders by bytes."""
    size = np.minimum(np.diff(offs), width)
    out = np.zeros((len(size), width), np.uint8)
    at = np.repeat(np.arange(len(size)), size)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[at, within] = data[offs[:-1][at] + within]
    return out.reshape(-1).view(f"S{width}")


class Vocabulary:
    """All transducers side by side, and per language the bounds of its shards."""

    def __init__(self, rows: list[dict]):
        rows = sorted(rows, key=lambda r: (r["lang"], r["shard"]))
        self.all, starts = joined([_loaded(r) for r in rows])
        firsts = [r["first"].encode() for r in rows]
        self.width = 1 + max(map(len, firsts), default=0)  # terms cut here still order against the bounds
        self.langs: dict[str, tuple] = {}
        for lang in {r["lang"] for r in rows}:
            own = [i for i, r in enumerate(rows) if r["lang"] == lang]
            self.langs[lang] = (np.array([firsts[i] for i in own], f"S{self.width}"), starts[own], np.array([rows[i]["base"] for i in own], np.int64))

    def ordinals(self, lang: str, terms: pa.Array) -> np.ndarray:
        """The terms' places among the language's kept terms, -1 for others."""
        if lang not in self.langs or not len(terms):
            return np.full(len(terms), -1, np.int64)
        first, start, base = self.langs[lang]
        data, offs = W.text_bytes(terms)
        shard = np.searchsorted(first, _fixed(data, offs, self.width), side="right") - 1
        found = self.all.ordinals(data, offs, start[np.maximum(shard, 0)])
        return np.where((shard < 0) | (found < 0), -1, found + base[np.maximum(shard, 0)])


def _streamed(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """Recount with all transducers on every executor."""
    spark = docs.sparkSession
    rows = spark.sparkContext.broadcast([r.asDict() for r in shards.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(rows.value)
        for batch in batches:
            for names, place, codes, n, terms in _counted(batch, ["lang", "source"], False):
                ordinal = np.full(len(codes), -1, np.int64)
                for lang in {x[0] for x in names}:
                    its = np.array([x[0] == lang for x in names])[place]
                    distinct, back = np.unique(codes[its], return_inverse=True)
                    ordinal[its] = known.ordinals(lang, terms.take(pa.array(distinct)))[back]
                on = ordinal >= 0
                yield _out(names, place[on], ["lang", "source"], {"ordinal": pa.array(ordinal[on]), "n": pa.array(n[on])})

    return docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, ordinal long, n long")


def _dealt(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """Recount with the tasks' term counts sent to the ranges: each partition reads a range's
    transducer and then its terms, in batches. Only the ranges' first terms, one for thousands
    of terms, are joined to the counts."""
    counts = _terms_of(docs, ["lang", "source"], False)
    firsts = shards.groupBy("lang").agg(F.array_sort(F.collect_list("first")).alias("firsts"))
    counts = counts.join(firsts, "lang").withColumn("shard", F.expr("size(filter(firsts, f -> f <= term)) - 1")).where("shard >= 0")
    arrays = list(_ARRAYS)
    none = [F.lit(None).cast("binary").alias(c) for c in arrays]
    both = shards.select("lang", "shard", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"),
                         "first", "base", "size", "start", *arrays)
    both = both.unionByName(counts.select("lang", "shard", "source", "term", "n", F.lit(None).cast("string").alias("first"),
                                          *[F.lit(None).cast("long").alias(c) for c in ("base", "size", "start")], *none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, which = None, None
        for batch in batches:
            heads = np.flatnonzero(batch.column("first").is_valid().to_numpy(zero_copy_only=False)).tolist()
            for lo, hi in zip([0, *heads], [*heads, batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if lo in heads and part.num_rows:
                    row = part.slice(0, 1).to_pylist()[0]
                    known, which, part = Vocabulary([row]), row["lang"], part.slice(1)
                if part.num_rows:
                    ordinal = known.ordinals(which, part.column("term"))
                    on = pa.array(ordinal >= 0)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).filter(on) for c in ("lang", "source")), pa.array(ordinal).filter(on), part.column("n").filter(on)],
                                                     names=["lang", "source", "ordinal", "n"])

    spread = both.repartition("lang", "shard").sortWithinPartitions("lang", "shard", F.col("first").isNull())
    return spread.mapInArrow(run, "lang string, source string, ordinal long, n long")


def recount(docs: DataFrame, shards: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """lang, source, ordinal, n: occurrences of the kept terms; staged."""
    size = shards.agg(F.sum(sum(F.length(c) for c in _ARRAYS))).first()[0] or 0
    found = (_streamed if size <= broadcast_bytes else _dealt)(docs, shards)
    return staged(found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "recount")


def share(n: Column, total: Column, size: Column) -> Column:
    """``1 + floor(SCALE * (n + ADD) / (total + ADD * size))`` in whole numbers of 38 digits."""
    wide = [x.cast("decimal(20,0)") for x in (n + ADD, total + ADD * size)]
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide[0], wide[1])


def _cells(column: pa.Array, i: int) -> list[np.ndarray]:
    """The entries of row ``i`` of an array of structs, field by field."""
    own = column[i].values
    return [own.field(k).to_numpy() for k in range(own.type.num_fields)] if own is not None and len(own) else []


def _matrix(shares: np.ndarray, cells: list[np.ndarray], width: int) -> np.ndarray:
    """Shares of a tile's sources in a block: those without occurrences are all alike."""
    out = np.repeat(shares[:, None], width, axis=1)
    if cells:
        out[cells[0], cells[1]] = cells[2]
    return out


def _block_sums(tile: int):
    """From a block's shares of two tiles of sources: the sum of differences of each pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                width, tile_a, tile_b = (at[c][i].as_py() for c in ("width", "tile_a", "tile_b"))
                a, b = (_matrix(_cells(at[f"zero_{x}"], i)[1], _cells(at[f"cells_{x}"], i), width) for x in "ab")
                first, second, total = [], [], []
                for k in range(len(a)):
                    own = np.abs(b[k + 1:] - a[k]).sum(axis=1) if tile_a == tile_b else np.abs(b - a[k]).sum(axis=1)
                    total.append(own)
                    first.append(np.full(len(own), tile_a * tile + k))
                    second.append(tile_b * tile + np.arange(len(b) - len(own), len(b)))
                yield pa.RecordBatch.from_arrays([pa.array([at["lang"][i].as_py()] * sum(map(len, total)), pa.string()),
                                                  *(pa.array(np.concatenate(x).astype(np.int64)) for x in (first, second, total))], names=["lang", "a", "b", "part"])
    return run


def pair_sums(groups: DataFrame, cells: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, a, b, value for a < b: distances of two sources of a language, by their numbers."""
    of_lang = groups.groupBy("lang").agg(F.first("size").alias("size"), F.count("*").alias("sources"))
    none = of_lang.where("size = 0").select("lang", "sources", F.explode(F.expr("sequence(0L, sources - 1)")).alias("a"))
    none = none.where("a < sources - 1").select("lang", "a", F.explode(F.expr("sequence(a + 1, sources - 1)")).alias("b"), F.lit(0).cast("long").alias("value"))
    grid = of_lang.where("size > 0 and sources > 1").select("lang", "size", F.expr(f"(sources - 1) div {tile}").alias("last"), F.explode(F.expr(f"sequence(0L, (size - 1) div {block})")).alias("block"))
    grid = grid.select("*", F.explode(F.expr("sequence(0L, last)")).alias("tile_a"))
    grid = grid.select("lang", "block", "tile_a", F.explode(F.expr("sequence(tile_a, last)")).alias("tile_b"), F.least(F.lit(block), F.col("size") - block * F.col("block")).alias("width"))
    zero = groups.where("size > 0").groupBy("lang", "tile").agg(F.array_sort(F.collect_list(F.struct("slot", "p0"))).alias("zero"))
    filled = staged(cells.groupBy("lang", "block", "tile").agg(F.collect_list(F.struct("slot", "place", "p")).alias("cells")), "cells")
    for side in "ab":
        grid = grid.join(zero.select("lang", F.col("tile").alias(f"tile_{side}"), F.col("zero").alias(f"zero_{side}")), ["lang", f"tile_{side}"])
        grid = grid.join(filled.select("lang", "block", F.col("tile").alias(f"tile_{side}"), F.col("cells").alias(f"cells_{side}")), ["lang", "block", f"tile_{side}"], "left")
    sums = grid.mapInArrow(_block_sums(tile), "lang string, a long, b long, part long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("part").alias("value")).unionByName(none)


def terms_by_ordinal(wanted: DataFrame, shards: DataFrame) -> DataFrame:
    """lang, ordinal, item of the ordinals in ``wanted`` (lang, ordinal), read off the transducers."""
    small = shards.select("lang", "shard", "base", "size")
    inside = (F.col("ordinal") >= F.col("base")) & (F.col("ordinal") < F.col("base") + F.col("size"))
    asked = wanted.distinct().join(small, "lang").where(inside).groupBy("lang", "shard").agg(F.collect_list("ordinal").alias("ordinals"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _loaded(row)
                items = [own.string(i - row["base"]).decode() for i in row["ordinals"]]
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(items), pa.string()), pa.array(row["ordinals"], pa.int64()), pa.array(items, pa.string())],
                                                 names=["lang", "ordinal", "item"])

    return asked.join(shards, ["lang", "shard"]).mapInArrow(run, "lang string, ordinal long, item string")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, broadcast_bytes: int = BROADCAST_BYTES,
          shard_terms: int = SHARD_TERMS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language with the sum of the differences of the
    kept terms' shares, all ranks. Part ``term``: the kept terms whose share in the source is
    above that in the language, with the difference, to rank ``top``. Ranks go by falling value,
    ties by the item's UTF-8 bytes (for terms, their ordinals). Null text, lang and source count
    as ''; a source whose texts have no kept term takes part with the smoothing alone; in a
    language without kept terms all values are 0. Repeated rows count each; other columns are
    not read; an empty table gives no rows.
    """
    docs = docs.select("text", *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")))
    shards = vocabulary(kept_terms(docs, min_docs), shard_terms)
    counts = recount(docs, shards, broadcast_bytes)

    sizes = shards.groupBy("lang").agg(F.sum("size").alias("size"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "size"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row for each source
    groups = groups.withColumn("number", number.cast("long"))
    p0 = F.when(F.col("size") > 0, share(F.lit(0), F.col("total"), F.col("size")))
    groups = staged(groups.select("*", F.expr(f"number div {tile}").alias("tile"), (F.col("number") % tile).cast("int").alias("slot"), p0.alias("p0")), "groups")

    cells = counts.join(groups.select("lang", "source", "total", "size", "tile", "slot"), ["lang", "source"])
    cells = cells.withColumn("p", share(F.col("n"), F.col("total"), F.col("size")))
    blocks = cells.select("lang", F.expr(f"ordinal div {block}").alias("block"), "tile", "slot", (F.col("ordinal") % block).cast("int").alias("place"), "p")
    sums = pair_sums(groups, blocks, block, tile)
    names = groups.select("lang", "number", "source")
    sums = staged(sums, "pairs")
    sums = sums.union(sums.select("lang", "b", "a", "value"))
    pairs = (sums.join(names.withColumnRenamed("number", "a"), ["lang", "a"])
             .join(names.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"]))
    over = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(over).alias("rank"))

    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("size").alias("size"))
    q = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n")).join(of_lang, "lang")
    q = q.select("lang", "ordinal", share(F.col("n"), F.col("total"), F.col("size")).alias("q"))
    above = cells.select("lang", "source", "ordinal", "p").join(q, ["lang", "ordinal"]).where("p > q").withColumn("value", F.col("p") - F.col("q"))
    over = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal")
    above = staged(above.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= top), "above")
    terms = above.join(terms_by_ordinal(above.select("lang", "ordinal"), shards), ["lang", "ordinal"])
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
