"""Grouped prefix join: documents linked by the Jaccard similarity of their word shingles.

1. *Order.* Shingles are ordered by document frequency, rare ones first (``frequency``), ties
   by hash. Two sets of similarity ``t`` or more share at least ``l`` shingles among the first
   ``n - ceil(t n) + l`` of each: the prefix. ``l`` is ``EXTRA`` percent of the size.
2. *Group.* Documents of equal sets are one class; classes of equal size and equal prefix are
   one group. The index holds groups.
3. *Filter.* Shingles in the prefix of one group alone are dropped in one sorted pass, then
   groups left with fewer than ``l``. Where a shingle is in at most ``FEW`` groups, their pairs
   of fitting size are counted, and a pair with too few common shingles for the places where
   the two prefixes end is dropped. A shingle of more groups ties each of them to the least
   one, so m groups make m - 1 rows, never m squared. The connected components of both are the
   candidate sets: no link crosses them.
4. *Expand and verify.* The classes of a candidate set are dealt by hash into blocks of bounded
   size, and every pair of blocks is one task that counts the common shingles of all its pairs
   of classes exactly (a product of 0/1 matrices). It returns a row per class: its number of
   links and one tie to the least class it reaches, not the pairs.
5. The ties' components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frequency
from . import words as W
from .components import connected_components
from .staging import short_batches, staged, unused

#: Groups of one shingle up to which their pairs are counted one by one.
FEW = 32
#: Common prefix shingles asked of a pair, in percent of the size; prefixes get longer by it.
EXTRA = 6
#: Bounds of a block: classes, and shingles of all its classes together.
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 1 << 17
_RUNTIME_FILTER = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"


def _set_key(found: np.ndarray) -> bytes:
    return blake2b(found.tobytes(), digest_size=16).digest()


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _prefixes(table, percent: int, k: int):
    """Per document: size and key of its set, its group, and the prefix in order: first the
    shingles of frequency class 0 (``rare``), then the others (``common``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = frequency.unpack(table.value)
        for batch in batches:
            n, keys, groups, rare, common = [], [], [], [], []
            for found in W.shingle_sets(batch.column("text"), k):
                size = len(found)
                p = size - (percent * size + 99) // 100 + max(1, EXTRA * size // 100) if size else 0
                rank = order[frequency.cells(found)]
                at = np.argsort(rank, kind="stable")[:p]
                prefix, c = found[at], int((rank[at] == 0).sum())
                n.append(size)
                keys.append(_set_key(found))
                groups.append(int.from_bytes(blake2b(prefix.tobytes() + size.to_bytes(8, "big"), digest_size=8).digest(), "big", signed=True))
                rare.append(prefix[:c])
                common.append(prefix[c:])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(groups, pa.int64()), _lists(rare), _lists(common)],
                names=["doc_id", "row_id", "text_hash", "n", "set_key", "grp", "rare", "common"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and group, without repeats: those whose token has two groups or
    more. One row is held from batch to batch."""
    token, group = np.zeros(0, np.int64), np.zeros(0, np.int64)
    shared = np.zeros(0, bool)  # whether the held row's token has another group before it
    for batch in chain(batches, [None]):
        if batch is not None:
            token = np.concatenate([token, batch.column("token").to_numpy()])
            group = np.concatenate([group, batch.column("grp").to_numpy()])
        if not len(token):
            continue
        new = np.append(True, (token[1:] != token[:-1]) | (group[1:] != group[:-1]))
        token, group = token[new], group[new]
        same = np.append(False, token[1:] == token[:-1])
        same[0] = bool(len(shared) and shared[0])
        keep = same | np.append(same[1:], False)
        end = len(token) if batch is None else len(token) - 1
        yield pa.RecordBatch.from_arrays([pa.array(token[:end][keep[:end]]), pa.array(group[:end][keep[:end]])], names=["token", "grp"])
        token, group, shared = token[end:], group[end:], same[end:]


def _tiles(k: int):
    """Documents of candidate classes: their sets, once for every pair of blocks they are in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("set_key", "copies", "part", "blocks", "tile")}
            for i, found in enumerate(W.shingle_sets(batch.column("text"), k)):
                key, blocks = cols["set_key"][i], cols["blocks"][i]
                if _set_key(found) != key:
                    continue
                own = int.from_bytes(key[:8], "big") % blocks
                pairs = [(min(own, j), max(own, j)) for j in range(blocks)]
                yield pa.RecordBatch.from_pydict({
                    "tile": pa.array([(cols["tile"][i] if blocks == 1 else hash((cols["part"][i], a, b))) for a, b in pairs], pa.int64()),
                    "part": pa.array([cols["part"][i]] * blocks, pa.int64()),
                    "a": pa.array([a for a, _ in pairs], pa.int32()), "b": pa.array([b for _, b in pairs], pa.int32()),
                    "own": pa.array([own] * blocks, pa.int32()), "set_key": pa.array([key] * blocks, pa.binary()),
                    "copies": pa.array([cols["copies"][i]] * blocks, pa.int64()),
                    "found": pa.array([found.tobytes()] * blocks, pa.binary())})
    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of sets shares."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out, width = np.zeros((m, m)), 4096
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (lo, lo + width))
        x = np.zeros((m, width), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _verify(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, a, b), part in pdf.groupby(["part", "a", "b"], sort=False):
            part = part.drop_duplicates("set_key")
            if len(part) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in part["found"]]
            common, size = _common(sets), np.array([len(s) for s in sets])
            own = part["own"].to_numpy()
            link = (100 + percent) * common >= percent * (size[:, None] + size[None, :])
            np.fill_diagonal(link, False)
            if a != b:  # pairs within a block have their own task
                link &= own[:, None] != own[None, :]
            copies = link @ part["copies"].to_numpy()
            label = np.arange(len(sets))
            while True:
                least = np.minimum(label, np.where(link, label[None, :], len(sets)).min(axis=1))
                least = least[least]
                if (least == label).all():
                    break
                label = least
            keys = part["set_key"].to_numpy()
            linked = np.flatnonzero(copies)
            out.append(pd.DataFrame({"u": keys[linked], "v": keys[label[linked]], "links": copies[linked]}))
        return pd.concat(out) if out else pd.DataFrame({"u": [], "v": [], "links": []})
    return run


def _ids(docs: DataFrame) -> DataFrame:
    """``row_id`` names a row: its doc_id, or where that is null, a hash of its text."""
    return docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text")).withColumn(
        "row_id", F.coalesce(F.col("doc_id").cast("long"), "text_hash"))


def classes(docs: DataFrame, percent: int = 80, k: int = 5, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """``(rows, linked)``: a row per document with its set, and the sets that have links.

    ``rows``: doc_id, row_id, text_hash, n (distinct shingles), set_key, grp. ``linked``:
    set_key, component (the key of one set of its component), links (documents of other sets
    linked to it). ``docs`` needs doc_id and text; other columns are not read.
    """
    spark = docs.sparkSession
    spark.conf.set(_RUNTIME_FILTER, "1MB")
    short_batches(spark)
    ids = _ids(docs)
    table = spark.sparkContext.broadcast(frequency.classes(docs, "text", k))
    rows = staged(ids.mapInArrow(_prefixes(table, percent, k), "doc_id long, row_id long, text_hash long, n long, set_key binary, "
                                 "grp long, rare array<long>, common array<long>"), "prefixes")
    rare = (rows.select("grp", F.explode("rare").alias("token")).repartition("token").sortWithinPartitions("token", "grp")
            .mapInArrow(_shared, "token long, grp long"))
    common = rows.select("grp", F.explode("common").alias("token")).distinct()
    live = staged(rare.union(common.select("token", "grp")), "live")
    sizes = rows.where("n > 0").groupBy("grp").agg(F.first("n").alias("n"))
    least = F.expr(f"greatest(1, n * {EXTRA} div 100)")
    whole = live.groupBy("grp").agg(F.count("*").alias("c")).join(sizes, "grp").where(F.col("c") >= least).select("grp", "n", least.alias("l"))
    live = staged(live.join(whole, "grp"), "live")
    counted = live.groupBy("token").agg(F.count("*").alias("m"), F.min("grp").alias("first")).where("m > 1")
    live = live.join(counted, "token")
    many = live.where((F.col("m") > few) & (F.col("grp") != F.col("first"))).select(F.col("first").alias("u"), F.col("grp").alias("v"))
    short = live.where(F.col("m") <= few)
    a = short.select("token", *(F.col(c).alias(f"{c}_a") for c in ("grp", "n", "l")))
    b = short.select("token", *(F.col(c).alias(f"{c}_b") for c in ("grp", "n", "l")))
    rest = [F.ceil(percent * F.col(f"n_{x}") / 100) - F.col(f"l_{x}") for x in "ab"]
    pairs = (a.join(b, "token").where(f"grp_a < grp_b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
             .groupBy("grp_a", "grp_b", "n_a", "n_b", "l_a", "l_b").agg(F.count("*").alias("c"))
             .where(F.col("c") >= F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent)) - F.greatest(*rest)))
    ties = staged(pairs.select(F.col("grp_a").alias("u"), F.col("grp_b").alias("v")).union(many).distinct(), "ties")
    parts = connected_components(ties).select(F.col("node").alias("grp"), F.col("component").alias("part"))

    sets = rows.where("n > 0").groupBy("set_key").agg(F.min("row_id").alias("row_id"), F.count("*").alias("copies"),
                                                      F.first("n").alias("n"), F.first("grp").alias("grp"))
    sets = staged(sets.join(parts, "grp", "left").withColumn("part", F.coalesce("part", "grp")).drop("grp"), "sets")
    large = sets.groupBy("part").agg(F.count("*").alias("m"), F.sum("n").alias("weight")).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    large = staged(large.select("part", blocks.alias("blocks"), "weight"), "parts")
    total = large.where("blocks = 1").agg(F.sum("weight")).first()[0] or 0
    bins = int(total // BLOCK_SHINGLES) + 1  # small candidate sets share tasks
    wanted = staged(sets.join(large, "part").select(F.col("row_id").alias("wanted_id"), "set_key", "copies", "part", "blocks",
                                                    F.expr(f"pmod(xxhash64(part), {bins})").alias("tile")), "wanted")
    found = (ids.select("row_id", "text").join(wanted.where("blocks >= 1"), F.col("row_id") == F.col("wanted_id"))
             .select("text", "set_key", "copies", "part", "blocks", "tile")
             .mapInArrow(_tiles(k), "tile long, part long, a int, b int, own int, set_key binary, copies long, found binary"))
    links = staged(found.groupBy("tile").applyInPandas(_verify(percent), "u binary, v binary, links long"), "links")
    joined = connected_components(links).select(F.col("node").alias("set_key"), "component")
    linked = joined.join(links.groupBy(F.col("u").alias("set_key")).agg(F.sum("links").alias("links")), "set_key")
    return rows.drop("rare", "common"), staged(linked, "linked")


def join(docs: DataFrame, percent: int = 80, k: int = 5, few: int = FEW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_links.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text of 1 to ``k - 1`` words is
    one shingle; a null or empty text has no set, no link, and its own doc_id as component.
    Equal sets are linked, repeated rows too. ``component_id`` is the least doc_id (nulls aside)
    reachable by links; ``n_links`` counts the other rows linked to a row directly.
    """
    rows, linked = classes(docs, percent, k, few)
    sets = rows.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    top = (linked.join(sets, "set_key").groupBy("component").agg(F.min("first_id").alias("component_id")))
    named = linked.join(top, "component").select("set_key", "component_id", "links")
    sets = staged(sets.join(named, "set_key", "left").select(
        "set_key", F.when(F.col("links").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.where("n > 0").join(sets, "set_key").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").union(none)


def keep_one(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """``docs`` with one row of each component (least doc_id, then text hash), all columns kept.

    Rows without words have no component and stay, repeated ones too.
    """
    rows, linked = classes(docs, percent, k)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "row_id", "text_hash")).alias("one")
    first = rows.where("n > 0").groupBy("set_key").agg(one)
    first = first.join(linked.select("set_key", "component"), "set_key", "left").select(F.coalesce("component", "set_key").alias("c"), "one")
    row, text_hash, own_id, own_hash = unused(docs, "_row", "_hash", "_id", "_h")
    stay = staged(first.groupBy("c").agg(F.min("one").alias("one")).select(F.col("one.row_id").alias(row), F.col("one.text_hash").alias(text_hash)), "stay")
    named = docs.withColumn(own_hash, F.xxhash64("text"))
    named = named.withColumn(own_id, F.coalesce(F.col("doc_id").cast("long"), own_hash))
    kept = named.join(stay, (F.col(own_id) == F.col(row)) & (F.col(own_hash) == F.col(text_hash))).dropDuplicates([own_id, own_hash])
    wordless = named.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(docs.columns).union(wordless.select(docs.columns))


def links_of(texts: list[str | None], percent: int = 80, k: int = 5) -> list[set[int]]:
    """The links of every text by comparing all pairs of shingle sets, as a check for tests."""
    import re

    sets = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    out: list[set[int]] = [set() for _ in sets]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                out[i].add(j)
                out[j].add(i)
    return out
