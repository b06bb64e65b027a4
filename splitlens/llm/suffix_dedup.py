"""Suffix-array dedup: remove the bytes of ``MATCH``-byte strings that also start earlier.

A suffix array over all text would move every suffix through the network. Equal strings are
brought together by content instead, and only the stretches that may hold a partial repeat are
sorted:

1. Every string of ``MATCH`` bytes is named by its least hashed ``KMER``-byte substring, the
   leftmost of equals: its anchor. Consecutive strings of one anchor are a region. Equal
   strings have equal anchors, at equal places in them.
2. Regions shuffle by anchor. A region whose text came earlier is a repeat as a whole. Regions
   whose anchor has no other region have none. What is left, the first region of each text
   among several of one anchor, lies around the ends of repeated passages.
3. These go to shards by anchor, of bounded size. Each shard's suffix array is made by induced
   sorting, and permuted common prefixes give the classes of equal strings; all but the first
   of a class are repeats. An anchor of more than ``HOT`` different regions (a passage in very
   many documents) is salted over several shards, and the first string of each class in each
   of them goes through a grouped minimum over all.
4. Each document's repeats are joined with its text and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .staging import short_batches, staged, unused
from .suffix_array import permuted_common_prefixes, suffix_array

MATCH, KMER = 100, 40
#: Bytes whose strings are hashed at once; about 100 bytes of working memory each.
STRIDE = 1 << 17
_PLACE = np.uint64((1 << 21) - 1)
HOT = 512
SHARD_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROLL = W.stream(256, 71)
_BLOOM = "spark.sql.optimizer.runtime.bloomFilter."


def _rolled(values: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of the ``length`` values from each position, by doubling."""
    out = np.zeros(len(values) - length + 1, np.uint64)
    h, size, step, factor, at = values, 1, _BASE, np.uint64(1), 0
    with np.errstate(over="ignore"):
        while length:
            if length & 1:
                out += h[at:at + len(out)] * factor
                at, factor = at + size, factor * step
            length >>= 1
            if length:
                h = h[:-size] + h[size:] * step
                step, size = step * step, 2 * size
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each position."""
    m, size, n = values, 1, len(values) - width + 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[width - size:width - size + n])


def regions(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Regions of the texts in ``data``: text, first string's place in it, number of strings,
    anchor, and a hash of the region's bytes and the anchor's place among them.

    Long input is cut into strides; a region cut there is just two regions.
    """
    found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2]
    for lo in range(0, len(data) - MATCH + 1, STRIDE):
        part = data[lo:lo + STRIDE + MATCH - 1]
        text = np.searchsorted(offs, np.arange(lo, lo + len(part)), side="right") - 1
        n = len(part) - MATCH + 1
        start = np.flatnonzero(text[:n] == text[MATCH - 1:])
        if not len(start):
            continue
        rolled = _ROLL[part]
        kmer = W.mix(_rolled(rolled, KMER))
        key = (kmer & ~_PLACE) | np.arange(len(kmer), dtype=np.uint64)
        anchor = (_least(key, MATCH - KMER + 1) & _PLACE).astype(np.int64)[start]
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))
        first, q = start[new], anchor[new]
        count = np.diff(np.append(np.flatnonzero(new), len(start)))
        whole = _rolled(rolled, MATCH)
        with np.errstate(over="ignore"):
            h = W.mix(whole[first] + W.mix(whole[first + count - 1] + W.mix(count.astype(np.uint64) + W.mix((q - first).astype(np.uint64)))))
        found.append((text[first], lo + first - offs[text[first]], count, kmer[q], h))
    return tuple(np.concatenate(x) for x in zip(*found))


def _runs(rid: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge regions that follow each other in a document."""
    order = np.lexsort((start, rid))
    rid, start, count = rid[order], start[order], count[order]
    new = np.append(True, (rid[1:] != rid[:-1]) | (start[1:] != (start + count)[:-1]))[:len(rid)]
    at = np.flatnonzero(new)
    return rid[at], start[at], np.add.reduceat(count, at) if len(at) else count


_REGION = "anchor long, content long, rid long, start long, strings long"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per region; repeats within a batch leave as runs, with a null anchor."""
    for batch in batches:
        data, offs = W.text_bytes(batch.column("text"))
        text, start, count, anchor, content = regions(data, offs)
        rid = batch.column("rid").to_numpy()[text]
        order = np.lexsort((start, rid, content, anchor))
        rid, start, count, anchor, content = (x[order] for x in (rid, start, count, anchor, content))
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]))[:len(rid)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)
        again = ~new & ((rid != rid[first]) | (start != start[first]))
        runs = _runs(rid[again], start[again], count[again])
        none = pa.nulls(len(runs[0]), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(x[new].view(np.int64)) for x in (anchor, content, rid, start, count))], names=["anchor", "content", "rid", "start", "strings"])
        yield pa.RecordBatch.from_arrays([none, none, *(pa.array(x) for x in runs)], names=["anchor", "content", "rid", "start", "strings"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From regions sorted by anchor, content and place: repeats as a whole (null anchor), and
    the first region of each content where the anchor has several contents. Regions that stand
    at the same place as the first one, of repeated rows, are dropped. One row is held."""
    held = np.zeros((0, 5), np.int64)
    several = False  # whether the held row's anchor had another content before
    names = ["anchor", "rid", "start", "strings"]

    def out(rows, runs):
        for r, keep in ((rows, True), (runs, False)):
            if len(r):
                anchor = pa.array(r[:, 0]) if keep else pa.nulls(len(r), pa.int64())
                yield pa.RecordBatch.from_arrays([anchor, *(pa.array(np.ascontiguousarray(r[:, k])) for k in (2, 3, 4))], names=names)

    for batch in batches:
        null = batch.column("anchor").is_null().to_numpy(zero_copy_only=False)
        table = np.stack([c.fill_null(0).to_numpy() for c in batch.columns], axis=1)
        yield from out(table[:0], table[null])
        rows = np.concatenate([held, table[~null]])
        if not len(rows):
            continue
        new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
        first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        again = ~new & (rows[:, 2:4] != rows[first, 2:4]).any(axis=1)
        heads = rows[new]
        follows = np.append(several, heads[1:, 0] == heads[:-1, 0])
        wanted = follows | np.append(heads[1:, 0] == heads[:-1, 0], False)
        yield from out(heads[:-1][wanted[:-1]], rows[again])
        held, several = heads[-1:], bool(follows[-1])
    yield from out(held[:1 if several else 0], held[:0])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the regions of a document out of its text, each for its shard."""
    for batch in batches:
        data, offs = W.text_bytes(batch.column("text"))
        shard, salted, rid, start, text = [], [], [], [], []
        for i, (r, found) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("found").to_pylist())):
            own = data[offs[i]:offs[i + 1]]
            for x in found:
                part = own[x["start"]:x["start"] + x["strings"] + MATCH - 1]
                if len(part) >= MATCH:
                    shard.append(x["shard"])
                    salted.append(x["salted"])
                    rid.append(r)
                    start.append(x["start"])
                    text.append(part.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(salted, pa.bool_()), pa.array(rid, pa.int64()),
                                          pa.array(start, pa.int64()), pa.array(text, pa.binary())], names=["shard", "salted", "rid", "start", "text"])


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """The repeats among a shard's regions, by suffix array and common prefixes. A salted shard
    also gives its first strings, which may be repeats of another shard's."""
    salted = bool(pdf["salted"].iloc[0])
    pdf = pdf.drop_duplicates(["rid", "start"]).sort_values(["rid", "start"])
    length = pdf["text"].str.len().to_numpy()
    raw = np.frombuffer(b"\xff".join(pdf["text"]) + b"\xff", np.uint8)  # a byte that no text has
    order = suffix_array(np.append(raw.astype(np.int64) + 1, 0), 257)
    shared = permuted_common_prefixes(np.append(raw, np.uint8(0)), order, MATCH)
    begin = np.cumsum(length + 1) - length - 1
    region = np.repeat(np.arange(len(length)), length + 1)
    within = np.arange(len(raw)) - begin[region]
    string = np.append(within <= length[region] - MATCH, False)
    order = order[string[order]]
    group = np.cumsum(shared[order] < MATCH)
    group -= group[0]
    least = np.full(group[-1] + 1, len(raw))
    np.minimum.at(least, group, order)  # text order is the order of (rid, start)
    again = order[order != least[group]]
    r = region[again]
    rid, start, strings = _runs(pdf["rid"].to_numpy()[r], pdf["start"].to_numpy()[r] + within[again], np.ones(len(r), np.int64))
    out = pd.DataFrame({"rid": rid, "start": start, "strings": strings, "text": None})
    if not salted:
        return out
    r = region[least]
    first = pd.DataFrame({"rid": pdf["rid"].to_numpy()[r], "start": pdf["start"].to_numpy()[r] + within[least], "strings": 1,
                          "text": [raw[a:a + MATCH].tobytes() for a in least]})
    return pd.concat([out, first])


_LAST = (1 << 63) - 1 - (1 << 40)


def _with_id(docs: DataFrame, name: str = "rid") -> DataFrame:
    """``rid`` orders the documents: doc_id, and for a null one a place after all others."""
    return docs.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST) + F.pmod(F.xxhash64("text"), F.lit(1 << 40))))


def repeats(docs: DataFrame) -> DataFrame:
    """``(rid, runs)``: for each document with repeats the first places and numbers of its
    repeated strings, in no order; staged."""
    spark = docs.sparkSession
    short_batches(spark)
    for key, value in (("applicationSideScanSizeThreshold", "1MB"), ("creationSideThreshold", "1GB")):
        spark.conf.set(_BLOOM + key, value)  # bounded by Spark's own limit on a filter's bits
    texts = _with_id(docs.select("doc_id", "text")).select("rid", "text")
    split = staged(texts.mapInArrow(_anchors, _REGION).repartition(F.coalesce("anchor", "rid"))
                   .sortWithinPartitions("anchor", "content", "rid", "start")
                   .mapInArrow(_split, "anchor long, rid long, start long, strings long"), "regions")
    edges = split.where("anchor is not null")
    hot = staged(edges.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > HOT), "hot")
    size = edges.agg(F.sum(F.col("strings") + MATCH)).first()[0] or 0
    salt = F.pmod(F.xxhash64("rid"), F.ceil(F.col("m") / HOT))
    shard = F.when(F.col("m").isNull(), F.pmod("anchor", F.lit(int(size // SHARD_BYTES) + 1))).otherwise(F.xxhash64("anchor", salt))
    edges = edges.join(hot, "anchor", "left").select("rid", F.struct(shard.alias("shard"), F.col("m").isNotNull().alias("salted"), "start", "strings").alias("one"))
    edges = staged(edges.groupBy("rid").agg(F.collect_list("one").alias("found"), F.count("*").alias("n")), "edges")
    found = staged(_matching(texts, edges, "n").select("rid", "text", "found")
                   .mapInArrow(_texts, "shard long, salted boolean, rid long, start long, text binary")
                   .groupBy("shard", "salted").applyInPandas(_shard, "rid long, start long, strings long, text binary"), "found")
    whole, part = split.where("anchor is null"), found.where("text is null")
    runs = whole.select("rid", "start", "strings").union(part.select("rid", "start", "strings"))
    strings = found.where("text is not null")
    if not strings.isEmpty():
        first = strings.groupBy("text").agg(F.min(F.struct("rid", "start")).alias("first"))
        again = strings.join(first, "text").where(F.struct("rid", "start") > F.col("first"))
        runs = runs.union(again.select("rid", "start", "strings"))
    return staged(runs.groupBy("rid").agg(F.collect_list(F.struct("start", "strings")).alias("runs"), F.count("*").alias("n")), "runs")


def _matching(texts: DataFrame, table: DataFrame, positive: str) -> DataFrame:
    """Rows of ``texts`` joined with ``table`` on rid. The predicate holds always; it lets Spark
    build its runtime filter from the small side, so few texts shuffle."""
    table = table.where(F.col(positive) >= 1).withColumnRenamed("rid", "its")
    return texts.join(table, F.col("rid") == F.col("its")).drop("its")


def spans(runs: list[dict], size: int) -> list[tuple[int, int]]:
    """The maximal removed runs of bytes, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], min(size, x["start"] + x["strings"] + MATCH - 1)) for x in runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = W.text_bytes(batch.column("text"))
        out: list[list] = [[], [], [], []]
        for i, runs in enumerate(batch.column("runs").to_pylist()):
            own = data[offs[i]:offs[i + 1]]
            gone = spans(runs or [], len(own))
            keep = np.ones(len(own), bool)
            for a, b in gone:
                keep[a:b] = False
            for column, value in zip(out, (int(len(own) - keep.sum()), len(gone), own[keep].tobytes(), [{"start": a, "end": b} for a, b in gone])):
                column.append(value)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("text_hash"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                          pa.array(out[2], pa.binary()), pa.array(out[3], span)],
                                         names=["rid", "text_hash", "n_removed", "n_spans", "kept", "spans"])


def cut(docs: DataFrame) -> DataFrame:
    """For each document that loses bytes: rid, text_hash, n_removed, n_spans, kept, spans.

    Texts are UTF-8 bytes, null counts as empty; texts below ``MATCH`` bytes lose nothing. A
    string is a repeat if it also starts earlier: in a document of smaller doc_id, or earlier in
    the same one. Null doc_ids come last, in a fixed order by text. Rows that repeat a doc_id
    are one document: nothing in one makes the same place in another a repeat, and what is cut
    at a place is cut there in all. ``spans`` are byte ranges; ``kept`` is not always valid
    UTF-8, as a range may end inside a character. Other columns are not read.
    """
    runs = repeats(docs)
    texts = _with_id(docs.select("doc_id", "text")).select("rid", "text")
    return (_matching(texts, runs, "n").select("rid", F.xxhash64("text").alias("text_hash"), "text", "runs")
            .mapInArrow(_cut, "rid long, text_hash long, n_removed long, n_spans long, kept binary, "
                        "spans array<struct<start: long, end: long>>"))


def summary(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    base = _with_id(docs.select("doc_id", "text")).select(
        "doc_id", "rid", F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole"))
    found = staged(cut(docs).select("rid", "text_hash", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")), "cut").dropDuplicates(["rid", "text_hash"])
    zero = F.lit(0).cast("long")
    return base.join(found, ["rid", "text_hash"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeats cut from ``text`` and ``n_chars`` (if there) counted anew.

    Rows keep all columns. Bytes of characters cut in two are left out. Documents whose bytes
    are all repeats are dropped; null and empty texts stay.
    """
    runs = repeats(docs)
    rid, its, found_runs = unused(docs, "_rid", "_its", "_runs")
    named = _with_id(docs, rid)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64())] * 2 + [batch.column(at), batch.column(found_runs)],
                                             names=["rid", "text_hash", "text", "runs"])
            for found in _cut([own]):
                texts = batch.column(at).to_pylist()
                kept = [None if whole is None else k.decode("utf-8", "ignore") for whole, k in zip(texts, found.column("kept").to_pylist())]
                mask = pa.array([bool(k or not whole) for k, whole in zip(kept, texts)], pa.bool_())
                columns = [pa.array(kept, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(mask)

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    joined = named.join(runs.select(F.col("rid").alias(its), F.col("runs").alias(found_runs)), F.col(rid) == F.col(its), "left")
    out = joined.select(*names, found_runs).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(names) if "n_chars" in names else out


def removed_of(docs: list[tuple[int | None, str | None]]) -> list[tuple[int, int, bytes]]:
    """Bytes removed, spans and kept bytes of documents in order, as a check for tests."""
    seen: set[bytes] = set()
    out = []
    for _, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - MATCH + 1):
            if b[i:i + MATCH] in seen:
                gone[i:i + MATCH] = b"\1" * MATCH
            seen.add(b[i:i + MATCH])
        out.append((sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), bytes(x for x, g in zip(b, gone) if not g)))
    return out
