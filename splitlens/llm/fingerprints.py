"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ``K`` least distinct hashes of a text's shingles. The sketch of a union is the
``K`` least of two sketches' union, so parts sketch on their own and merge in any order. Among
the ``K`` least of the union, the share in both sketches estimates the resemblance; the k-th
least value estimates the number of distinct shingles; both give the containment.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W

K, SHINGLE = 128, 5


def sketch(found: np.ndarray, k: int = K) -> np.ndarray:
    """The ``k`` least of distinct sorted hashes."""
    return found[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0 ** 64 / max(1.0, float(a[-1]))


def _both(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    union = merge(a, b, k)
    return int(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()), len(union)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact while the union has at most ``k`` shingles. Two
    sketches without shingles are alike (1), one with and one without are not (0)."""
    both, union = _both(a, b, k)
    return both / union if union else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first one's shingles that the second one has; 1 without any."""
    both, union = _both(a, b, k)
    if not len(a):
        return 1.0
    return min(1.0, both / union * distinct(merge(a, b, k), k) / distinct(a, k))


def text_of(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def edited(text: str, nxt: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[:len(text) - n] + nxt[:n]


def fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id and text are used) as doc_id, n_chars, sketch (array of long, ascending as
    unsigned), n_distinct. Null and empty texts have an empty sketch; repeated rows stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(s, k) for s in W.shingle_sets(batch.column("text"), shingle)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32))
            flat = pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_chars"), pa.ListArray.from_arrays(offsets, flat),
                                              pa.array([distinct(s, k) for s in found], pa.float64())], names=["doc_id", "n_chars", "sketch", "n_distinct"])

    own = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")
    return own.mapInArrow(run, "doc_id long, n_chars long, sketch array<long>, n_distinct double")


def merged(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """The sketches' unions per group: ``by``, sketch. Exploded hashes are made distinct and cut to
    the ``k`` least per group in two levels, by a part of the hash first, so a hot group is spread."""
    each = sketches.select(*by, F.explode("sketch").alias("h")).distinct()
    each = each.withColumn("u", F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).withColumn("part", F.pmod("h", F.lit(64)))
    for keys in ([*by, "part"], by):
        each = each.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("u"))).where(F.col("_n") <= k).drop("_n")
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("u")), lambda u: u.bitwiseXOR(F.lit(-(1 << 63)))).alias("sketch"))


_NEXT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
         "near_edited double, near_next double, n_distinct double, contained_in_edited double")


def _compare(k: int, shingle: int):
    """From rows sorted by bucket and place: each document with the one after it. A guard row
    ends a bucket: it is the first document of the next one, and is no result itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = batch.select(["bucket", "guard", "doc_id", "text"]).to_pylist()
            own = list(W.shingle_sets(batch.column("text"), shingle))
            pairs = []
            for row, found in zip(rows, own):
                row["text"], row["sketch"] = row["text"] or "", sketch(found, k)
                if held is not None and not held["guard"] and held["bucket"] == row["bucket"]:
                    pairs.append((held, row))
                held = row
            texts = [edited(a["text"], b["text"]) for a, b in pairs]
            changed = [sketch(s, k) for s in W.shingle_sets(pa.array(texts, pa.large_string()), shingle)]
            out = [(a["doc_id"], len(a["text"]), sha256(t.encode("utf-8", "surrogatepass")).hexdigest(), text_of(a["sketch"]), text_of(s),
                    resemblance(a["sketch"], s, k), resemblance(a["sketch"], b["sketch"], k), distinct(a["sketch"], k), containment(a["sketch"], s, k))
                   for (a, b), t, s in zip(pairs, texts, changed)]
            names = [c.split()[0] for c in _NEXT.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
    return run


def with_next(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness.

    The next document is the one with the next doc_id (null ids last; equal ids in a
    fixed order by text); after the last comes the first. Texts are read whole, null as empty. Documents
    are dealt into ranges of doc_id, each read in order as a stream; the first one of a range
    also ends the range before it, so no text but that one is sent twice. The bounds of the
    ranges come from a quantile summary, and number as many as the tasks. An empty table gives
    no rows; other columns are not read.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    points = [i / (2 * tasks) for i in range(1, 2 * tasks)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), points, 100 * tasks).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    bound = F.array(*map(F.lit, cuts)).cast("array<long>")
    null = F.lit(len(cuts) + 33) + F.shiftright("h", 58)  # null ids are dealt by text hash, their order
    bucket = F.when(F.col("doc_id").isNull(), null).otherwise(F.size(F.filter(bound, lambda c: c < F.col("doc_id"))))
    rows = rows.withColumn("bucket", bucket.cast("int"))
    place = F.struct("doc_id", "h").alias("p")
    over = Window.orderBy("to")  # a row per bucket, so as many as tasks
    firsts = rows.groupBy(F.col("bucket").alias("to")).agg(F.min(place).alias("p")).select("to", "p.*")
    last = F.max("to").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.withColumn("before", F.coalesce(F.lag("to").over(over), last)).select("to", "before", F.col("doc_id").alias("its"), F.col("h").alias("its_h"))
    firsts = F.broadcast(firsts)
    first = (F.col("bucket") == F.col("to")) & F.col("doc_id").eqNullSafe(F.col("its")) & (F.col("h") == F.col("its_h"))
    ends = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guard"))
    each = F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("guard")), F.when(F.col("before").isNotNull(), ends)))
    dealt = rows.join(firsts, first, "left").select("doc_id", "h", "text", F.explode(each).alias("e")).select("e.*", "doc_id", "h", "text")
    dealt = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "guard", F.col("doc_id").asc_nulls_last(), "h")
    return dealt.drop("h").mapInArrow(_compare(k, shingle), _NEXT)


def near_of(text: str | None, other: str | None) -> float:
    """Exact Jaccard similarity of the 5-word shingles, as a check for tests."""
    import re

    sets = []
    for t in (text, other):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i:i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0
