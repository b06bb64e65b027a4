"""Mixing sources to target weights, with DataFrame operations only.

1. *Targets.* Sources share all words by weight. No target exceeds ``MAX_REPEATS`` times its
   source's size; what is above goes to the others by weight. With the sources in the order of
   that limit per weight, the level at which the rest is shared is the largest of the levels
   reached by giving the first k sources their limits, so no iteration is needed.
2. *Packing.* The words of a source, document after document, are cut into blocks of ``block``
   words. A document's offset is a running sum in two levels, within buckets of its source and
   over the bucket sums, so a hot source is spread over many tasks.
3. *Drawing.* A source gets its target's words in slots of its mean block. All slots are laid
   out in output shards of equal size, and every shard draws its counts per source: the whole
   part of what each source expects there, and the rest of the shard's slots one by one, from
   a multinomial whose chances are the remainders. So counts vary from shard to shard and
   between seeds, a shard needs no other one, and a source's total differs from its target by
   about the root of the number of shards, in blocks. A source at its limit gives every block
   ``MAX_REPEATS`` times; its slots are spread evenly, nothing is drawn for it.
4. *Mapping.* A source's slots are numbered through the shards. Slot n of a source with b blocks
   takes the block that its permutation for pass ``n div b`` puts at ``n mod b``: a block comes
   again only after all others came. A slot beyond ``MAX_REPEATS`` passes stays empty.
5. *Join.* Slots are counted per block and joined with the documents' shares of the blocks.

Permutations are swap-or-not shuffles: bijections of any range, computed for one index alone
from hashes, so they need no sort, no table and no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.search import count_below
from .staging import staged, unused

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK, SHARD_SLOTS = 64, 4096
BUCKET_DOCS, BUCKET_SHARDS = 10_000, 1024
#: Stage 4 carries remainders within buckets of so many documents of a source and size class.
CARRY_DOCS = 1000
_UNIT = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def permuted(df: DataFrame, index: str, size: str, key: Column, out: str, rounds: int = 8) -> DataFrame:
    """``df`` with ``out``: where a permutation of ``0 .. size - 1``, chosen by ``key``, puts
    ``index``."""
    n = F.col(size)

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(key, r) - x, n)
        coin = F.xxhash64(key, -r, F.greatest(x, partner)).bitwiseAND(1) == 1
        return F.when(coin, partner).otherwise(x)

    # one higher-order function: a chain of columns would grow the plan with every round
    return df.withColumn(out, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col(index).cast("long"), swap))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and a key of the row; staged."""
    return staged(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                              F.xxhash64("doc_id", "source", "text").alias("key")), "sized")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """Per source: sid, source, source_size, weight, target, blocks, slots, limited; staged.

    The table has one row per source, so its windows are small. Sources are numbered by code
    point, null last.
    """
    own = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("sid", F.row_number().over(by_name) - 1)
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    limit = MAX_REPEATS * F.col("source_size")
    by_limit = Window.orderBy(limit / F.col("weight"), "sid")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum(limit).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    own = own.withColumn("reached", (F.sum("source_size").over(everything) - before) / rest)
    own = own.withColumn("level", F.max("reached").over(everything))
    own = own.withColumn("target", F.least(limit.cast("double"), F.col("level") * F.col("weight")))
    own = own.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    # the last block may be short: slots are counted by the source's mean block
    most = MAX_REPEATS * F.col("blocks")
    by_mean = F.coalesce(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size")), F.lit(0.0))
    own = own.withColumn("limited", F.col("target") >= limit)
    own = own.withColumn("slots", F.when(F.col("limited"), most).otherwise(F.least(F.round(by_mean), most)).cast("long"))
    return staged(own.drop("reached", "level"), "targets")


def _drawn(shards: DataFrame, free: Column, n_free: int, slots: int, n_shards: int, seed: int) -> DataFrame:
    """shard, sid, blocks, n: the slots of sources below their limit. ``shards`` has a row per
    shard, ``free`` is the array of these sources with their slots, ``slots`` in all."""
    small, more = divmod(slots, n_shards)  # the first ``more`` shards have one slot above ``small``
    shard = F.col("shard")
    large = shard < more
    rows = shards.withColumns({"free": free, "size": F.when(large, F.lit(small + 1)).otherwise(F.lit(small)).cast("long")})

    # the whole parts: a source's slots before this shard have a closed form
    each = rows.select("shard", F.explode("free").alias("s")).select("shard", "s.*")
    base = [F.expr(f"({v}L * slots) div {slots}L") for v in (small, small + 1)]
    before = F.least(shard, F.lit(more)) * base[1] + F.greatest(shard - more, F.lit(0)) * base[0]
    each = each.select("shard", "sid", "blocks", before.alias("before"), F.when(large, base[1]).otherwise(base[0]).alias("base"))
    whole = each.where("base > 0").select("shard", "sid", "blocks", "before", F.explode(F.expr("sequence(0L, base - 1)")).alias("i"))
    whole = whole.select("shard", "sid", "blocks", (F.col("before") + F.col("i")).alias("n"))

    # the remainders: cumulative in units of 1 / slots, so they add up to whole slots
    cumulative = F.when(large, F.transform("free", lambda s: s["more"])).otherwise(F.transform("free", lambda s: s["few"]))
    rest = rows.withColumn("cum", cumulative).withColumn("top", F.element_at("cum", -1)).where("top > 0")
    rest = rest.select("*", F.explode(F.expr(f"sequence(0L, top div {slots}L - 1)")).alias("d"))
    u = F.pmod(F.xxhash64(F.lit(seed), "shard", "d"), F.col("top"))
    rest = rest.withColumn("s", F.get("free", count_below(F.col("cum"), u, n_free, or_equal=True))).select("shard", "d", "s.*")
    fixed = more * base[1] + (n_shards - more) * base[0]
    rest = rest.select("shard", "d", "sid", "blocks", fixed.alias("fixed"), F.expr(f"shard div {BUCKET_SHARDS}").alias("bucket"))
    over = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rest.groupBy("sid", "bucket").agg(F.count("*").alias("m"))
    sums = staged(sums.select("sid", "bucket", F.coalesce(F.sum("m").over(over), F.lit(0)).alias("offset")), "draws")
    within = F.row_number().over(Window.partitionBy("sid", "bucket").orderBy("shard", "d")) - 1
    rest = rest.withColumn("i", within).join(sums, ["sid", "bucket"])
    return whole.unionByName(rest.select("shard", "sid", "blocks", (F.col("fixed") + F.col("offset") + F.col("i")).alias("n")))


def slots(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> DataFrame:
    """Every slot of the mix: shard, slot (its place there), sid, pass, block."""
    spark = sources.sparkSession
    some = sources.where("slots > 0")
    total, free_slots, n_free = some.agg(F.sum("slots"), F.sum(F.when(~F.col("limited"), F.col("slots"))), F.count_if(~F.col("limited"))).first()
    n_shards = max(1, -(-(total or 0) // shard_slots))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) // 500_000)

    # sources at their limit: slot n lies in shard n * shards / slots
    full = some.where("limited").select("sid", "blocks", "slots", F.explode(F.expr(f"sequence(0, {MAX_REPEATS - 1})")).alias("pass"))
    full = full.repartition(tasks, "sid", "pass").select("*", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("i"))
    full = full.withColumn("n", F.col("pass") * F.col("blocks") + F.col("i"))
    each = full.select(F.floor(F.col("n") / F.col("slots") * n_shards).cast("long").alias("shard"), "sid", "blocks", "n")
    if free_slots:
        own = some.where(~F.col("limited"))
        by_sid = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)  # a row per source
        small = free_slots // n_shards
        cum = {name: F.sum(F.expr(f"({v}L * slots) % {free_slots}L")).over(by_sid).alias(name) for name, v in (("few", small), ("more", small + 1))}
        own = own.select("sid", "slots", "blocks", *cum.values())
        free = own.agg(F.array_sort(F.collect_list(F.struct("sid", "slots", "blocks", "few", "more")))).scalar()
        shards = spark.range(0, n_shards, 1, min(tasks, n_shards)).withColumnRenamed("id", "shard")
        each = each.unionByName(_drawn(shards, free, n_free, free_slots, n_shards, seed))
    each = each.where(F.col("n") < MAX_REPEATS * F.col("blocks")).withColumns({"pass": F.expr("n div blocks"), "index": F.col("n") % F.col("blocks")})
    each = permuted(each, "index", "blocks", F.xxhash64(F.lit(seed), "sid", "pass"), "block")
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "sid", "n"), "sid", "n")) - 1
    return each.withColumn("slot", place).select("shard", "slot", "sid", "pass", "block")


def packing(rows: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every document's share of the blocks: its row with sid, start, block, words. Documents
    without words have no block (null)."""
    buckets = max(64, rows.count() // BUCKET_DOCS)
    names = sources.select("sid", F.col("source").alias("its"), "source_size", "target")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(buckets))).join(names, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    over = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    sums = staged(sums.select("sid", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("offset")), "offsets")
    within = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("size").over(within)).join(sums, ["sid", "bucket"])
    rows = rows.withColumn("end", F.col("end") + F.col("offset")).withColumn("start", F.col("end") - F.col("size")).drop("offset", "bucket")
    rows = rows.withColumn("block", F.explode_outer(F.expr(f"if(size > 0, sequence(start div {block}, (end - 1) div {block}), null)")))
    words = F.least("end", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    return rows.withColumn("words", words)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, key.

    ``taken`` counts the document's words in the mix, repeats included: at most ``MAX_REPEATS``
    times its size. ``docs`` needs doc_id, source and text. Words are ``[^\\x20\\x09-\\x0D]+``; a
    null or empty text has none and is never taken. A null source is a source of its own, the
    last. Null doc_ids share one bucket of their source. Repeated rows are packed one after the
    other. Equal inputs give equal mixes, however they are partitioned. With no words at all,
    every target is 0.
    """
    rows = sized(docs)
    sources = targets(rows, weights, block)
    drawn = slots(sources, shard_slots, seed).groupBy("sid", "block").agg(F.count("*").alias("times"))
    # Spark takes the slots, made from the few rows of the sources, for a small table
    shares = packing(rows, sources, block).join(drawn.hint("merge"), ["sid", "block"], "left")
    row = ["doc_id", "source", "size", "source_size", "target", "start", "key"]
    taken = F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long")
    found = shares.groupBy(*row).agg(taken.alias("taken"), F.count("*").alias("rows"))
    # equal rows without words share a start: they were counted as one
    same = F.when(F.col("size") > 0, F.lit(1)).otherwise(F.col("rows").cast("int"))
    return found.withColumn("one", F.explode(F.sequence(F.lit(1), same))).drop("one", "rows", "start")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """Per key with words: rows (equal rows of ``docs``) and copies, how often stage 4 gives them
    all together.

    A document's rate is its taken words by its size. Along a source's documents, by size class,
    bucket and size, the rates are summed from a start that a hash of the source gives, and a
    document gets a copy for each whole number that the sum passes: its rate rounded down or
    up, the remainder going to the next document. So a document has at most ``MAX_REPEATS``
    copies, and as neighbours are of like size, a source's words stay near those that the mix
    takes. Rates are counted in units of 1 / ``_UNIT``, so that sums do not depend on their order.
    """
    found = mix(docs, weights, seed=seed).where("size > 0").groupBy("key", "source", "size").agg(
        F.count("*").alias("rows"), F.round(F.sum("taken") * _UNIT / F.col("size")).cast("long").alias("rate"))
    found = staged(found.withColumn("class", F.floor(2 * F.log2("size")).cast("int")), "rates")
    buckets = 1 + found.count() // CARRY_DOCS
    found = found.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(buckets)))
    over = Window.partitionBy("source").orderBy(F.col("class").desc(), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.groupBy("source", "class", "bucket").agg(F.sum("rate").alias("rates"))
    start = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(_UNIT))
    sums = staged(sums.select(F.col("source").alias("its"), F.col("class").alias("_class"), F.col("bucket").alias("_bucket"),
                              (start + F.coalesce(F.sum("rates").over(over), F.lit(0))).alias("offset")), "rate-offsets")
    within = Window.partitionBy("source", "class", "bucket").orderBy(F.col("size").desc(), "key").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum("rate").over(within))
    found = found.join(sums, F.col("source").eqNullSafe(F.col("its")) & (F.col("class") == F.col("_class")) & (F.col("bucket") == F.col("_bucket")))
    end = F.col("end") + F.col("offset")
    return found.select("key", "rows", (F.floor(end / _UNIT) - F.floor((end - F.col("rate")) / _UNIT)).cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, each in as many whole copies as ``copies`` gives it: a source's words
    are those that the mix takes but for the remainders of documents of like size. Equal rows
    (by doc_id, source and text) share their copies evenly."""
    found = copies(docs, weights, seed).where("copies > 0")
    key, its, rows, everything, rank, own, copy = unused(docs, "_key", "_its", "_rows", "_all", "_rank", "_copies", "_copy")
    found = found.select(F.col("key").alias(its), F.col("rows").alias(rows), F.col("copies").alias(everything))
    named = docs.withColumn(key, F.xxhash64("doc_id", "source", "text"))
    # the first of equal rows get what is left over; other columns only order them
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns)))
    share = F.expr(f"cast({everything} div {rows} + if({rank} <= {everything} % {rows}, 1, 0) as int)")
    return (named.join(found, F.col(key) == F.col(its)).withColumn(rank, place)
            .withColumn(own, share).where(F.col(own) > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(1), own))).select(docs.columns))


def targets_of(sizes: dict, weights: tuple[int, ...] = WEIGHTS) -> dict:
    """Targets by sharing the excess again and again, as a check for tests."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    while True:
        rest = sum(sizes.values()) - sum(MAX_REPEATS * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        out = {s: MAX_REPEATS * sizes[s] if s in full else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        above = {s for s in free if out[s] > MAX_REPEATS * sizes[s]}
        if not above:
            return out
        full |= above
