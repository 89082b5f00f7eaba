"""Shards of equal counts that keep linked documents together, by balanced label propagation.

Documents with equal texts are linked. A group's links form a star around the group itself, so
that no pairs are made: in each round every group counts its documents in each shard, picks the
shard with most of them that still takes some, and its other members, in cells of those that
started in the same shard, want to move there. A shard takes at most its quota; where more want
to come than fit, cells are taken by their hash. Groups of a quarter of a quota and more, of which
there are four a shard at most, would find no shard with room for all of them: they fill one shard
after another first, which cuts each of them least. At the end the counts are made exact: shards over their quota hand documents on, those
without links first, to shards below it.

The law is `rows`: counts differ by one at most. Ranks are sums over buckets of document hashes,
each bucket ranked by itself, so that no task sorts a shard.

Everything is DataFrame expressions. Null texts count as empty; null ids and repeated rows are
rows like any other; very long texts count as they are; groups that want the same place are
ordered by their hash; an empty table gives none. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwright.llm._common import cut, table

SHARDS = 24
ROUNDS = 4
#: Rows that a bucket of the ranks holds about.
BUCKET_ROWS = 4096


def _unit(*columns: str) -> Column:
    """A number in [0, 1) from the columns' hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _quota(total: int, shards: int) -> Column:
    return F.lit(total // shards) + F.when(F.col("s") < total % shards, 1).otherwise(0)


def propagate(cells: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """cells: g (group), s0 (the shard its n documents started in). Adds s, the shard where they end."""
    spark = cells.sparkSession
    quota = max(1, total // shards)
    # groups of a quarter of a shard and more, of which there are 4 * shards at most, fill one shard after another and stay
    sizes = cells.groupBy("g").agg(F.sum("n").alias("all"))
    large = cells.join(sizes.filter(F.col("all") * 4 >= quota), "g")
    upto = F.sum("n").over(Window.orderBy(F.desc("all"), "g", "s0"))
    at = F.least(F.floor((upto - F.col("n") / 2) / quota).cast("int"), F.lit(shards - 1))
    large = large.withColumn("s", at).select("g", "s0", "n", "s", F.lit(True).alias("stays"))
    small = cells.join(sizes.filter(F.col("all") * 4 < quota).select("g"), "g").select("g", "s0", "n", F.col("s0").alias("s"), F.lit(False).alias("stays"))
    state = cut(large.union(small))
    all_shards = spark.range(shards).select(F.col("id").cast("int").alias("s"))
    for _ in range(rounds):
        held = state.groupBy("g", "s").agg(F.sum("n").alias("n"))
        # a shard whose linked documents fill it takes no more
        full = held.groupBy("s").agg(F.sum("n").alias("linked"))
        room = cut(all_shards.join(full, "s", "left").select("s", (_quota(total, shards) - F.coalesce("linked", F.lit(0))).alias("room")))
        near = state.filter("NOT stays").groupBy("g", "s").agg(F.sum("n").alias("n")).join(F.broadcast(room), "s").withColumn("open", F.col("room") > 0)
        # most documents first; a full shard is a choice only for what is in it already
        best = near.filter("open").groupBy("g").agg(F.max_by("s", F.struct("n", F.xxhash64("g", "s"))).alias("to"))
        wish = state.join(best, "g").filter("s <> to")
        demand = wish.groupBy(F.col("to").alias("s")).agg(F.sum("n").alias("want"))
        share = demand.join(F.broadcast(room), "s").select(F.col("s").alias("to"), F.least(F.lit(1.0), F.col("room") / F.col("want")).alias("share"))
        share = cut(all_shards.select(F.col("s").alias("to")).join(share, "to"))
        moved = state.join(best, "g", "left").join(F.broadcast(share), "to", "left")
        goes = (F.col("s") != F.col("to")) & (F.when(F.col("share") >= 1, F.lit(True)).otherwise(_unit("g", "s0") < F.col("share")))
        state = cut(moved.select("g", "s0", "n", "stays", F.when(F.coalesce(goes, F.lit(False)), F.col("to")).otherwise(F.col("s")).alias("s")))
    return state


def _ranked(rows: DataFrame, key: str, bucket: Column, order: list, out: str) -> DataFrame:
    """Adds each row's rank from 0 within its key: the rows of lesser buckets, and its place in its own."""
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select(key, "_bucket", (F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1
    return rows.withColumn("_own", own).join(before, [key, "_bucket"]).withColumn(out, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_bucket")


def balanced_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) and linked for each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("id"), (F.octet_length(t) + F.lit(8)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"), F.xxhash64(t).alias("g"))
    base = cut(base.withColumn("s0", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")))
    total = base.count()
    counts = base.groupBy("g", "s0").agg(F.count("*").alias("n"))
    linked = counts.groupBy("g").agg(F.sum("n").alias("all")).filter("all > 1").select("g")
    ended = propagate(cut(counts.join(linked, "g")), total, shards, rounds)
    placed = base.join(ended.select("g", "s0", "s"), ["g", "s0"], "left").select("id", "size", "crc", F.col("s").isNotNull().alias("linked"), F.coalesce("s", "s0").alias("s"))
    buckets = max(1, total // (shards * BUCKET_ROWS) + 1) * 8
    # a hash of its own: the one that chose the first shard would put a shard's rows into one bucket
    spread = F.pmod(F.xxhash64("id", "crc", "size"), F.lit(buckets))
    order = ["id", "crc", "size"]
    # linked documents have the first ranks of a shard
    ranked = _ranked(placed, "s", F.when(F.col("linked"), spread).otherwise(spread + buckets), order, "r")
    over = F.col("r") >= _quota(total, shards)
    ranked = cut(ranked.withColumn("over", over))
    # places that are free, as intervals of the surplus documents' common numbering
    each = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("s")).join(ranked.groupBy("s").agg(F.count("*").alias("n")), "s", "left")
    each = cut(each.select("s", F.coalesce("n", F.lit(0)).alias("n"), _quota(total, shards).alias("q")))
    tally = [(r["s"], r["n"], r["q"]) for r in each.orderBy("s").collect()]
    first, free, surplus_at, taken = {}, [], 0, 0
    for s, n, q in tally:
        first[s] = surplus_at
        surplus_at += max(0, n - q)
        if q > n:
            free.append((taken, taken + q - n, s))
            taken += q - n
    number = F.col("r") - _quota(total, shards) + _choose([(F.col("s") == s, F.lit(v)) for s, v in first.items()])
    target = _choose([(number < hi, F.lit(s)) for _, hi, s in free], F.col("s"))
    final = ranked.select("id", "size", "crc", "linked", F.when(F.col("over"), target).otherwise(F.col("s")).cast("int").alias("shard"))
    slots = _ranked(final, "shard", spread, order, "slot")
    return slots.select(F.col("id").alias(doc_id), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")


def _choose(cases: list, rest: Column | None = None) -> Column:
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    if out is None:
        return F.lit(0) if rest is None else rest
    return out if rest is None else out.otherwise(rest)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return balanced_shards(docs).drop("linked")


QUERIES = {"op5_sharding": op5_sharding}
SQL: dict[str, str] = {}
