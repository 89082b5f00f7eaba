"""Benchmark decontamination by a broadcast hash set of normalised word windows.

Texts are lower-cased in A-Z and split into words of ASCII letters, digits and all that is not
ASCII. A benchmark item of at least `window` words gives all its windows of that many words, a
shorter one gives itself as one window. Their 64-bit hashes are a set of constants that every
task holds; each window of a document is looked up in it, and what hits is compared word by
word with the benchmark's windows. A document word in any verified window is hit.

The set itself is only shipped while the benchmark has at most `max_windows` distinct windows. Of a
larger one a bitmap of their hashes is shipped, of MAP_BITS for each window and 8 MB at most; the
windows of documents that it lets through leave their task, once for each distinct text, and are
joined with the benchmark's windows. The result is the same.

Everything is DataFrame expressions. Null and empty texts have no words and are clean; items
without words never occur; repeated rows of documents are each judged; repeated items count
once for each distinct item id; overlapping hits count their words once; very long texts are scanned
whole; an empty table gives none, and an empty benchmark no hit. Other columns pass through,
whatever their names; those named as results are replaced. Items without an id are left out
unless `unnamed` is true, as it is in the query and the pipeline: then their windows hit like any
other, and only item_ids has no entry for them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm._common import ascii_lower, cut, packed, table, unpacked

WINDOW = 10
#: Distinct benchmark windows up to which the set is shipped with the tasks (about 100 bytes each).
MAX_WINDOWS = 100_000
#: Bits of the bitmap for each window of a larger benchmark, and the most 64-bit words it may have.
MAP_BITS, MAX_MAP = 16, 1 << 20
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Buckets of the table in which a hit is compared.
BUCKETS = 4096


def words_of(text: Column) -> Column:
    """The normalised words of a text; none for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD)
    # only the first and the last part can be empty
    head = F.when(F.get(parts, F.lit(0)) == "", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when(F.get(head, F.size(head) - 1) == "", F.slice(head, 1, F.size(head) - 1)).otherwise(head)


def _nonempty(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def benchmark_windows(items: DataFrame, item_id: str, text: str, window: int, unnamed: bool = False) -> DataFrame:
    """gram (words joined by a space), k (its number of words), items (ids as strings, sorted; none for a null id)."""
    words = items.select(F.col(item_id).cast("string").alias("item"), _nonempty(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), NON_WORD)).alias("w")).filter(F.size("w") > 0)
    words = words if unnamed else words.filter(F.col("item").isNotNull())
    k = F.least(F.size("w"), F.lit(window))
    grams = words.withColumn("k", k).select("item", "k", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))).alias("gram"))
    return grams.groupBy("gram", "k").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _hash(words: Column) -> Column:
    return F.xxhash64(words)


def _cover(spans: Column) -> Column:
    """The number of places in the spans (from, to), which are sorted by from."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["to"] - F.greatest(a["end"], s["from"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["to"]).alias("end")),
        lambda a: a["n"].cast("long"),
    )


def _finish(frame: DataFrame, n_words: Column, hits: str, keep: list[str]) -> DataFrame:
    """hits: array of struct(from, to, items). keep: what _own holds."""
    spans = F.sort_array(F.transform(hits, lambda h: F.struct(h["from"].alias("from"), h["to"].alias("to"))))
    found = F.sort_array(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["items"]))))
    none = F.size(hits) == 0
    n_hit = F.when(none, F.lit(0).cast("long")).otherwise(_cover(spans))
    ids = F.when(none, F.array().cast("array<string>")).otherwise(found)
    places = F.when(none, F.array().cast("array<struct<from:int,to:int>>")).otherwise(spans)
    # a generator, so that a filter on the result doesn't repeat all this in its condition
    out = frame.select(*unpacked(keep), F.inline(F.array(F.struct(n_words.alias("n_words"), n_hit.alias("n_hit"), ids.alias("item_ids"), places.alias("spans")))))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS, keep: list[str] | None = None, unnamed: bool = False) -> DataFrame:
    """The columns `keep` (all, if None) of each row with n_words, n_hit, item_ids, spans (word places from, to) and contaminated."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_hit", "item_ids", "spans", "contaminated")]
    grams = benchmark_windows(items, item_id, item_text, window, unnamed)
    held = grams.limit(max_windows + 1).collect()
    base = docs.select(packed(docs, keep), words_of(F.col(text)).alias("_w"))
    if len(held) > max_windows:
        return _joined(base, cut(grams), keep)
    n = F.size("_w")
    if not held:
        return _finish(base.withColumn("_hits", F.array().cast("array<struct<from:int,to:int,items:array<string>>>")), n.cast("long"), "_hits", keep)

    spark = docs.sparkSession
    lengths = sorted({r["k"] for r in held})
    hashed = spark.createDataFrame([(r["gram"].split(" "), r["k"]) for r in held], "w array<string>, k int").select("k", F.xxhash64("w").alias("h")).collect()
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for r, h in zip(held, hashed, strict=True):
        buckets[h["h"] % BUCKETS].append({"g": r["gram"], "i": list(r["items"])})
    lookup = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<g:string,i:array<string>>>>")

    def candidates(k: int) -> Column:
        known = sorted({r["h"] for r in hashed if r["k"] == k})
        places = F.filter(F.sequence(F.lit(1), n - k + 1), lambda i: _hash(F.slice("_w", i, F.lit(k))).isin(known))
        return F.when(n >= k, F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(k).alias("k")))).otherwise(F.array().cast("array<struct<at:int,k:int>>"))

    found = base.withColumn("_places", F.concat(*map(candidates, lengths)))

    def verified(p: Column) -> Column:
        part = F.slice("_w", p["at"], p["k"])
        same = F.filter(F.get(lookup, F.pmod(_hash(part), F.lit(BUCKETS)).cast("int")), lambda e: e["g"] == F.array_join(part, " "))
        return F.struct((p["at"] - 1).alias("from"), (p["at"] - 1 + p["k"]).alias("to"), F.transform(same, lambda e: e["i"]).alias("same"))

    none = F.array().cast("array<struct<from:int,to:int,items:array<string>>>")
    real = F.filter(F.transform("_places", verified), lambda h: F.size(h["same"]) > 0)
    hits = F.when(F.size("_places") == 0, none).otherwise(F.transform(real, lambda h: F.struct(h["from"].alias("from"), h["to"].alias("to"), F.flatten(h["same"]).alias("items"))))
    return _finish(found.withColumn("_hits", hits), n.cast("long"), "_hits", keep)


def _bitmap(grams: DataFrame) -> tuple[Column, int]:
    """The bits of the hashes of grams (h) as an array of longs, a constant of the plan, and their number."""
    n = grams.count()
    size = min(MAX_MAP, 1 << max(6, (n * MAP_BITS // 64).bit_length()))
    bits = size * 64
    at = F.pmod("h", F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    words = [0] * size
    for r in grams.groupBy(F.floor(at / 64).cast("int").alias("i")).agg(F.bit_or(one).alias("b")).toLocalIterator():
        words[r["i"]] = r["b"]
    return F.from_json(F.lit(json.dumps(words)), "array<bigint>"), bits


def _joined(base: DataFrame, grams: DataFrame, keep: list[str]) -> DataFrame:
    """The same for a benchmark of any size: windows that its bitmap lets through meet it by hash and text.

    Hits are found once for each distinct text, so that repeated rows need no key of their own.
    """
    lengths = [r["k"] for r in grams.select("k").distinct().collect()]
    grams = cut(grams.withColumn("h", _hash(F.split("gram", " "))))
    held, bits = _bitmap(grams)
    base = base.withColumn("_text", F.sha2(F.array_join("_w", " "), 256))
    n = F.size("_w")

    def known(h: Column) -> Column:
        at = F.pmod(h, F.lit(bits))
        return F.get(held, F.floor(at / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))) != 0

    def windows(k: int) -> Column:
        found = F.filter(F.sequence(F.lit(1), n - k + 1), lambda i: known(_hash(F.slice("_w", i, F.lit(k)))))
        found = F.transform(found, lambda i: F.struct(i.alias("at"), F.lit(k).alias("k"), F.array_join(F.slice("_w", i, F.lit(k)), " ").alias("gram")))
        return F.when(n >= k, found).otherwise(F.array().cast("array<struct<at:int,k:int,gram:string>>"))

    every = F.concat(*map(windows, lengths))
    places = base.select("_text", F.explode(every).alias("p")).select("_text", "p.*").distinct().withColumn("h", _hash(F.split("gram", " ")))
    hits = places.join(grams.select("h", "gram", "items"), ["h", "gram"]).groupBy("_text").agg(F.collect_list(F.struct((F.col("at") - 1).alias("from"), (F.col("at") - 1 + F.col("k")).alias("to"), "items")).alias("_found"))
    none = F.array().cast("array<struct<from:int,to:int,items:array<string>>>")
    all_ = base.select("_own", n.cast("long").alias("_n"), "_text")
    return _finish(all_.join(hits, "_text", "left").withColumn("_hits", F.coalesce("_found", none)), F.col("_n"), "_hits", keep)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate(docs, items, keep=["doc_id"], unnamed=True)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


#: Words of a text, as DuckDB takes them; A-Z alone are lower-cased.
SQL_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def hits_sql(docs: str) -> str:
    """Common table expressions ending in hits(doc_id, p, item_id): each document word place in an occurring window."""
    return f"""
    iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {SQL_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
    grams AS (
      SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM iw WHERE len(w) > 0)),
    dw AS (SELECT doc_id, {SQL_WORDS.format("coalesce(text, '')")} AS w FROM {docs}),
    found AS (
      SELECT d.doc_id, d.i, d.k, g.item_id
      FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k)) d
      JOIN grams g ON g.k = d.k AND g.g = d.g),
    hits AS (SELECT doc_id, unnest(range(i, i + k)) AS p, item_id FROM found)"""


SQL = {
    "op7_decontamination": f"""
    WITH {hits_sql("documents")},
    per AS (SELECT doc_id, count(DISTINCT p) AS n_hit, list_sort(list(DISTINCT item_id)) AS items FROM hits GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, CAST(coalesce(len(p.items), 0) AS BIGINT) AS n_items,
      sha256(coalesce(array_to_string(p.items, ','), '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
    FROM dw d LEFT JOIN per p ON p.doc_id = d.doc_id"""
}
QUERIES = {"op7_decontamination": op7_decontamination}
