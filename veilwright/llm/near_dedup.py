"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct shingles of `words` words (a shorter text is one shingle), each
a 64-bit hash. Documents with the same set are one class, so that copies cost nothing further: sets
are told apart by 128 bits, and their 64-bit ids by a new hash where two meet. Of each class the
`K` smallest hashes are its sketch.

Candidates come from inverted lists of retained values. Two sets with Jaccard 0.8 share at least
LEAST of K retained values (80 % of the set where the sketches are complete; otherwise fewer
have a probability of 1e-8), so that it is enough to list each class under its rarest values,
all but LEAST - 1 of them. A value that is frequent because a passage is repeated in many
documents is listed only where little else is in the text. Each class is
compared, on the full sets, with one other: its center, the class of most copies that leads one of
its lists. Classes near a center are known by how they differ from it. A pair that the centers leave
in different components, and that is linked, shares a calculable part of these differences, so it
meets under the rarest of them (prefix and position filters, which are exact bounds). Pairs far from
their center, and of different centers, meet in the lists themselves. The sketch of the union
of such pairs estimates their Jaccard and drops what is far below; the rest is decided on the full
sets. Links become components by alternating large and small stars, few links on the driver.

Null and empty texts have no shingles and link with nothing. Repeated rows and null document
ids are allowed: a component's id is its least id that is not null. Of classes with equally many
copies the one of the greatest set id leads a list, of values in equally many lists the least is
rarer: ties change no link. Very long texts are taken whole. An empty table gives none. Columns of
any name pass through drop_near_duplicates(); near_duplicates() returns its own alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from veilwright.llm._common import cut, cut_small, map_rows, packed, release, table, unpacked

K = 64
LEAST = 30
#: Jaccard with its center from which a class is described by what it has beyond the center.
NEAR = 0.5
#: Estimates this far below the threshold are never confirmed: over six standard deviations.
MARGIN = 0.31
SEEN_WORDS = 100_000
#: Pairs of one center that are compared together: a center's text is sent so many times as it has lots of these.
LOT = 256
#: Classes up to which their ids are sent to all tasks to find their texts (16 bytes each).
MAX_BROADCAST = 200_000
#: Links up to which the driver joins them to components by itself (16 bytes each); more are joined by the executors.
MAX_COLLECTED = 100_000
#: Odd factors of the places in a shingle.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, words: int):
        import numpy as np
        import xxhash

        self.np, self.k = np, words

        class Seen(dict):
            def __missing__(self, word, f=xxhash.xxh3_64_intdigest):
                if len(self) >= SEEN_WORDS:
                    self.clear()
                h = self[word] = f(word)
                return h

        self.seen = Seen()

    def __call__(self, text: str | None):
        np, k = self.np, self.k
        # bytes: lower() and split() then know ASCII letters and ASCII white space alone
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(self.seen.__getitem__, words), np.uint64, n)
        m = min(k, n)
        h = np.full(n - m + 1, m, np.uint64)
        for i in range(m):
            h += w[i : n - m + 1 + i] * np.uint64(FACTORS[i % len(FACTORS)] + 2 * (i // len(FACTORS)))
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
        return np.unique(h)


def sketched(docs: DataFrame, text: str, words: int) -> DataFrame:
    """Replaces the text by set_id and check (of the whole set, null if empty), n_shingles and sketch."""

    def make():
        shingle = Shingler(words)
        np = shingle.np

        def f(t):
            h = shingle(t)
            if not len(h):
                return None, None, 0, []
            low = (h[:K] ^ np.uint64(1 << 63)).view(np.int64).tolist()
            digest = blake2b(h.tobytes(), digest_size=16).digest()
            return *(int.from_bytes(x, "little", signed=True) for x in (digest[:8], digest[8:])), len(h), low

        return f

    added = pa.schema([("set_id", pa.int64()), ("check", pa.int64()), ("n_shingles", pa.int64()), ("sketch", pa.list_(pa.int64()))])
    return map_rows(docs, [text], added, "set_id long, check long, n_shingles long, sketch array<long>", make, drop=(text,))


def _needed(n: Column) -> Column:
    """Retained values that a class shares at least with any class it may be linked to."""
    return F.when(n <= K * 8 // 10, F.ceil(n * 8 / F.lit(10)).cast("int")).otherwise(F.lit(LEAST))


def _lists(sets: DataFrame) -> DataFrame:
    """value, set_id: each class under its rarest retained values, those of no other class aside."""
    every = sets.select("set_id", F.explode("sketch").alias("value"))
    shared = every.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    mine = every.join(shared, "value").groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    mine = mine.join(sets.select("set_id", F.col("n_shingles").alias("n")), "set_id")
    size = F.least(F.col("n"), F.lit(K)).cast("int")
    room = size - _needed(F.col("n")) + 1 - (size - F.size("v"))
    rare = mine.withColumn("room", room).filter("room > 0").select("set_id", F.transform(F.slice("v", 1, F.greatest(F.col("room"), F.lit(0))), lambda x: x["value"]).alias("values"))
    return rare.select("set_id", F.explode("values").alias("value"))


def _estimate(a: str, b: str) -> Column:
    """The Jaccard of two sets by the sketch of their union; exact where both sketches are whole sets."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    both = F.array_intersect(F.array_intersect(union, F.col(a)), F.col(b))
    return F.size(both) / F.size(union)


def _compared(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """For the pairs (a, b), from the full sets: shared (shingles of both), n_a, n_b, linked, and differs.

    differs: the shingles of only one of them, where the Jaccard is NEAR or more; otherwise null.
    texts: set_id, body.
    """
    lots = pairs.groupBy("a").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    dealt = pairs.select("a", "b").join(lots, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot"))
    every = texts.join(lots, F.col("set_id") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.col("body").alias("body_a"))
    both = dealt.join(texts.select(F.col("set_id").alias("b"), F.col("body").alias("body_b")), "b").join(every, ["a", "lot"])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
    names = ["a", "b", "shared", "n_a", "n_b", "linked", "differs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        np = shingle.np
        last_id, last = None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "body_a", "body_b"))
            rows = []
            for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
                if x != last_id:
                    last_id, last = x, shingle(ta[i].as_py())
                other = shingle(tb[i].as_py())
                differs = np.setxor1d(other, last, assume_unique=True)
                union = (len(last) + len(other) + len(differs)) // 2
                shared = union - len(differs)
                rows.append((x, y, shared, len(last), len(other), 100 * shared >= percent * union, differs.view(np.int64).tolist() if shared >= NEAR * union else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=names)
        release()

    return both.mapInArrow(run, "a long, b long, shared long, n_a long, n_b long, linked boolean, differs array<long>")


def _others(star: DataFrame, lists: DataFrame, centers: DataFrame, members: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be linked although their centers joined them not.

    Sets b and c of sizes n_b and n_c are linked if they differ in t (n_b + n_c) shingles at most,
    with t = (100 - percent) / (100 + percent). Near a center a, let d_b and d_c be the numbers of
    shingles in which each differs from it, and o how many of these are common: b and c differ in
    d_b + d_c - 2 o. So a link takes o >= (d_b + d_c - t (n_b + n_c)) / 2. Of a pair in different
    components one, say b, is not linked with a, so that d_b > t (n_a + n_b). This gives for the other
    o > (d_c + t (n_a - n_c)) / 2, and with o <= d_c and n_c <= n_a + d_c for b itself
    o >= (d_b - t (n_a + n_b)) / (1 + t). Two sets with o common members meet among the rarest
    d - o + 1 of each, in one order for all, and at places i and j of it with min(d_b - i, d_c - j) + 1 >= o.

    Pairs of which one is so far from a that this says little, but for those that the triangle
    inequality of 1 - Jaccard parts, and pairs with different centers meet in the first list that
    both are in.
    """
    rooted = star.join(roots.select(F.col("node").alias("b"), "root"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    rooted, _ = cut_small(rooted.withColumn("jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))))
    mixed = rooted.groupBy("a").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("a")
    t = (100 - percent) / (100 + percent)
    close = F.abs(F.col("j1") - F.col("j2")) <= 1 - percent / 100 + 1e-9
    apart = (F.col("r1") != F.col("r2")) & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))

    d, n_a, n_b = F.size("differs"), F.col("n_a"), F.col("n_b")
    at_least = lambda x: F.greatest(F.ceil(x - 1e-6), F.lit(1)).cast("int")
    near = rooted.filter(F.col("differs").isNotNull()).join(mixed, "a").withColumns(
        {"d": d, "most_any": d - at_least((d + t * (n_a - n_b)) / 2) + 1, "most_open": F.when(F.col("linked"), 0).otherwise(d - at_least((d - t * (n_a + n_b)) / (1 + t)) + 1)}
    )
    each = near.select("a", "b", F.explode("differs").alias("value"))
    several = each.groupBy("a", "value").agg(F.count("*").alias("df")).filter("df > 1")
    mine = each.join(several, ["a", "value"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    # shingles of no other class are the rarest and take the first places
    mine = mine.join(near.drop("differs"), ["a", "b"]).withColumn("alone", F.col("d") - F.size("v"))

    def side(k: int, most: str, *more: str) -> DataFrame:
        rarest = F.slice("v", 1, F.greatest(F.col(most) - F.col("alone"), F.lit(0)))
        names = {"b": "b", "n_b": "n", "root": "r", "jaccard": "j", "d": "d"}
        rows = mine.select("a", *(F.col(c).alias(f"{x}{k}") for c, x in names.items()), *more, "alone", F.posexplode(rarest).alias("i", "x"))
        return rows.withColumn("value", F.col("x.value")).withColumn(f"i{k}", F.col("i") + F.col("alone") + 1).drop("x", "i", "alone")

    o = (F.col("d1") + F.col("d2") - t * (F.col("n1") + F.col("n2"))) / 2
    fits = F.least(F.col("d1") - F.col("i1"), F.col("d2") - F.col("i2")) + 1 >= o - 1e-6
    once = F.when(F.col("linked"), F.lit(True)).otherwise(F.col("b1") < F.col("b2"))
    alike = side(1, "most_open").join(side(2, "most_any", "linked"), ["a", "value"]).filter((F.col("b1") != F.col("b2")) & once & apart & fits)

    known = centers.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    known = known.join(rooted.select(F.col("b").alias("set_id"), F.col("jaccard").alias("j")), "set_id", "left").withColumn("j", F.coalesce("j", F.lit(1.0)))
    held, _ = cut_small(lists.join(known, "set_id"))
    span = held.groupBy("value").agg(F.min("root").alias("r_low"), F.max("root").alias("r_high"), F.min("center").alias("c_low"), F.max("center").alias("c_high"), F.min("j").alias("least"))
    open_ = span.filter((F.col("r_low") != F.col("r_high")) & ((F.col("c_low") != F.col("c_high")) | (F.col("least") < NEAR))).select("value")
    rows = held.join(open_, "value").join(members.select("set_id", F.col("n_shingles").alias("n"), "values", "sketch"), "set_id")
    one = lambda k: rows.select("value", F.col("set_id").alias(f"b{k}"), *(F.col(c).alias(f"{c[0]}{k}") for c in ("n", "root", "center", "j")), F.col("values").alias(f"v{k}"), F.col("sketch").alias(f"k{k}"))
    same = (F.col("c1") == F.col("c2")) & (F.least("j1", "j2") < NEAR) & close
    untried = (F.col("c1") != F.col("b2")) & (F.col("c2") != F.col("b1"))
    first = F.get(F.array_intersect("v1", "v2"), F.lit(0)) == F.col("value")
    likely = lambda x, y: _estimate(x, y) >= percent / 100 - MARGIN
    far = one(1).join(one(2), "value").filter((F.col("b1") < F.col("b2")) & apart & untried & (same | (F.col("c1") != F.col("c2"))) & F.when(first, likely("k1", "k2")).otherwise(False))

    pair = lambda frame: frame.select(F.least("b1", "b2").alias("a"), F.greatest("b1", "b2").alias("b"))
    sketches = lambda k: members.select(F.col("set_id").alias(k), F.col("sketch").alias(f"s_{k}"))
    guessed = pair(alike.select("b1", "b2")).distinct().join(sketches("b"), "b").join(sketches("a"), "a")
    return guessed.filter(likely("s_a", "s_b")).select("a", "b").union(pair(far)).distinct()


def _texts(base: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """set_id, body: a text of each wanted class (set_id, low, check, least)."""
    wanted = wanted.select(F.col("set_id").alias("_wanted"), "low", F.col("check").alias("_check"), F.col("least").alias("_least"))
    if wanted.count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    found = base.join(wanted, F.col("_id").eqNullSafe(F.col("_least")), "inner").select("_wanted", "low", "_check", "_text", F.col("_text").alias("body"))
    # an id may stand on rows of several texts
    return sketched(found, "_text", words).filter("set_id = low AND check = _check").select(F.col("_wanted").alias("set_id"), "body").dropDuplicates(["set_id"])


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for all nodes of the links (a, b)."""
    edges, n = cut_small(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    return _joined(edges) if n <= MAX_COLLECTED else _starred(edges)


def _joined(edges: DataFrame) -> DataFrame:
    """components() of links (u, v) on the driver."""
    above: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := above.setdefault(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above[x]
        return top

    rows = edges.toArrow()
    for u, v in zip(rows["u"].to_pylist(), rows["v"].to_pylist(), strict=True):
        low, high = sorted((find(u), find(v)))
        above[high] = low
    found = pa.table([pa.array(list(above), pa.int64()), pa.array([find(x) for x in list(above)], pa.int64())], names=["node", "root"])
    return edges.sparkSession.createDataFrame(found)


def _starred(edges: DataFrame) -> DataFrame:
    """components() of links (u, v), u > v, by alternating large and small stars."""
    mark = None
    while True:
        # large star: what is above a node goes to the least of its neighbours and itself
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: what is below a node, and itself, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        seen = Observation()
        edges = cut(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        now = (seen.get["n"], seen.get["h"])
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, set_id, n_shingles, component_id and kept for each row.

    kept: the row's id is its component's id. Words: what ASCII white space parts, A-Z in lower
    case. Rows of one id may have different texts, and so different sets and components.
    """
    if percent < 80:
        raise ValueError("the candidates are complete for a similarity of 80 percent or more")
    return _judged(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), words, percent).drop("low", "check").withColumnRenamed("_id", doc_id)


def _judged(base: DataFrame, words: int, percent: int) -> DataFrame:
    """_id, set_id, low and check (the set's digest), n_shingles, component_id, kept of rows (_id, _text)."""
    rows, _ = cut_small(sketched(base, "_text", words))
    sets = rows.filter("set_id IS NOT NULL").groupBy(F.col("set_id").alias("low"), "check").agg(F.min("_id").alias("least"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    # ids that are not unique are made from both halves of the digest
    twice = F.count("*").over(Window.partitionBy("low")) > 1
    sets, _ = cut_small(sets.withColumn("set_id", F.when(twice, F.xxhash64("low", "check")).otherwise(F.col("low"))))
    lists, _ = cut_small(_lists(sets))
    members, _ = cut_small(lists.groupBy("set_id").agg(F.sort_array(F.collect_list("value")).alias("values")).join(sets, "set_id"))
    texts = cut(_texts(base, members.select("set_id", "low", "check", "least"), words))
    # the leader of a list has most copies; a class is compared with the leader of most copies, its center
    copies = lists.join(members.select("set_id", "copies"), "set_id")
    leader = copies.groupBy("value").agg(F.max(F.struct("copies", F.col("set_id").alias("id"))).alias("leader"), F.count("*").alias("m")).filter("m > 1")
    centers, _ = cut_small(lists.join(leader, "value").groupBy("set_id").agg(F.max("leader").alias("leader")).select("set_id", F.col("leader.id").alias("center")))
    star = centers.filter("set_id <> center").select(F.col("center").alias("a"), F.col("set_id").alias("b"))
    star, _ = cut_small(_compared(star, texts, words, percent))
    links = star.filter("linked").select("a", "b")
    roots, _ = cut_small(components(links))
    more, n = cut_small(_others(star, lists, centers, members, roots, percent))
    if n:
        links = links.union(cut(_compared(more, texts, words, percent).filter("linked").select("a", "b")))
        roots, _ = cut_small(components(links))

    classes = sets.select("set_id", "low", "check", "least").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "root").select("set_id", "low", "check", "component_id")
    out = rows.select("_id", F.col("set_id").alias("low"), "check", "n_shingles").join(named, ["low", "check"], "left")
    out = out.select("_id", "set_id", "low", "check", "n_shingles", F.when(F.col("low").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows, all columns, whose id is their component's: one document of each group, with its repeated rows."""
    base = docs.select(packed(docs, docs.columns), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    judged, _ = cut_small(_judged(base.select("_id", "_text"), words, percent).select("_id", "low", "check", "kept"))
    gone = judged.filter("NOT kept").select(F.col("_id").alias("_gone"), "low", F.col("check").alias("_check")).distinct()
    if gone.count() <= MAX_BROADCAST:
        gone = F.broadcast(gone)
    # an id may stand on rows of several texts, so a row is known by its set too
    same = F.col("_id").eqNullSafe(F.col("_gone")) & F.col("set_id").eqNullSafe(F.col("low")) & F.col("check").eqNullSafe(F.col("_check"))
    return sketched(base, "_text", words).join(gone, same, "left_anti").select(*unpacked(docs.columns))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, words=4).drop("set_id")


def near_sql(docs: str, words: int) -> str:
    """Common table expressions ending in comp(doc_id, n, component_id) for DuckDB."""
    return f"""
    nw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
    sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), {words}) - 1], ' ') AS g
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), {words}) + 2)) AS i FROM nw WHERE len(w) > 0)),
    ns AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM inter JOIN ns x ON x.doc_id = a JOIN ns y ON y.doc_id = b WHERE 100 * s >= 80 * (x.n + y.n - s)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM ns UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    comp AS (SELECT d.doc_id, coalesce(ns.n, 0) AS n, coalesce(c.m, d.doc_id) AS component_id FROM {docs} d LEFT JOIN ns ON ns.doc_id = d.doc_id
             LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = d.doc_id)"""


SQL = {"op3_minhash_near_dedup": f"WITH RECURSIVE {near_sql('documents', 4)} SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM comp"}
QUERIES = {"op3_minhash_near_dedup": op3_minhash_near_dedup}
