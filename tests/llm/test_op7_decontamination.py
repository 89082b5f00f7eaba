"""Decontamination against plain Python; both ways give the same."""

import random
import re

from veilwright.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items):
    w, hit, ids = words(text), set(), set()
    for item, body in items:
        b = words(body)
        k = min(len(b), D.WINDOW)
        if not k or item is None:
            continue
        grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                ids.add(str(item))
    return len(w), len(hit), sorted(ids)


def data():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abÉ1", k=rng.randint(1, 2)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 9, 10, 11, 25])))) for i in range(14)]
    items += [(20, None), (21, "--- !"), (None, "aa bb"), (3, items[3][1]), (22, items[5][1].upper() + ".")]
    docs = [(1, None), (1, ""), (None, items[4][1]), (2, "... "), (2, "x " * 4000 + items[6][1])]
    for i in range(120):
        text = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(text))
            text[at:at] = words(rng.choice(items)[1])
        docs.append((10 + i, rng.choice([" ", ", ", "\n"]).join(text)))
    return docs + docs[7:9], items


def test_both_ways(spark):
    docs, items = data()
    frame = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(docs)], "doc_id long, text string, spans int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d or -1, *plain(t, items)) for d, t in docs)
    for most in (D.MAX_WINDOWS, 3):
        got = D.decontaminate(frame, bench, max_windows=most).collect()
        assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.item_ids) for r in got) == want
        assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_items_without_id(spark, tmp_path):
    """Passages of items without an id are hit; only the list of ids has nothing of them."""
    docs = spark.createDataFrame([(1, "so it is one two three four"), (2, "alpha beta one two"), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two"), (7, "alpha beta"), (None, "three"), (8, "three")], "item_id long, text string")
    for most in (D.MAX_WINDOWS, 1):
        got = D.decontaminate(docs, bench, max_windows=most, unnamed=True).orderBy("doc_id").collect()
        assert [(r.n_hit, r.item_ids, r.contaminated) for r in got] == [(3, ["8"], True), (4, ["7"], True), (0, [], False)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.filter("item_id IS NULL").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = D.op7_decontamination(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.n_hit, r.n_items, r.contaminated) for r in got] == [(3, 0, True), (2, 0, True), (0, 0, False)]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.decontaminate(docs.filter("false"), bench).count() == 0
    assert [(r.n_words, r.n_hit, r.item_ids) for r in D.decontaminate(docs, bench.filter("false")).collect()] == [(2, 0, [])]
    assert D.decontaminate(docs, bench).filter("contaminated").count() == 1


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = D.decontaminate(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_columns_and_a_full_bitmap(spark, monkeypatch):
    """Any names pass through; a bitmap that lets everything through changes nothing."""
    monkeypatch.setattr(D, "MAX_MAP", 1)
    names = ["_w", "_text", "_own", "_hits", "_places", "h", "gram", "items", "k"]
    rows = [(i, "one two three four five six seven eight nine ten eleven" if i % 3 else "clean words only", *(f"{n}{i}" for n in names)) for i in range(9)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    bench = spark.createDataFrame([(i, f"two three four five six seven eight nine ten eleven w{i}") for i in range(200)], "item_id long, text string")
    for most in (D.MAX_WINDOWS, 1):
        got = D.decontaminate(docs, bench, max_windows=most).collect()
        assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
        assert all(r.n_hit == (10 if r.doc_id % 3 else 0) and len(r.item_ids) == (200 if r.doc_id % 3 else 0) for r in got)


def test_larger_benchmark_against_hash_set(spark):
    """A benchmark of thousands of windows gives the same by the set and by the bitmap and the join."""
    rng = random.Random(9)
    items = [(i, " ".join(f"v{rng.randint(0, 400)}" for _ in range(60))) for i in range(120)]
    docs = [(i, " ".join(f"v{rng.randint(0, 400)}" for _ in range(200))) for i in range(60)]
    docs += [(100 + i, docs[i][1] + " " + " ".join(items[i][1].split()[5:30])) for i in range(40)] * 2
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    take = lambda most: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in D.decontaminate(frame, bench, max_windows=most).collect())
    assert take(D.MAX_WINDOWS) == take(100)
    assert sum(x[2] for x in take(100)) >= 80 * 25
