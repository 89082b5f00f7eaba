"""Sharding: the law holds, equal texts stay together, slots have no gaps."""

import zlib
from collections import Counter, defaultdict

from veilwright.llm import sharding as S


def check(rows, shards=S.SHARDS):
    counts = Counter(r["shard"] for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert {r["law"] for r in rows} <= {"rows"} and all(r["grown_shard"] is None for r in rows)


def test_groups(spark):
    texts = [(i, f"text {i}") for i in range(900)] + [(1000 + i, f"twice {i // 2}") for i in range(200)] + [(2000 + i, "hot") for i in range(500)] + [(3000, None), (3001, ""), (None, "x"), (5, "text 5")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = [r.asDict() for r in S.balanced_shards(frame).collect()]
    check(rows)
    by_text = defaultdict(list)
    lookup = dict(texts)
    for r in rows:
        t = lookup[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 8 and r["text_crc32"] == zlib.crc32(t.encode())
        by_text[t].append(r["shard"])
    together = sum(len(set(v)) == 1 for k, v in by_text.items() if k.startswith("twice"))
    assert together >= 95
    # a group of over a shard's quota fills few shards
    assert len(set(by_text["hot"])) <= 500 // (len(texts) // 24) + 5


def test_small_and_empty(spark):
    schema = "doc_id long, text string"
    assert S.balanced_shards(spark.createDataFrame([], schema)).count() == 0
    rows = [r.asDict() for r in S.balanced_shards(spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], schema)).collect()]
    check(rows)


def test_same_again(spark):
    frame = spark.createDataFrame([(i, f"t{i % 70}") for i in range(300)], "doc_id long, text string")
    one = {(r.doc_id, r.shard, r.slot) for r in S.balanced_shards(frame.repartition(2)).collect()}
    two = {(r.doc_id, r.shard, r.slot) for r in S.balanced_shards(frame.repartition(7)).collect()}
    assert one == two


def test_propagation_keeps_links(spark):
    """Cut links with and without rounds: a group of equal texts in k shards cuts k - 1 links of its star."""
    frame = spark.createDataFrame([(i, f"text {i // 3}") for i in range(600)] + [(1000 + i, f"one {i}") for i in range(600)], "doc_id long, text string").repartition(4)

    def cut_links(rounds):
        held = defaultdict(set)
        for r in S.balanced_shards(frame, rounds=rounds).collect():
            if r.linked:
                held[r.text_crc32].add(r.shard)
        return sum(len(v) - 1 for v in held.values())

    assert cut_links(0) > 300 and cut_links(S.ROUNDS) <= 10


def test_clashing_columns_and_long_texts(spark):
    frame = spark.createDataFrame([(i, "x" * (100_000 if i else 1), "a", "b", "c") for i in range(50)] + [(None, f"n{i}", "a", "b", "c") for i in range(50)], ["doc_id", "text", "id", "g", "shard"])
    rows = [r.asDict() for r in S.balanced_shards(frame).collect()]
    check(rows)
    assert {r["size"] for r in rows if r["doc_id"]} == {100_008}
