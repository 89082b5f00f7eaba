"""Near duplicates against brute force."""

import random

from veilwright.llm import near_dedup as N
from veilwright.llm._common import cut_small


def brute(rows, words, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(rng.choice([1, 3, 5, 9, 40, 70, 200]))] for _ in range(12)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6, 9])):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], [word()], [text[at], word()]])
            text = text or [word()]
        if rng.random() < 0.25:
            text = text[: rng.randint(0, 30)] + passage
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(text)))
    return rows


def test_against_brute_force(spark):
    rows = corpus(1) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "ONE"), (1004, "one"), (1005, "one two three")]
    for words in (4, 5):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(frame, words=words).collect()}
        assert [got[d] for d, _ in rows] == brute(rows, words)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (5, "other words stand here alone"), (None, text), (9, text + " more"), (None, None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, set_id string").repartition(3)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in N.near_duplicates(frame).collect())
    assert got == [(-1, 0, -1, True), (-1, 26, 5, False), (5, 1, 5, True), (5, 26, 5, True), (5, 26, 5, True), (9, 27, 5, False)]
    kept = N.drop_near_duplicates(frame.drop("set_id").withColumnRenamed("text", "t"), text="t").collect()
    assert sorted((r.doc_id or -1, (r.t or "")[:2]) for r in kept) == [(-1, ""), (5, "ot"), (5, "w0"), (5, "w0")]


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(frame).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.root for r in N.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_components_by_driver_and_executors(spark, monkeypatch):
    rng = random.Random(8)
    links = [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(230)] + [(2**62, -(2**63)), (2**62, 2**63 - 1), (5, 5)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    found = []
    for most in (1000, 0):
        monkeypatch.setattr(N, "MAX_COLLECTED", most)
        rows = N.components(frame).collect()
        found.append({r.node: r.root for r in rows})
        assert len(rows) == len(found[-1])
    assert found[0] == found[1] and len(set(found[0].values())) > 20
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert set(found[0]) == nodes and all(found[0][a] == found[0][b] <= min(a, b) for a, b in links if a != b)
    for most in (1000, 0):
        monkeypatch.setattr(N, "MAX_COLLECTED", most)
        assert N.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_few_rows_in_many_partitions(spark):
    """Few rows cost few tasks, however many partitions they are dealt over; no row is lost, and many rows keep their tasks."""
    few, n = cut_small(spark.range(500).repartition(64))
    assert n == 500 and few.rdd.getNumPartitions() <= 16 and sorted(r.id for r in few.collect()) == list(range(500))
    many, n = cut_small(spark.range(70_000).repartition(64))
    assert n == 70_000 and many.rdd.getNumPartitions() == 64 and many.distinct().count() == n
    none, n = cut_small(spark.range(0).repartition(64))
    assert n == 0 and none.count() == 0


def test_large_group_around_a_center(spark):
    """Many variants of one text with edits in common, near and beyond the threshold: no link is lost."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(80)]
    edits = [(rng.randrange(80), f"e{i}") for i in range(40)]
    rows = [(i, " ".join(base)) for i in range(5)]
    for i in range(5, 400):
        text = list(base)
        for at, word in rng.sample(edits, rng.choice([1, 2, 2, 3, 3, 4, 5])):
            text[at] = rng.choice([word, word, "", word + f"x{rng.randint(0, 3)}"])
        rows.append((i, " ".join(w for w in text if w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(frame).collect()}
    assert [got[d] for d, _ in rows] == brute(rows, 5)
    assert len({c for _, _, c in got.values()}) > 20


def test_clashing_columns(spark):
    names = ["_text", "_id", "_own", "set_id", "check", "low", "_gone", "sketch", "n_shingles", "a.b"]
    text = " ".join(f"w{i}" for i in range(30))
    frame = spark.createDataFrame([(i, text + (" more" if i == 1 else ""), *(f"{n}{i}" for n in names)) for i in range(3)] + [(9, "quite another", *names)], ["doc_id", "text", *names])
    got = N.drop_near_duplicates(frame).collect()
    assert sorted(r.doc_id for r in got) == [0, 9] and all(r[n] == (n if r.doc_id == 9 else f"{n}0") for r in got for n in names)


def test_very_long_texts(spark):
    rng = random.Random(3)
    words = [str(rng.randint(0, 5000)) for _ in range(60_000)]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-50])), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_duplicates(frame).collect()} == {1: 1, 2: 1, 3: 3}
