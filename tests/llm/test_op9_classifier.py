"""The classifier: held-out accuracy, what it is blind to, edge cases."""

import random
import zlib

import numpy as np

from veilwright.llm import quality_classifier as C


def corpus(n=500):
    rng = random.Random(9)
    good = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = rng.choices(good, k=rng.randint(20, 120))
        docs.append((i, " ".join(w + (rng.choice(["***", "$$$"]) if bad else "") for w in words)))
        labels.append((i, int(not bad)))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus()
    got = C.score_quality(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    truth = dict(labels)
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in docs}
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= C.THRESHOLD) for r in got)


def test_held_out_labels_are_unused(spark):
    docs, labels = corpus(200)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    one = {r.doc_id: r.score for r in C.score_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    two = {r.doc_id: r.score for r in C.score_quality(frame, spark.createDataFrame(flipped, "doc_id long, quality int")).collect()}
    assert one == two


def test_context_vectors(spark):
    texts = ["a b c", "b a", None, "", "x"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    got = C.word_vectors(frame, "text")
    hashes = C.Hasher()
    sums = np.zeros((C.BUCKETS, C.DIMENSIONS))

    def index(h):
        v = np.zeros(C.DIMENSIONS)
        for k in range(C.NONZERO):
            part = int(h) >> (20 + 12 * k)
            half = C.DIMENSIONS // C.NONZERO
            v[part % half + k * half] += 1 if (part >> 8) & 1 else -1
        return v

    for t in texts:
        h = hashes(t)
        for i in range(len(h)):
            for j in (i - 1, i + 1):
                if 0 <= j < len(h):
                    sums[int(h[i]) % C.BUCKETS] += index(h[j])
    want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, want, atol=1e-6)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (1, "", "s"), (None, "a b", "s"), (2, "w " * 50000, "s"), (2, "w " * 50000, "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = C.score_quality(docs, none, keep=["doc_id"]).collect()
    assert [r.score for r in got] == [0.5] * 5
    some = spark.createDataFrame([(1, 1), (1, None), (None, 1), (99, 0), (3, 1)], "doc_id long, quality int")
    assert len(C.score_quality(docs, some, keep=["doc_id"]).collect()) == 5
    assert C.score_quality(docs.filter("false"), none).count() == 0


def test_clashing_columns_and_repeated_ids(spark):
    """Any names pass through; of a labelled id with several texts always the same one is learned from."""
    docs, labels = corpus(120)
    names = ["_id", "_text", "_own", "vector", "a.b", "_y"]
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in docs] + [(i, t + " again", *(f"{n}{i}" for n in names)) for i, t in docs[:40]]
    frame, marks = spark.createDataFrame(rows, ["doc_id", "text", *names]), spark.createDataFrame(labels, "doc_id long, quality int")
    got = C.score_quality(frame.repartition(5), marks).collect()
    again = C.score_quality(frame.repartition(3), marks).collect()
    assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    assert sorted((r.doc_id, r.text, r.score) for r in got) == sorted((r.doc_id, r.text, r.score) for r in again)
