"""Line dedup against plain Python; tiny filters and both ways give the same."""

import random
import string
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from veilwright.llm import line_dedup as L

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def plain(docs):
    holders = defaultdict(list)
    for n, (i, t) in enumerate(docs):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= L.MIN_CHARS:
                holders[k].append(i)
    last = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= L.MIN_DOCS}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i if i is not None else -1, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def data():
    rng = random.Random(8)
    common = ["Ünder Creative Commons " + "x" * rng.randint(15, 60) + str(i) for i in range(8)] + ["short line"]
    docs = [(None, common[0]), (None, common[0]), (3, None), (3, ""), (4, "\n\n")]
    for i in range(150):
        lines = ["".join(rng.choices("ab cd", k=rng.randint(0, 70))) for _ in range(rng.randint(0, 6))]
        lines += [rng.choice(["", " ", "\t"]) + rng.choice([x, x.upper()]) + rng.choice(["", "\r"]) for x in rng.sample(common, rng.randint(0, 3)) for _ in range(rng.choice([1, 1, 2]))]
        rng.shuffle(lines)
        docs.append((10 + i, "\n".join(lines)))
    return docs


def test_all_ways(spark):
    docs = data()
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_lines string").repartition(5)
    want = plain(docs)
    for bits, shipped in ((None, L.MAX_SHIPPED), (L.SEGMENTS * 8, L.MAX_SHIPPED), (1 << 20, 2)):
        rows = L.dedup_lines(frame, bits=bits, max_shipped=shipped).collect()
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped, r.kept_text) for r in rows)
        assert got == want


def test_empty(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text(spark):
    line = "a line that stands in many documents, again and again"
    frame = spark.createDataFrame([(i, f"{line}\n" * 5000) for i in range(6)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_dropped) for r in L.dedup_lines(frame).collect()) == [(i, 5000 if i < 5 else 0) for i in range(6)]


def test_filters_grow_with_the_lines(spark):
    frame = spark.range(400_000).select(F.array_join(F.array_repeat(F.lit("x" * L.MIN_CHARS), 1), "").alias("t"))
    n = frame.count()
    assert L.filter_bits(frame, "t", L.MIN_CHARS) == 1 << (n * L.LINE_BITS - 1).bit_length()
    assert L.filter_bits(frame.limit(3), "t", L.MIN_CHARS) == L.filter_bits(frame.filter("false"), "t", L.MIN_CHARS) == L.LEAST_BITS


def test_bits_of_a_filter():
    rng = np.random.default_rng(1)
    packed, plain = np.zeros(128, np.uint8), np.zeros(1024, bool)
    for _ in range(20):
        at = rng.integers(0, 1024, (rng.integers(0, 30), L.PROBES))
        assert (L._hold(packed, at) == plain[at].all(axis=1)).all()
        L._set(packed, at)
        plain[at.ravel()] = True


def test_clashing_columns_and_repeated_ids(spark):
    """Names of any kind pass through in both ways, and rows of one id lose what their own texts hold."""
    line = "a line that stands in many documents, again and again"
    names = ["_id", "_text", "_same", "_own", "_lost", "id", "key", "same", "a.b"]
    rows = [(1 if i < 6 else i, f"{line}\n{i}", *(f"{n}{i}" for n in names)) for i in range(9)]
    frame = spark.createDataFrame(rows, ["doc_id", "text", *names])
    for shipped in (L.MAX_SHIPPED, 0):
        got = L.dedup_lines(frame, max_shipped=shipped).collect()
        assert sorted((r.kept_text, r.n_dropped) for r in got) == sorted((str(i), 1) if i < 8 else (f"{line}\n8", 0) for i in range(9))
        assert all(r[n] == f"{n}{r.kept_text[-1]}" for r in got for n in names)
