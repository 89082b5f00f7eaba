"""Quality rules: base counts against plain Python, the robust distance, edge cases."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veilwright.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:]))
    counts, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if counts[x] > 1:
            covered |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in text), again, len(covered), failed


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9)))
    rows = []
    for i in range(400):
        words = [word() for _ in range(rng.choice([5, 60, 200, 500]))]
        if i % 40 == 7:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(w + rng.choice(["", "", ".", "\n"]) for w in words), rng.choice(["en", "fr", None]), rng.choice(["a", "b"])))
    return rows


EDGES = [None, "", " \n\t", "a", "a b c a b c", "a b c d a b c", "x x x x x x", "l one\nl one\n\n l one\n", "é #*$%&|<> 😀", "\x0b\x0ca\x85b"]


def test_base_counts(spark):
    rng = random.Random(5)
    texts = EDGES + [" ".join(rng.choices("abcd", k=rng.randint(1, 90))) for _ in range(200)] + [r[1] for r in corpus()[:60]] + ["w " * 30000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.base_columns(frame).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t), t


def test_outliers(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string").repartition(4)
    got = {r.doc_id: r for r in Q.quality_rules(frame).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        sound = len(text.split()) >= 50
        assert got[i].base_failed == (not sound)
        assert got[i].kept == (sound and i % 40 != 7), (i, got[i].distance)


def test_large_groups_decide(spark):
    """In a large source without repetition and of one length, repeated lines and stubs are outliers."""
    rng = random.Random(8)
    line = lambda: " ".join("".join(rng.choices("abcdefghijkl", k=5)) for _ in range(10))
    texts = ["\n".join(line() for _ in range(40)) for _ in range(2000)]
    again = line()
    texts[0] = "\n".join([line() for _ in range(25)] + [again] * 15)
    texts[1] = "\n".join(line() for _ in range(5))
    frame = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id int, text string, lang string, source string").repartition(4)
    got = {r.doc_id: r for r in Q.quality_rules(frame, keep=["doc_id"]).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not got[0].kept and not got[1].kept
    assert sum(r.kept for r in got.values()) >= 1980


def brute(x, prior, rng, tries=300):
    """The regularized covariance of least determinant over many starts, in numpy."""
    n, p = x.shape
    h = int(np.ceil(Q.COVERAGE * n))
    best = None
    for _ in range(tries):
        near = x[rng.choice(n, p + 2, replace=False)]
        last = np.inf
        while True:
            c = np.cov(near.T, bias=True) * (Q.CONSISTENCY if len(near) == h else 1)
            cov = (len(near) * c + Q.PRIOR_ROWS * np.diag(np.square(prior))) / (len(near) + Q.PRIOR_ROWS) 
            np.fill_diagonal(cov, np.maximum(np.diag(cov), NOISE) + Q.NUMERIC)
            m, now = near.mean(0), np.linalg.slogdet(cov)[1]
            if len(near) == h:
                if now > last - 1e-10:
                    break
                last = now
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
            near = x[np.argsort(d, kind="stable")[:h]]
        if best is None or last < best[0]:
            best = (last, m, cov)
    return best


NOISE = [0.01, 0.0, 0.0, 0.0, 0.02, 0.0]
FIELDS = ", ".join(["_lang string", "_source string", *(f"{c} double" for c in (*Q.X, *Q.ROW_NOISE))])


def vectors():
    """Groups of correlated vectors, with outliers off the correlation, and a shifted lot in one of them."""
    rng = np.random.default_rng(4)
    out = {}
    for g, n in (("a", 60), ("b", 150), ("c", 300)):
        mix = rng.normal(0, 1, (Q.P, Q.P))
        x = rng.normal(0, 1, (n, Q.P)) @ mix + rng.normal(0, 5, Q.P)
        if g == "c":
            x[: n // 5] = rng.normal(0, 0.3, (n // 5, Q.P)) + 9
        x[-3:] = x[:-3].mean(0) + x.std(0) * rng.choice([-3.0, 3.0], (3, Q.P))
        out[g] = x
    return out


def test_estimates_against_numpy(spark):
    """The determinants and the verdicts are those of a brute-force search, and not those of medians and fixed spreads."""
    groups = vectors()
    frame = spark.createDataFrame([(g, None, *map(float, r), *NOISE) for g, x in groups.items() for r in x], FIELDS).withColumn(Q.TEXT, F.monotonically_increasing_id()).repartition(3)
    got = {r._lang: r for r in Q.estimates(frame).collect()}
    whole = Q._quartiles(frame, ()).first()
    prior = np.array([whole[f"s{i}"] for i in range(Q.P)])
    different = 0
    for g, x in groups.items():
        logdet, m, cov = brute(x, prior, np.random.default_rng(1))
        r, w = got[g], np.zeros((Q.P, Q.P))
        for i, j in Q.PAIRS:
            w[i, j] = r[f"w{i}_{j}"]
        assert abs(r.logdet - logdet) < 0.05, (g, r.logdet, logdet)
        ours = (((x - [r[f"m{i}"] for i in range(Q.P)]) @ w.T) ** 2).sum(1) <= Q.CUTOFF
        theirs = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m) <= Q.CUTOFF
        assert (ours == theirs).all() and not ours[-3:].all() and ours.mean() > 0.7, g
        plain = (((x - np.median(x, 0)) / prior) ** 2).sum(1) <= Q.CUTOFF
        different += (plain != ours).sum()
    assert different > 10


def test_step_is_exact_and_falls(spark):
    """From one estimate, a step gives the mean and covariance of exactly the nearest three quarters; no determinant rises."""
    x = vectors()["b"]
    frame = spark.createDataFrame([("g", "s", *map(float, r), *NOISE) for r in x], FIELDS)
    prior = [1.0] * Q.P
    quartiles = Q._quartiles(frame, Q.GROUP).withColumns({e: F.lit(v) for e, v in zip(Q.NOISE, NOISE)})
    start = Q.cut(Q._starts(frame, quartiles, prior))
    one = Q.cut(Q._step(frame, start, Q.COVERAGE, prior))
    two = {r._start: r.logdet for r in Q._step(frame, one, Q.COVERAGE, prior).collect()}
    first, after = {r._start: r for r in start.collect()}, {r._start: r for r in one.collect()}
    assert set(first) == set(after) == set(range(3 + Q.SUBSETS))
    h = int(np.ceil(len(x) * Q.COVERAGE))
    for k, p in first.items():
        w = np.zeros((Q.P, Q.P))
        for i, j in Q.PAIRS:
            w[i, j] = p[f"w{i}_{j}"]
        d = (((x - [p[f"m{i}"] for i in range(Q.P)]) @ w.T) ** 2).sum(1)
        bins = np.floor(np.log2(d + 1e-12) * Q.BINS)
        edge = np.sort(bins)[h - 1]
        weight = np.where(bins < edge, 1.0, np.where(bins == edge, (h - (bins < edge).sum()) / (bins == edge).sum(), 0.0))
        assert np.allclose(np.average(x, 0, weight), [after[k][f"m{i}"] for i in range(Q.P)])
        cov = (h * Q.CONSISTENCY * np.cov(x.T, bias=True, aweights=weight) + Q.PRIOR_ROWS * np.eye(Q.P)) / (h + Q.PRIOR_ROWS)
        np.fill_diagonal(cov, np.maximum(np.diag(cov), NOISE) + Q.NUMERIC)
        assert abs(np.linalg.slogdet(cov)[1] - after[k].logdet) < 1e-6
        assert two[k] <= after[k].logdet + 0.02


def test_edges(spark):
    frame = spark.createDataFrame([(1, t, None, None, 7) for t in EDGES] * 2, "doc_id int, text string, lang string, source string, kept int")
    got = Q.quality_rules(frame, keep=["doc_id"]).collect()
    assert len(got) == 2 * len(EDGES) and not any(r.kept for r in got)
    assert Q.quality_rules(frame.filter("false"), keep=["doc_id"]).count() == 0


def test_clashing_columns_and_copies(spark):
    """Columns of any name pass through; copies are judged alike and a group of one text stays."""
    own = ["_lang", "_source", "_t", "_own", "_x0", "_text", "a.b", "_words"]
    text = " ".join(f"word{i}," for i in range(80))
    rows = [(i, text, "en", "s", *(f"{c}{i}" for c in own)) for i in range(30)]
    frame = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *own])
    got = Q.quality_rules(frame).collect()
    assert len(got) == 30 and all(r.kept for r in got)
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in own)
    assert set(frame.columns) < set(Q.quality_rules(frame).columns)


def test_plan_is_native(spark):
    frame = spark.createDataFrame([(1, "x", "en", "a")], "doc_id int, text string, lang string, source string")
    plan = Q.base_columns(frame).select(F.col("n_words"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
