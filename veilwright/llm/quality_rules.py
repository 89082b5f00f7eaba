"""Quality rules: base limits, then robust multivariate outliers per language and source.

The base limits look at a text alone. The verdict on what passes them is a distance: in each
group of language and source the location and the covariance of a vector of transformed
statistics are estimated by minimum covariance determinant. The estimate starts from medians and
quartile ranges, from the covariances of spatial signs and of squashed scores, and from small
subsets drawn by hash. A concentration step takes the mean and covariance of exactly the
`coverage` share of vectors nearest to the present estimate. After a step from each start the two
estimates of least determinant go on until no determinant falls any more (by one percent), and the lesser is
the group's. Equal texts of a group count once, so that copies of one text do not stand for it.

The covariance is scaled to what it would be of all vectors if these were normal, and is mixed
with the quartile ranges of the whole table at the weight of `P + 1` vectors (a minimum
regularized covariance determinant): that steadies small groups and vanishes with their size.
A variance is at least what the group's own counts leave uncertain, see noise(): a language without
capitals doesn't become a plane that one capital leaves. NUMERIC is added against rounding alone.

Rows whose squared Mahalanobis distance is over `cutoff` are rejected. Quantiles are taken from
counts of narrow bins, so that no group is gathered or sorted in one task; the bin at the edge
counts with the part of it that makes the share exact.

Everything is DataFrame expressions. Null texts count as empty; null languages and sources are
groups of their own; repeated rows are judged alike; ties lie in one bin and share its weight; very
long texts are taken whole; an empty table gives none. Columns named as results are replaced, any
other names are free.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from veilwright.llm._common import BLANK_CLASS, BLANKS, UPPER, cut, packed, strip_blanks, table, unpacked

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
COVERAGE = 0.75
#: Statistics in a vector, see stats().
P = 6
#: By which the covariance of the nearest 75 % falls short, for 6 statistics: 0.75 over the chi-square
#: distribution with 8 degrees of freedom at the 0.75 quantile of that with 6.
CONSISTENCY = 1.36
#: Of a million normal rows one is rejected: that quantile of chi-square with 6 degrees of freedom.
CUTOFF = 38.26
#: The whole table's quartile ranges count as so many vectors of a group.
PRIOR_ROWS = P + 1.0
NUMERIC = 1e-9
#: Subsets drawn by hash, and about how many vectors each has.
SUBSETS, SUBSET_ROWS = 4, 10 * P
BEST, MOST_STEPS = 2, 60
#: A fall of the determinant's logarithm below which an estimate has settled.
SETTLED = 1e-2
#: Bins of a distance in each doubling, and bins of a statistic in each unit.
BINS, FINE = 64, 256
SYMBOLS = "#*$%&|<>"
SIGNS = string.punctuation + string.digits


def _count(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def repeated_words(words: str, n: str) -> tuple[dict[str, Column], ...]:
    """Columns, to be added in this order, that count the words in windows of three found twice or more.

    A window is its hash with the low bits replaced by its place; sorting brings equal hashes
    together, and neighbours are compared word by word. The cost is that of sorting numbers.
    """
    w = F.col(words)
    at = lambda i, k: F.get(w, i + F.lit(k))
    coded = F.transform(
        F.sequence(F.lit(0), F.col(n).cast("int") - 3),
        lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)).bitwiseAND(F.bitwise_not(F.col("_mask"))).bitwiseOR(i.cast("long")),
    )
    s = F.col("_sorted")
    place = lambda j: F.get(s, j).bitwiseAND(F.col("_mask")).cast("int")
    same = lambda j: F.get(s, j).bitwiseXOR(F.get(s, j - 1)).bitwiseAND(F.bitwise_not(F.col("_mask"))) == 0
    equal = lambda j: (at(place(j), 0) == at(place(j - 1), 0)) & (at(place(j), 1) == at(place(j - 1), 1)) & (at(place(j), 2) == at(place(j - 1), 2))
    pairs = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda j: same(j) & equal(j))
    empty = F.array().cast("array<int>")
    starts = F.sort_array(F.array_distinct(F.flatten(F.transform(F.col("_pairs"), lambda j: F.array(place(j), place(j - 1))))))
    covered = F.aggregate(
        F.col("_starts"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    return (
        {"_mask": F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.col(n)))) - 1},
        {"_sorted": F.when(F.col(n) >= 4, F.sort_array(coded)).otherwise(F.array().cast("array<bigint>"))},
        {"_pairs": F.when(F.size(s) >= 2, pairs).otherwise(empty)},
        {"_starts": F.when(F.size("_pairs") > 0, starts).otherwise(empty)},
        {"n_repeat_words": F.when(F.size("_starts") > 0, covered).otherwise(F.lit(0).cast("long"))},
    )


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and _lines, _caps, _signs and _vocabulary for the statistics."""
    t = F.col("_text")
    bare = F.col("_bare")
    lines = F.filter(F.split(t, "\n"), lambda x: strip_blanks(x) != "")
    out = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("_bare", strip_blanks(t)).withColumn("_line", lines)
    out = out.withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_CLASS + "+")))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.translate(t, BLANKS, "")).cast("long"),
            "n_symbols": _count(t, SYMBOLS),
            "n_dup_lines": (F.size("_line") - F.size(F.array_distinct("_line"))).cast("long"),
            "_lines": F.size("_line").cast("long"),
            "_caps": _count(t, UPPER),
            "_signs": _count(t, SIGNS),
            "_vocabulary": F.size(F.array_distinct("_words")).cast("long"),
        }
    )
    for columns in repeated_words("_words", "n_words"):
        out = out.withColumns(columns)
    n = F.col("n_words")
    out = out.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n))
    return out.drop("_text", "_bare", "_line", "_words", "_mask", "_sorted", "_pairs", "_starts")


def stats() -> list[Column]:
    """The transformed statistics of a row with base_columns(); all vary between any two texts of different make."""
    part = lambda a, b: F.log((F.col(a) + 0.5) / (F.col(b) + 1.0))
    return [
        F.log1p(F.col("n_words").cast("double")),
        part("word_chars", "n_words"),
        part("_signs", "word_chars"),
        part("_caps", "word_chars"),
        part("n_words", "_lines"),
        part("_vocabulary", "n_words"),
    ]


def noise() -> list[Column]:
    """The variance that each statistic of a row has by the sampling of its count alone (of a logarithm, by the delta method)."""
    of = lambda k, n=None: 1.0 / (F.col(k) + 0.5) - (1.0 / (F.col(n) + 1.0) if n else 0.0)
    return [of("n_words"), of("word_chars"), of("_signs", "word_chars"), of("_caps", "word_chars"), of("_lines", "n_words"), of("_vocabulary", "n_words")]


GROUP, TEXT = ("_lang", "_source"), "_hash"
X = [f"_x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
MEANS = [f"m{i}" for i in range(P)]
#: Mean noise of a group, and a row's own.
NOISE, ROW_NOISE = [f"e{i}" for i in range(P)], [f"_e{i}" for i in range(P)]


def _join(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    groups = groups.withColumnsRenamed({g: f"{g}2" for g in GROUP})
    on = [F.col(g).eqNullSafe(F.col(f"{g}2")) for g in GROUP]
    return rows.join(groups, on[0] & on[1], how).drop(*(f"{g}2" for g in GROUP))


def _quartiles(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """n, and for each statistic its median m and its spread s by the quartiles, for each key."""
    long = rows.select(*keys, F.posexplode(F.array(*X)).alias("_k", "_v"))
    counts = long.groupBy(*keys, "_k", F.floor(F.col("_v") * FINE).cast("long").alias("_b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "_k")
    counts = counts.withColumn("_run", F.sum("n").over(w.orderBy("_b"))).withColumn("_all", F.sum("n").over(w))
    at = lambda i, share: F.min(F.when((F.col("_k") == i) & (F.col("_run") >= F.ceil(F.col("_all") * share)), F.col("_b"))) / F.lit(float(FINE))
    columns = [c for i in range(P) for c in (at(i, 0.5).alias(f"m{i}"), ((at(i, 0.75) - at(i, 0.25)) / 1.349).alias(f"s{i}"))]
    return counts.groupBy(*keys).agg(F.max("_all").alias("n"), *columns)


def _whiten(groups: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """keep, means, the inverse Cholesky factor of the covariance row by row as w, and logdet, its determinant's logarithm."""
    out = groups
    for j in range(P):
        rest = {i: F.col(f"c{i}_{j}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0)) for i in range(j, P)}
        out = out.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(rest.pop(j), F.lit(NUMERIC))))
        if rest:
            out = out.withColumns({f"l{i}_{j}": v / F.col(f"l{j}_{j}") for i, v in rest.items()})
    out = out.withColumns({f"w{i}_{i}": 1.0 / F.col(f"l{i}_{i}") for i in range(P)})
    for d in range(1, P):
        # entries d below the diagonal follow from those above them
        out = out.withColumns({f"w{i}_{i - d}": -sum((F.col(f"l{i}_{k}") * F.col(f"w{k}_{i - d}") for k in range(i - d, i)), F.lit(0.0)) / F.col(f"l{i}_{i}") for i in range(d, P)})
    logdet = sum((F.log(f"l{i}_{i}") for i in range(P)), F.lit(0.0)) * 2
    return out.select(*keep, *MEANS, *(f"w{i}_{j}" for i, j in PAIRS), logdet.alias("logdet"))


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(P):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"w{i}_{j}") * (F.col(X[j]) - F.col(f"m{j}"))
        total = total + part * part
    return total


def _mixed(i: int, j: int, cov: Column, n: Column, prior: list[float]) -> Column:
    """An entry of a covariance of n vectors, mixed with the whole table's spread; a variance is at least the noise."""
    own = cov * n / (n + PRIOR_ROWS)
    return F.greatest(own + F.lit(prior[i] ** 2 * PRIOR_ROWS) / (n + PRIOR_ROWS), F.col(NOISE[i])) + NUMERIC if i == j else own


def _starts(rows: DataFrame, quartiles: DataFrame, prior: list[float]) -> DataFrame:
    """The whitened first estimates of each group by _start: 0 axes, 1 signs, 2 squashed scores, then the subsets."""
    scale = [F.greatest(F.col(f"s{i}"), F.lit(prior[i] * 1e-3 + NUMERIC)) for i in range(P)]
    axes = quartiles.select(*GROUP, F.lit(0).alias("_start"), *NOISE, *MEANS, *(_mixed(i, j, scale[i] ** 2 if i == j else F.lit(0.0), F.col("n"), prior).alias(f"c{i}_{j}") for i, j in PAIRS))
    z = _join(rows, quartiles).withColumns({f"z{i}": (F.col(X[i]) - F.col(f"m{i}")) / scale[i] for i in range(P)})
    norm = F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(P)), F.lit(1e-18)))
    drawn = lambda k: F.pmod(F.xxhash64(F.lit(k), *X), F.lit(1 << 30)) < F.least(F.lit(1.0), SUBSET_ROWS / F.col("n")) * F.lit(float(1 << 30))
    vector = lambda start, values, on=F.lit(True): F.when(on, F.struct(F.lit(start).alias("_start"), *(v.cast("double").alias(f"y{i}") for i, v in enumerate(values))))
    zs = [F.col(f"z{i}") for i in range(P)]
    kinds = [vector(1, [x / norm * P**0.5 for x in zs]), vector(2, [F.tanh(x) for x in zs]), *(vector(3 + k, zs, drawn(k)) for k in range(SUBSETS))]
    each = z.select(*GROUP, F.explode(F.filter(F.array(*kinds), lambda v: v.isNotNull())).alias("v")).select(*GROUP, "v.*")
    made = each.groupBy(*GROUP, "_start").agg(F.count("*").alias("k"), *(F.avg(f"y{i}").alias(f"a{i}") for i in range(P)), *(F.covar_pop(f"y{i}", f"y{j}").alias(f"v{i}_{j}") for i, j in PAIRS))
    made = _join(made, quartiles)
    # signs and squashed scores tell the shape alone, around the medians
    means = [(F.col(f"m{i}") + F.when(F.col("_start") > 2, F.col(f"a{i}") * scale[i]).otherwise(0.0)).alias(f"m{i}") for i in range(P)]
    others = made.select(*GROUP, "_start", *NOISE, *means, *(_mixed(i, j, F.col(f"v{i}_{j}") * scale[i] * scale[j], F.col("k"), prior).alias(f"c{i}_{j}") for i, j in PAIRS))
    return _whiten(axes.unionByName(others), (*GROUP, "_start", *NOISE))


def _step(rows: DataFrame, estimates: DataFrame, coverage: float, prior: list[float]) -> DataFrame:
    """One concentration step of each estimate: mean and covariance of exactly the nearest share of its group's vectors."""
    keys = (*GROUP, "_start")
    near = _join(rows, estimates).withColumn("_b", F.floor(F.log2(_distance() + 1e-12) * BINS).cast("int"))
    counts = near.groupBy(*keys, "_b").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumn("_run", F.sum("n").over(w.orderBy("_b"))).withColumn("h", F.ceil(F.sum("n").over(w) * coverage))
    edge = counts.filter(F.col("_run") >= F.col("h")).groupBy(*keys).agg(F.min(F.struct("_b", "_run", "n", "h")).alias("e"))
    edge = edge.select(*GROUP, F.col("_start").alias("_at"), F.col("e._b").alias("_edge"), ((F.col("e.h") - F.col("e._run") + F.col("e.n")) / F.col("e.n")).alias("_part"), F.col("e.h").alias("h"))
    kept = _join(near, edge).filter((F.col("_start") == F.col("_at")) & (F.col("_b") <= F.col("_edge")))
    weight = F.when(F.col("_b") < F.col("_edge"), 1.0).otherwise(F.col("_part"))
    off = [F.col(X[i]) - F.col(f"m{i}") for i in range(P)]
    sums = [F.sum(weight * off[i]).alias(f"a{i}") for i in range(P)] + [F.sum(weight * off[i] * off[j]).alias(f"v{i}_{j}") for i, j in PAIRS]
    made = kept.groupBy(*keys).agg(F.max("h").alias("h"), *(F.max(m).alias(m) for m in (*MEANS, *NOISE)), *sums)
    h = F.col("h")
    cov = lambda i, j: CONSISTENCY * (F.col(f"v{i}_{j}") / h - F.col(f"a{i}") * F.col(f"a{j}") / (h * h))
    out = made.select(*keys, *NOISE, *((F.col(f"m{i}") + F.col(f"a{i}") / h).alias(f"m{i}") for i in range(P)), *(_mixed(i, j, cov(i, j), h, prior).alias(f"c{i}_{j}") for i, j in PAIRS))
    return _whiten(out, (*keys, *NOISE))


def estimates(rows: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The estimate of least determinant of each group (GROUP, X, ROW_NOISE and TEXT, which tells texts apart): means, whitening, logdet and _start, the start it came from."""
    rows = cut(rows.distinct().drop(TEXT))
    means = rows.groupBy(*GROUP).agg(*(F.avg(x).alias(e) for x, e in zip(ROW_NOISE, NOISE, strict=True)))
    whole = _quartiles(rows, ()).first()
    prior = [float(whole[f"s{i}"]) if whole and whole[f"s{i}"] is not None else 0.0 for i in range(P)]
    now = cut(_starts(rows, cut(_join(_quartiles(rows, GROUP), means)), prior))
    now = cut(_step(rows, now, coverage, prior))
    best = F.row_number().over(Window.partitionBy(*GROUP).orderBy("logdet", "_start"))
    now = cut(_step(rows, now.withColumn("_rank", best).filter(F.col("_rank") <= BEST).drop("_rank"), coverage, prior))
    for _ in range(MOST_STEPS):
        after = _step(rows, now, coverage, prior)
        fields = [*MEANS, *(f"w{i}_{j}" for i, j in PAIRS), "logdet", *NOISE]
        one = lambda frame, name: frame.select(*GROUP, F.col("_start").alias(f"_{name}"), F.struct(*fields).alias(name))
        both = _join(one(now, "old"), one(after, "new")).filter("_old = _new")
        fell = F.col("old.logdet") - F.col("new.logdet")
        seen = Observation()
        both = cut(both.select(*GROUP, F.col("_old").alias("_start"), F.when(fell > 0, F.col("new")).otherwise(F.col("old")).alias("won"), fell.alias("_fell")).observe(seen, F.max("_fell").alias("most")))
        now = both.select(*GROUP, "_start", "won.*")
        most = seen.get["most"]
        if most is None or most < SETTLED:
            break
    least = F.row_number().over(Window.partitionBy(*GROUP).orderBy("logdet", "_start"))
    return now.withColumn("_rank", least).filter("_rank = 1").drop("_rank", *NOISE)


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF, coverage: float = COVERAGE, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, if None) of each row with its base statistics, base_failed, distance and kept."""
    own = [c for c in (docs.columns if keep is None else keep) if c not in (*RESULTS, "distance", "kept")]
    based = base_columns(docs.select(packed(docs, own), F.col(text).alias("_t"), F.xxhash64(F.col(text)).alias(TEXT), F.col(lang).cast("string").alias("_lang"), F.col(source).cast("string").alias("_source")), "_t")
    rows = cut(based.drop("_t").select("_own", *RESULTS, *GROUP, TEXT, *(s.alias(x) for s, x in zip((*stats(), *noise()), (*X, *ROW_NOISE), strict=True))))
    found = cut(estimates(rows.filter(~F.col("base_failed")).select(*GROUP, TEXT, *X, *ROW_NOISE), coverage))
    judged = _join(rows.drop(TEXT, *ROW_NOISE), found, "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return judged.select(*unpacked(own), *RESULTS, "distance", (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, keep=["doc_id"]).drop("distance")


QUERIES = {"op4_quality_rules": op4_quality_rules}
SQL: dict[str, str] = {}
