"""k-anonymity, l-diversity and t-closeness of records, by the classes of their quasi-identifiers.

A class is the tuple of the quasi columns as text, null being the text None. Generalisations are
functions of columns. All are aggregates by class with partial sums; what crosses classes with
values is of the size of the classes, joined by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(records: DataFrame, quasi: list[str], hierarchies: dict[str, Callable[[Column], Column]]) -> DataFrame:
    changed = {q: hierarchies[q](F.col(q)) for q in quasi if q in hierarchies}
    return records.withColumns(changed) if changed else records


def _class(quasi: list[str]) -> list[Column]:
    return [F.coalesce(F.col(q).cast("string"), F.lit("None")).alias(f"_q{i}") for i, q in enumerate(quasi)]


def k_anonymize(records: DataFrame, quasi: list[str], k: int = 5, hierarchies: dict[str, Callable[[Column], Column]] | None = None, suppress: bool = True) -> tuple[DataFrame, DataFrame]:
    """The records after generalisation, without classes of under k rows if suppress; and one row: classes, min_class, suppressed, satisfies_k.

    classes and min_class are of before the suppression.
    """
    made = _keys(records, quasi, hierarchies or {})
    names = [f"_q{i}" for i in range(len(quasi))]
    sizes = made.groupBy(*_class(quasi)).agg(F.count("*").alias("_n"))
    small = F.col("_n") < k
    summary = sizes.agg(
        F.count("*").alias("classes"),
        F.coalesce(F.min("_n"), F.lit(0)).alias("min_class"),
        F.coalesce(F.sum(F.when(small, F.col("_n"))), F.lit(0)).alias("_small"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"),
    )
    gone = F.col("_small") if suppress else F.lit(0).cast("long")
    summary = summary.select("classes", "min_class", gone.alias("suppressed"), ((F.col("_small") == 0) | (gone == F.col("_all"))).alias("satisfies_k"))
    if not suppress:
        return made, summary
    keyed = made.withColumns({n: c for n, c in zip(names, _class(quasi), strict=True)})
    return keyed.join(sizes.filter(~small).select(*names), names, "left_semi").drop(*names), summary


def l_diversity(records: DataFrame, quasi: list[str], sensitive: str, level: int = 2) -> DataFrame:
    """The classes with fewer than `level` different sensitive values: the quasi columns and distinct."""
    value = F.coalesce(F.col(sensitive).cast("string"), F.lit("None"))
    counts = records.select(*_class(quasi), value.alias("_v")).distinct().groupBy(*(f"_q{i}" for i in range(len(quasi)))).agg(F.count("*").alias("distinct"))
    return counts.filter(F.col("distinct") < level).select(*(F.col(f"_q{i}").alias(q) for i, q in enumerate(quasi)), "distinct")


def t_closeness(records: DataFrame, quasi: list[str], sensitive: str, t: float = 0.2) -> DataFrame:
    """One row: max_distance (four decimals) and satisfies_t: the greatest total variation between a class and all records.

    The distance of a class is half of the sum over its own values of |p - q|, and the q of values
    that it lacks; the latter is 1 less the q of its own, so that no cross of classes and values is made.
    """
    names = [f"_q{i}" for i in range(len(quasi))]
    value = F.coalesce(F.col(sensitive).cast("string"), F.lit("None"))
    cells = records.select(*_class(quasi), value.alias("_v")).groupBy(*names, "_v").agg(F.count("*").alias("_n"))
    total = cells.agg(F.sum("_n").alias("_all"))
    overall = cells.groupBy("_v").agg(F.sum("_n").alias("_m")).join(F.broadcast(total)).select("_v", (F.col("_m") / F.col("_all")).alias("_q"))
    sizes = cells.groupBy(*names).agg(F.sum("_n").alias("_size"))
    near = cells.join(sizes, names).join(overall, "_v").groupBy(*names).agg((F.sum(F.abs(F.col("_n") / F.col("_size") - F.col("_q"))) + 1 - F.sum("_q")).alias("_d"))
    worst = near.agg((F.coalesce(F.max("_d"), F.lit(0.0)) / 2).alias("d"))
    return worst.select(F.bround("d", 4).alias("max_distance"), (F.col("d") <= t).alias("satisfies_t"))
