"""Each query of the catalog that has SQL, against DuckDB on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from veilwright.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


def test_all_against_duckdb(spark):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    bad = []
    for name, sql in catalog.SQL.items():
        if rows_of(catalog.QUERIES[name](spark, FOLDER).toPandas()) != rows_of(con.execute(sql).df()):
            bad.append(name)
    assert bad == []


def test_every_detector_has_a_query():
    from veilwright.operators.detect import CATALOG

    assert {f"detector_{t.lower()}" for t in CATALOG} <= set(catalog.SQL)


def test_all_types_at_once_find_what_one_finds(spark):
    """With all types on, each made value is found as its own type or within one that ranks higher."""
    from veilwright.operators.detect import detect
    from veilwright.plans import made

    rank = {t: (d.confidence, d.rank) for t, d in catalog.CATALOG.items()}
    texts = None
    for kind, recipe in made.RECIPES.items():
        part = made.made_texts(spark, FOLDER, recipe).orderBy("o_orderkey").limit(60).withColumn("kind", F.lit(kind))
        one = made.found(part, [kind]).select("o_orderkey", F.struct("type", "start", "end", "confidence").alias("own"))
        part = part.join(one, "o_orderkey")
        texts = part if texts is None else texts.unionByName(part)
    lost = []
    for r in texts.repartition(8).withColumn("all", detect(F.col("text"))).collect():
        over = [d for d in r["all"] if d.start < r.own.end and d.end > r.own.start]
        if not any((d.type, d.start) == (r.own.type, r.own.start) or (d.confidence, rank[d.type][1]) >= (r.own.confidence, rank[r.own.type][1]) for d in over):
            lost.append((r.kind, r.text, over))
    assert lost == []
