"""Keys in quotes: each leaves the places of all that follows as they are."""

import pytest
from pyspark.sql import functions as F

from veilwright.operators import detect as D
from veilwright.operators import sanitize as S
from veilwright.plans import catalog

KEY = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"


@pytest.mark.parametrize("kind, label, value", [("GENERIC_API_KEY", "token = ", KEY), ("IMEI", "imei: ", "490154203237518"), ("DRIVERS_LICENSE", "license: ", "D1234567"), ("HEALTH_INSURANCE_ID", "member id: ", "W123456789")])
def test_places_after_quotes(spark, kind, label, value):
    text = "\n".join(f"{label}{q}{value}{q}," for q in ("'", '"', "", '"'))
    row = spark.createDataFrame([(text,)], "t string").select(D.detect(F.col("t"), types=[kind]).alias("d"), S.redact_text(F.col("t"), D.detect(F.col("t"), types=[kind])).alias("clean")).first()
    assert [(d.value, text[d.start : d.end]) for d in row.d] == [(value, value)] * 4
    assert row.clean == text.replace(value, "[REDACTED]")


@pytest.mark.parametrize("name", ["detect_values", "breakdown", "compliance_summary", "file_scores", "heatmap_lang", "heatmap_source", "breakdown_all_types"])
def test_queries_with_many_quoted_keys(spark, tmp_path, name):
    """The keys' places moved by one a quote, until they overlapped the address before, which ranks higher."""
    import duckdb

    text = f'from 10.1.2.3: token = "{KEY}"\n' * 20
    rows = [(1, text, "en", "a"), (2, f'token = "{KEY}"', "de", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.execute(catalog.SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).select(columns).collect())) == sorted(expected.fetchall())
