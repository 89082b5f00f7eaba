"""Queries of the detection engine by name, with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.functions import fixed as X
from veilwright.operators import anonymity, report, sanitize
from veilwright.operators.detect import CATALOG, CustomRule, catalog_frame, detect, detector_catalog
from veilwright.plans import made, numbers
from veilwright.sources.readers import cells, json_leaves

SIMPLE = ["EMAIL", "IPV4", "AWS_API_KEY", "GENERIC_API_KEY"]
SALT = "a salt for tests only"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- detections in documents ------------------------------------------------------------------

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
RE2 = {
    "EMAIL": (r"(?i)([A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,253}\.[A-Za-z]{2,})", 1),
    "IPV4": (rf"(?:^|[^0-9])({_OCTET}(?:\.{_OCTET}){{3}})(?:[^0-9]|$)", 1),
    "AWS_API_KEY": ("((?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16})", 1),
    "GENERIC_API_KEY": (r"(?i)(?:api[\-_]?key|secret|token|passwd|password|auth[\-_]?token)\s*[:=]\s*[''\x22]?([A-Za-z0-9_\-.~+/=]{16,})", 1),
}
HITS = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{t}' AS type, unnest(regexp_extract_all(text, '{p}', {g})) AS value FROM documents" for t, (p, g) in RE2.items())


def found_in_documents(spark: SparkSession, sf_dir: str, types: list[str] | None = None) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", detect(F.col("text"), types=types).alias("detections"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors over documents: count and frameworks by type."""
    counts = report.breakdown(found_in_documents(spark, sf_dir))
    known = catalog_frame(spark).select("type", "region", "severity", F.array_join("compliance", "+").alias("compliance"))
    return counts.join(F.broadcast(known), "type")


QUERIES["breakdown_all_types"] = flagship

#: SQL of what the nine types find that the invented documents hold, cards without separators; of the others none has a candidate in them.
_PHONE = r"[+]1 [(]([0-9]{3})[)] 555-[0-9]{4}"
_LICENSE = r"(?i)\b(?:driver\x27?s?(?:\s+licen[sc]e)?|licen[sc]e|dl)(?:\s*(?:no\.?|number|#))?\s*[:#\-]?\s*[\x27\x22]?([A-Za-z0-9][A-Za-z0-9\- ]{4,19})"
#: Of the ISO 3166-1 codes those that words in capitals of the documents hold at the fifth place.
_COUNTRIES = "AD AE AU BE BL CH DO EH ER ET GA GE GT HN IN IO IT LY ME NA NC NE PA RE RO RS SA SC SE SR TH TR US".split()
_BY_TYPE = f"""
    SELECT doc_id, type FROM ({HITS})
    UNION ALL SELECT doc_id, CASE WHEN area[1] = '5' THEN 'TR_PHONE' WHEN area[1] > '1' AND area[2:] <> '11' THEN 'US_PHONE' ELSE 'INTL_PHONE' END FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_PHONE}', 1)) AS area FROM documents)
    UNION ALL SELECT doc_id, 'CREDIT_CARD' FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^0-9]+')) AS v FROM documents) WHERE length(v) BETWEEN 13 AND 19 AND len(list_distinct(string_split(v, ''))) > 1 AND {numbers.luhn('v')}
    UNION ALL SELECT doc_id, 'SWIFT_BIC' FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Z0-9]+')) AS v FROM documents) WHERE regexp_full_match(v, '[A-Z]{{6}}[A-Z0-9]{{5}}') AND substr(v, 5, 2) IN ({', '.join(repr(c) for c in _COUNTRIES)})
    UNION ALL SELECT doc_id, 'DRIVERS_LICENSE' FROM (SELECT doc_id, regexp_replace(rtrim(v, ' ' || chr(39) || chr(34)), '( [^ 0-9]*)+$', '') AS v FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_LICENSE}', 1)) AS v FROM documents))
      WHERE regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND length(regexp_replace(v, '[ -]', '', 'g')) BETWEEN 5 AND 20"""
_KNOWN = ", ".join(f"('{t}', '{region}', CAST({severity} AS DOUBLE), '{f}')" for t, region, _, _, severity, f in X.DETECTORS)
SQL["breakdown_all_types"] = f"SELECT d.type, count(*) AS count, region, severity, compliance FROM ({_BY_TYPE}) AS f JOIN (VALUES {_KNOWN}) AS d(type, region, severity, compliance) ON d.type = f.type GROUP BY ALL"


@query("detect_values", f"SELECT doc_id, type, value, count(*) AS n FROM ({HITS}) GROUP BY ALL")
def _detect_values(spark, sf_dir):
    found = found_in_documents(spark, sf_dir, SIMPLE)
    return found.select("doc_id", F.explode("detections").alias("d")).groupBy("doc_id", "d.type", "d.value").agg(F.count("*").alias("n"))


@query("breakdown", f"SELECT type, count(*) AS count FROM ({HITS}) GROUP BY type")
def _breakdown(spark, sf_dir):
    return report.breakdown(found_in_documents(spark, sf_dir, SIMPLE))


_FRAMEWORKS = " UNION ALL ".join(f"SELECT '{f}' AS framework, {sum(f in CATALOG[t].compliance for t in SIMPLE)} AS k" for f in X.FRAMEWORKS)


@query("compliance_summary", f"SELECT framework, CAST(CASE WHEN k = 0 THEN 0 ELSE (SELECT count(*) FROM ({HITS})) END AS BIGINT) AS count FROM ({_FRAMEWORKS})")
def _compliance(spark, sf_dir):
    return report.compliance_summary(report.breakdown(found_in_documents(spark, sf_dir, SIMPLE)))


_SEVERITY = "CASE type " + " ".join(f"WHEN '{t}' THEN {CATALOG[t].severity}" for t in SIMPLE) + " END"


@query(
    "risk_score",
    f"""SELECT score, CASE WHEN score < 25 THEN 'LOW' WHEN score < 50 THEN 'MODERATE' WHEN score < 75 THEN 'HIGH' ELSE 'CRITICAL' END AS level
    FROM (SELECT CAST(least(100, round_even(sum({_SEVERITY}) / (SELECT count(*) FROM documents) * 20, 0)) AS INTEGER) AS score FROM ({HITS}))""",
)
def _risk(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return report.risk_score(report.breakdown(found_in_documents(spark, sf_dir, SIMPLE)), docs.count())


def _heat(label: str) -> str:
    return f"""WITH h AS (SELECT {label} AS label, count(*) AS n FROM ({HITS}) GROUP BY 1),
    a AS (SELECT d.label, coalesce(h.n, 0) AS count FROM (SELECT DISTINCT {label} AS label FROM documents) d LEFT JOIN h ON h.label = d.label)
    SELECT label, CAST(count AS BIGINT) AS count, CAST(CASE WHEN max(count) OVER () > 0 THEN round_even(100.0 * count / max(count) OVER (), 0) ELSE 0 END AS INTEGER) AS risk FROM a"""


@query("heatmap_source", _heat("source"))
def _heat_source(spark, sf_dir):
    return report.heatmap(found_in_documents(spark, sf_dir, SIMPLE), "source")


@query("heatmap_lang", _heat("lang"))
def _heat_lang(spark, sf_dir):
    return report.heatmap(found_in_documents(spark, sf_dir, SIMPLE), "lang")


_LINES = "SELECT doc_id, i AS line, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"
_EMAIL, _GROUP = RE2["EMAIL"]


@query(
    "heatmap_segments",
    f"""WITH s AS (SELECT ((line - 1) // 20) * 20 + 1 AS first, len(regexp_extract_all(text, '{_EMAIL}', {_GROUP})) AS n FROM ({_LINES})), g AS (SELECT first, sum(n) AS count FROM s GROUP BY first)
    SELECT 'Lines ' || first || '–' || (first + 19) AS label, CAST(count AS BIGINT) AS count, CAST(CASE WHEN max(count) OVER () > 0 THEN round_even(100.0 * count / max(count) OVER (), 0) ELSE 0 END AS INTEGER) AS risk FROM g""",
)
def _heat_segments(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "text"))
    lined = report.segments(docs.withColumn("line", F.col("n") + 1), size=20).withColumn("detections", detect(F.col("text"), types=["EMAIL"]))
    return report.heatmap(lined, "segment")


@query(
    "file_scores",
    f"""SELECT file, units, count, score, CASE WHEN score < 25 THEN 'LOW' WHEN score < 50 THEN 'MODERATE' WHEN score < 75 THEN 'HIGH' ELSE 'CRITICAL' END AS level
    FROM (SELECT u.file, units, coalesce(n, 0) AS count, CAST(least(100, round_even(coalesce(weight, 0) / units * 20, 0)) AS INTEGER) AS score
      FROM (SELECT source AS file, count(*) AS units FROM documents GROUP BY source) AS u LEFT JOIN (SELECT source AS file, count(*) AS n, sum({_SEVERITY}) AS weight FROM ({HITS}) GROUP BY source) AS h ON h.file = u.file)""",
)
def _file_scores(spark, sf_dir):
    return report.file_scores(found_in_documents(spark, sf_dir, SIMPLE), "source").withColumnRenamed("source", "file")


@query("preview", f"SELECT doc_id AS line, left(regexp_replace(text, '{_EMAIL}', '[REDACTED]', 'g'), 400) AS clean, left(text, 400) AS raw FROM documents WHERE regexp_matches(text, '{_EMAIL}') ORDER BY doc_id LIMIT 8")
def _preview(spark, sf_dir):
    found = found_in_documents(spark, sf_dir, ["EMAIL"])
    return report.preview(found, "text", "doc_id", sanitize.redact_text(F.col("text"), F.col("detections")), raw=True).drop("spans")


@query("compliance_of_types", "SELECT o_orderkey, kind, CASE kind WHEN 'EMAIL' THEN 'GDPR+CCPA' WHEN 'TR_VKN' THEN 'KVKK' WHEN 'US_MBI' THEN 'HIPAA' ELSE '' END AS frameworks FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'TR_VKN' WHEN 2 THEN 'US_MBI' ELSE 'OTHER' END AS kind FROM orders)")
def _compliance_of(spark, sf_dir):
    kind = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'TR_VKN' WHEN 2 THEN 'US_MBI' ELSE 'OTHER' END")
    tags = F.create_map(*(F.lit(x) for t in CATALOG for x in (t, "+".join(report.compliance_of(t)))))
    return read(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind")).withColumn("frameworks", F.coalesce(F.try_element_at(tags, F.col("kind")), F.lit("")))


@query("context_score", "SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.6 ELSE 0 END AS DOUBLE) AS score, o_orderkey % 4 <> 3 AS passes FROM orders")
def _context(spark, sf_dir):
    text = F.concat(F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'the imei and bank no ' WHEN 1 THEN 'Passport number ' WHEN 2 THEN 'my DL: ' ELSE 'only words here ' END"), F.lit("1234567"), F.lit(" " * 60 + "imei"))
    made = read(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")).withColumn("at", F.instr("t", "1234567") - 1)
    place = (F.col("t"), F.col("at"), F.col("at") + 7)
    return made.select("o_orderkey", report.context_score(*place).alias("score"), report.passes_context(*place).alias("passes"))


@query("custom_rule", "SELECT doc_id, unnest(regexp_extract_all(text, '(License, version [0-9])', 1)) AS value FROM documents")
def _custom(spark, sf_dir):
    rule = CustomRule("LICENSE_LINE", "License, version [0-9]", 0.8)
    found = detect(F.col("text"), types=[], rules=[rule])
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("d")).select("doc_id", "d.value")


@query("region_filter", f"SELECT type, count(*) AS count FROM ({HITS}) WHERE type IN ('EMAIL', 'IPV4') GROUP BY type")
def _region(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(detect(F.col("text"), "PL", ["EMAIL", "IPV4", "US_PHONE", "IBAN"]).alias("detections"))
    return report.breakdown(docs)


@query("detect_pages", f"SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_EMAIL}', 1)) AS v FROM pages) GROUP BY page_id")
def _pages(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.size(detect(F.col("html"), types=["EMAIL"])).cast("long").alias("n"))
    return pages.filter("n > 0")


# --- taking values out ------------------------------------------------------------------------


@query("redact_documents", f"SELECT doc_id, md5(regexp_replace(text, '{_EMAIL}', '[REDACTED]', 'g')) AS digest FROM documents")
def _redact(spark, sf_dir):
    found = found_in_documents(spark, sf_dir, ["EMAIL"])
    return found.select("doc_id", F.md5(sanitize.redact_text(F.col("text"), F.col("detections")).cast("binary")).alias("digest"))


_MAIL = "regexp_extract(value, '^([^@]*)@', 1)"
_DOMAIN = "regexp_extract(value, '@(.*)$', 1)"
_HOST = f"split_part({_DOMAIN}, '.', 1)"


@query(
    "mask_email",
    f"""SELECT value, CASE WHEN length({_MAIL}) > 2 THEN left({_MAIL}, 1) || repeat('*', length({_MAIL}) - 2) || right({_MAIL}, 1) ELSE repeat('*', length({_MAIL})) END || '@'
      || CASE WHEN length({_HOST}) <= 1 THEN repeat('*', length({_HOST})) ELSE left({_HOST}, 1) || repeat('*', length({_HOST}) - 1) END || substr({_DOMAIN}, length({_HOST}) + 1) AS masked
    FROM ({HITS}) WHERE type = 'EMAIL'""",
)
def _mask_email(spark, sf_dir):
    found = found_in_documents(spark, sf_dir, ["EMAIL"]).select(F.explode("detections").alias("d")).select("d.value")
    return found.withColumn("masked", sanitize.mask_value(F.col("value"), "EMAIL"))


@query("mask_ip", f"SELECT value, regexp_replace(value, '[.][0-9]+$', '.***') AS masked FROM ({HITS}) WHERE type = 'IPV4'")
def _mask_ip(spark, sf_dir):
    found = found_in_documents(spark, sf_dir, ["IPV4"]).select(F.explode("detections").alias("d")).select("d.value")
    return found.withColumn("masked", sanitize.mask_value(F.col("value"), "IPV4"))


_RAW = SALT.encode().ljust(64, b"\0")
_PAD = lambda x: "from_hex('" + bytes(b ^ x for b in _RAW).hex() + "')"
_HMAC = f"sha256({_PAD(0x5C)} || from_hex(sha256({_PAD(0x36)} || encode(c_name))))"


@query("hash_values", f"SELECT c_custkey, left({_HMAC}, 16) AS hashed FROM customer")
def _hash(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", sanitize.hash_value(F.col("c_name"), SALT).alias("hashed"))


@query("pseudonymize_values", f"SELECT c_custkey, 'USER_' || left({_HMAC}, 8) AS token FROM customer")
def _pseudonyms(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", sanitize.pseudonymize(F.col("c_name"), "EMAIL", SALT).alias("token"))


@query("pseudonym_map", f"SELECT value, type, CASE type WHEN 'EMAIL' THEN 'USER' WHEN 'IPV4' THEN 'IP' ELSE 'KEY' END || '_' || left({_HMAC.replace('c_name', 'value')}, 8) AS token FROM (SELECT value, min(type) AS type FROM ({HITS}) GROUP BY value)")
def _pseudonym_map(spark, sf_dir):
    return sanitize.pseudonym_map(found_in_documents(spark, sf_dir, SIMPLE), SALT)


@query("vault_tokens", f"SELECT c_custkey, 'ID_' || left({_HMAC}, 12) AS token FROM customer")
def _tokens(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", sanitize.vault_token(F.col("c_name"), "US_SSN", SALT).alias("token"))


@query("fpe_round_trip", "SELECT c_custkey, c_name AS back, true AS same_shape FROM customer")
def _fpe(spark, sf_dir):
    made = read(spark, sf_dir, "customer").withColumn("x", sanitize.fpe(F.col("c_name"), SALT, "PII"))
    shape = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    return made.select("c_custkey", sanitize.fpe(F.col("x"), SALT, "PII", decrypt=True).alias("back"), (shape(F.col("x")) == shape(F.col("c_name"))).alias("same_shape"))


@query(
    "laplace_noise",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice - 0.5 * (CASE WHEN u < 0 THEN -1 ELSE 1 END) * ln(greatest(1 - 2 * abs(u), 1e-12)), 4) AS noisy
    FROM (SELECT *, ((l_orderkey * 31 + l_linenumber) % 1000) / 1000.0 - 0.5 AS u FROM (SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem))""",
)
def _laplace(spark, sf_dir):
    u = ((F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 1000) / F.lit(1000.0) - 0.5
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(sanitize.laplace_noise(F.col("l_extendedprice"), 2.0, 1.0, u), 4).alias("noisy"))


# --- anonymity --------------------------------------------------------------------------------

QUASI = ["c_nationkey", "c_mktsegment"]


@query(
    "k_anonymity",
    "SELECT count(*) AS classes, min(n) AS min_class, CAST(coalesce(sum(n) FILTER (n < 12), 0) AS BIGINT) AS suppressed, coalesce(sum(n) FILTER (n < 12), 0) IN (0, sum(n)) AS satisfies_k FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)",
)
def _k(spark, sf_dir):
    return anonymity.k_anonymize(read(spark, sf_dir, "customer"), QUASI, k=12)[1]


@query("k_anonymous_records", "SELECT c_custkey FROM customer WHERE (c_nationkey, c_mktsegment) IN (SELECT (c_nationkey, c_mktsegment) FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) >= 12)")
def _k_rows(spark, sf_dir):
    return anonymity.k_anonymize(read(spark, sf_dir, "customer"), QUASI, k=12)[0].select("c_custkey")


@query("l_diversity", "SELECT CAST(c_nationkey AS VARCHAR) AS c_nationkey, count(DISTINCT floor(c_acctbal / 2000)) AS \"distinct\" FROM customer GROUP BY c_nationkey HAVING count(DISTINCT floor(c_acctbal / 2000)) < 7")
def _l(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 2000))
    return anonymity.l_diversity(rows, ["c_nationkey"], "band", 7)


@query(
    "t_closeness",
    """WITH c AS (SELECT c_nationkey AS g, c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1, 2), q AS (SELECT v, sum(n) / (SELECT sum(n) FROM c) AS q FROM c GROUP BY v),
    s AS (SELECT g, sum(n) AS size FROM c GROUP BY g),
    d AS (SELECT s.g, sum(abs(coalesce(c.n, 0) / s.size - q.q)) / 2 AS d FROM s CROSS JOIN q LEFT JOIN c ON c.g = s.g AND c.v = q.v GROUP BY s.g)
    SELECT round_even(max(d), 4) AS max_distance, max(d) <= 0.2 AS satisfies_t FROM d""",
)
def _t(spark, sf_dir):
    return anonymity.t_closeness(read(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", 0.2)


# --- sources ----------------------------------------------------------------------------------


@query("json_leaves", "SELECT 'k' AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS text, count(*) AS n FROM events GROUP BY 2")
def _json(spark, sf_dir):
    return json_leaves(read(spark, sf_dir, "events"), "props").groupBy("path", "text").agg(F.count("*").alias("n"))


@query("json_nested", "SELECT o_orderkey, 'a.b' AS path, 'x' || o_orderkey AS text FROM orders UNION ALL SELECT o_orderkey, 'l.k', CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT o_orderkey, 'l.m.n', 'deep' FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, 'no json ' || o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def _json_nested(spark, sf_dir):
    keys = read(spark, sf_dir, "orders").select("o_orderkey")
    text = F.format_string('{"a": {"b": "x%d"}, "l": ["no leaf", {"k": %d, "m": %s}], "t": true, "u": null}', "o_orderkey", "o_orderkey", F.expr("""CASE WHEN o_orderkey % 2 = 0 THEN '[[{"n": "deep"}]]' ELSE '[]' END"""))
    bad = keys.filter("o_orderkey % 5 = 0").select("o_orderkey", F.format_string("no json %d", "o_orderkey").alias("t"))
    return json_leaves(keys.select("o_orderkey", text.alias("t")).unionByName(bad), "t", ["o_orderkey"])


@query("table_cells", "SELECT 'c_name' AS \"column\", count(*) AS n FROM customer WHERE c_name <> '' UNION ALL SELECT 'c_mktsegment', count(*) FROM customer WHERE c_mktsegment <> '' UNION ALL SELECT 'c_custkey', count(*) FROM customer")
def _cells(spark, sf_dir):
    return cells(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")).filter("column IS NOT NULL").groupBy("column").agg(F.count("*").alias("n"))


_LISTED = ", ".join(f"('{t}', '{X.DESCRIPTIONS.get(t, t + ' (checksum-validated)')}', '{region}', '{f}', CAST({severity} AS DOUBLE), CAST({c if t in X.DESCRIPTIONS else X.LISTED_CONFIDENCE} AS DOUBLE))" for t, region, c, _, severity, f in X.DETECTORS)


@query("detector_catalog", f"SELECT * FROM (VALUES {_LISTED}) AS d(type, description, region, compliance, severity, confidence)")
def _catalog(spark, sf_dir):
    return detector_catalog(spark).withColumn("compliance", F.array_join("compliance", "+"))

QUERIES |= numbers.QUERIES | made.QUERIES
SQL |= numbers.SQL | made.SQL
