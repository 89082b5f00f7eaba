"""Finding typed values in text columns.

detect() gives, for each text, an array of detections: candidates by pattern, kept if their check
passes, and of overlapping ones the best: by confidence, rank, length, place and scan order.
Places are code points, the end is exclusive. Detectors that share a pattern share its search,
and each search is behind a cheap condition that every match fulfils.

Digits and letters in patterns are ASCII, except that letters of case-blind patterns also match
the four characters whose other case is an ASCII letter. Null and empty texts have no detections.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as PF

from veilwright.functions import fixed as X
from veilwright.functions import sqltext as F
from veilwright.functions import validators as V
from veilwright.functions.columns import let, only_digits
from veilwright.functions.sqltext import Sql, apply, lambda_text, parsed

OPEN, SHUT, SAFE = "\x01", "\x02", ""
SPAN = "struct<start:int,value:string,before:string,after:string>"
RANKED = "struct<type:string,value:string,start:int,end:int,confidence:double,rank:int,ordinal:int>"
DETECTION = "struct<type:string,value:string,start:int,end:int,confidence:double>"
BARE_SPAN = "struct<start:int,value:string>"
CONTEXT = 64
#: Types whose checks look at what stands around a match.
_IN_CONTEXT = frozenset(["TR_PHONE", "SWIFT_BIC"])


@dataclass(frozen=True)
class CustomRule:
    """A pattern of the user's own, in Java's dialect."""

    id: str
    pattern: str
    confidence: float = 0.9
    region: str = "GLOBAL"
    compliance: tuple[str, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class Detector:
    type: str
    region: str
    confidence: float
    rank: int
    severity: float
    compliance: tuple[str, ...] = field(default=())


CATALOG = {t: Detector(t, r, c, p, s, tuple(f.split("+"))) for t, r, c, p, s, f in X.DETECTORS}
ORDINALS = {t: i for i, t in enumerate(CATALOG)}


def normalize_regions(regions: str | Collection[str]) -> frozenset[str]:
    """The named regions in upper case; an error for none or an unknown one."""
    names = regions.split(",") if isinstance(regions, str) else regions
    found = frozenset(n for n in (str(x).strip().upper() for x in names) if n or not isinstance(regions, str))
    if not found:
        raise ValueError(f"no region given; there are {', '.join(X.REGIONS)}")
    if unknown := sorted(found - {*X.REGIONS}):
        raise ValueError(f"unknown regions {', '.join(unknown)}; there are {', '.join(X.REGIONS)}")
    return found


def types_of(regions: str | Collection[str] = "ALL") -> list[str]:
    """The types that a selection of regions enables, in scan order."""
    chosen = normalize_regions(regions)
    return [t for t, d in CATALOG.items() if "ALL" in chosen or d.region in chosen or d.region == "GLOBAL"]


#: A condition that each match of a type fulfils, and that is cheap to test; types of one gate are tested together.
#: A tuple has strings of which the text must hold one; ~ stands for the text in lower case.
_RUN = {n: rf"[0-9]{{{n}}}" for n in (4, 6, 7, 8, 9, 10, 11, 12, 13, 15)}
GATES = {
    "AWS_API_KEY": ("AKIA", "ASIA", "ABIA", "ACCA"), "JWT": ("eyJ",), "EMAIL": ("@",), "IPV4": r"[0-9]\.[0-9]{1,3}\.[0-9]", "IPV6": ":[0-9A-Fa-f]{0,4}:", "TR_PHONE": r"5[0-9]{2}[\s\-()]*[0-9]{3}[\s\-()]*[0-9]{2}", "US_PHONE": r"[2-9][0-9]{2}[\s.\-)]*[2-9][0-9]{2}[\s.\-]*[0-9]{4}",
    "INTL_PHONE": r"\+[0-9]", "GITHUB_TOKEN": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), "SLACK_WEBHOOK": ("hooks.slack.com", "xox"), "STRIPE_KEY": ("_live_", "_test_"), "OPENAI_KEY": ("sk-",), "GOOGLE_API_KEY": ("AIza",), "AZURE_KEY": ("AccountKey=",), "DATABASE_URL": ("://",),
    "PRIVATE_KEY": ("-----BEGIN",), "MAC_ADDRESS": "[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]", "TELEGRAM_TOKEN": "[0-9]{8}:", "ANTHROPIC_KEY": ("sk-",), "HF_TOKEN": ("hf_",), "GITLAB_TOKEN": ("glpat-",), "NPM_TOKEN": ("npm_",), "PYPI_TOKEN": ("pypi-",), "TWILIO_KEY": "[0-9a-fA-F]{32}",
    "SENDGRID_KEY": ("SG.",), "DISCORD_WEBHOOK": ("webhooks/",), "IN_IFSC": "[A-Z]{4}0", "TR_NATIONAL_ID": _RUN[11], "CREDIT_CARD": r"(?:[0-9][\s\-]?){13}", "GENERIC_API_KEY": r"[:=]\s*['\"]?[A-Za-z0-9_\-.~+/=]{16}", "PL_PESEL": _RUN[11], "US_SSN": r"[0-9][- ][0-9]{2}[- ][0-9]",
    "ES_NIF": _RUN[8], "ES_NIE": _RUN[7], "GB_NINO": r"[A-Za-z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-Da-d]", "FR_NIR": r"[12](?:[0-9A-Za-zıſİK] ?){14}", "IT_FISCAL": r"[0-9]{2}.[0-9]{2}.[0-9]{3}", "BR_CPF": r"[0-9]{3}[.\-]?[0-9]{3}[.\-]?[0-9]{3}", "DE_IDNR": _RUN[11], "NL_BSN": _RUN[9],
    "BE_NATIONAL_ID": r"[0-9]{2}[.\- ]?[0-9]{2}[.\- ]?[0-9]{2}[.\- ]?[0-9]{3}", "FI_HETU": r"[0-9]{6}[+\-Aa][0-9]{3}", "SE_PERSONNUMMER": r"[0-9]{6}[-+]?[0-9]{4}", "NO_FODSELSNUMMER": _RUN[11], "PT_NIF": _RUN[9], "RO_CNP": _RUN[13], "GR_AFM": _RUN[9], "US_ABA": _RUN[9],
    "US_ITIN": r"[0-9][- ][0-9]{2}[- ][0-9]", "ISIN": "[A-Z]{2}[A-Z0-9]{9}[0-9]", "SEDOL": "[0-9]", "AU_ABN": _RUN[11], "CN_ID": "[0-9]{17}", "KR_RRN": _RUN[13], "SG_NRIC": _RUN[7], "IL_ID": _RUN[8], "ZA_ID": _RUN[13], "TH_ID": _RUN[13], "TW_ID": _RUN[9], "HK_ID": _RUN[6], "JP_MY_NUMBER": _RUN[12],
    "IMEI": _RUN[15], "VIN": r"[A-HJ-NPR-Za-hj-npr-zıſİK0-9]{17}", "US_DEA": _RUN[7], "US_MBI": "[0-9][A-Za-z]", "BTC_ADDRESS": r"[A-Za-z0-9ıſİK]{14}", "ETH_ADDRESS": "0x[0-9a-fA-F]{40}", "TR_VKN": _RUN[10], "DE_TAX_ID": r"[0-9]{2}[/.\- ][0-9]{2,4}[/.\- ][0-9]{2}",
    "IN_PAN": _RUN[4], "AU_TFN": r"[0-9]{3} ?[0-9]{3} ?[0-9]{3}", "CA_SIN": r"[0-9]{3}[- ]?[0-9]{3}[- ]?[0-9]{3}", "IN_AADHAAR": r"[0-9]{4} ?[0-9]{4} ?[0-9]{4}", "US_NPI": _RUN[10], "COORDINATES": r"[0-9]\.[0-9]+\s*[,;]", "SWIFT_BIC": "[A-Z]{6}[A-Z0-9]{2}", "PASSPORT": "[A-Z0-9<]{44}",
    "DRIVERS_LICENSE": ("~driver", "~licen", "~dl"), "HEALTH_INSURANCE_ID": ("~member", "~policy", "~subscriber", "~patient", "~medica", "~health", "~insurance", "~group", "~rx"), "IBAN": r"[A-Za-zıſİK]{2}[0-9]{2} ?[A-Za-z0-9ıſİK]{4}",
}
DIGITS = "[0-9]"
#: Types whose patterns all have a digit, tested once for the text before anything else.
_NEED_DIGIT = frozenset(t for t, d in CATALOG.items() if t not in {"JWT", "EMAIL", "IPV6", "SLACK_WEBHOOK", "STRIPE_KEY", "OPENAI_KEY", "AZURE_KEY", "DATABASE_URL", "PRIVATE_KEY", "MAC_ADDRESS", "ANTHROPIC_KEY", "HF_TOKEN", "GITLAB_TOKEN", "NPM_TOKEN", "PYPI_TOKEN", "TWILIO_KEY", "SENDGRID_KEY", "GOOGLE_API_KEY", "GITHUB_TOKEN", "AWS_API_KEY", "GENERIC_API_KEY", "SWIFT_BIC", "PASSPORT", "DRIVERS_LICENSE", "HEALTH_INSURANCE_ID", "VIN", "DISCORD_WEBHOOK"})


#: What the patterns of the detectors with digits in separated groups need in common.
SIX_DIGITS = r"[0-9](?:[ .\-/()+\s]*+[0-9]){5}"
_NEED_SIX = frozenset(
    "TR_PHONE US_PHONE INTL_PHONE TR_NATIONAL_ID CREDIT_CARD PL_PESEL US_SSN ES_NIF ES_NIE GB_NINO BR_CPF DE_IDNR NL_BSN BE_NATIONAL_ID FI_HETU SE_PERSONNUMMER NO_FODSELSNUMMER PT_NIF RO_CNP GR_AFM US_ABA US_ITIN AU_ABN CN_ID KR_RRN SG_NRIC IL_ID ZA_ID TH_ID TW_ID HK_ID JP_MY_NUMBER IMEI US_DEA TR_VKN DE_TAX_ID AU_TFN CA_SIN IN_AADHAAR US_NPI TELEGRAM_TOKEN".split()
)


def _passes(t: Sql, low: Sql, gate) -> Sql:
    if isinstance(gate, str):
        return F.rlike(t, F.lit(gate))
    found = None
    for g in gate:
        has = F.contains(low, F.lit(g[1:])) if g[0] == "~" else F.contains(t, F.lit(g))
        found = has if found is None else found | has
    return found


def spans(text: Column, pattern: str, grouped: bool = False) -> Column:
    """All matches of a pattern, as array of struct(start, value, before, after).

    grouped: the value is the second group, after the first. Marks are put around the values and
    the text is split at them: odd parts are values, and the lengths before them their places.
    """
    return apply(lambda t: let(_parts(t, pattern, grouped), lambda parts: _spans(parts, _no_spans(True), True)), text)


def _parts(text: Sql, pattern: str, grouped: bool) -> Sql:
    return F.split(F.regexp_replace(text, pattern, f"$1{OPEN}$2{SHUT}" if grouped else f"{OPEN}$0{SHUT}"), f"[{OPEN}{SHUT}]")


def _no_spans(context: bool) -> Sql:
    return F.array().cast(f"array<{SPAN if context else BARE_SPAN}>")


def _spans(parts: Sql, none: Sql, context: bool) -> Sql:
    """The spans of a text that is split at its marks; context: with what stands before and after them."""

    def step(state: Sql, part: Sql) -> Sql:
        i = state["i"]
        around = [F.right(F.get(parts, i - 1), CONTEXT).alias("before"), F.left(F.get(parts, i + 1), CONTEXT).alias("after")] if context else []
        found = F.struct(state["at"].alias("start"), part.alias("value"), *around)
        return F.struct((i + 1).alias("i"), (state["at"] + F.char_length(part)).alias("at"), F.when(i % 2 == 1, F.concat(state["found"], F.array(found))).otherwise(state["found"]).alias("found"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), none.alias("found")), step, lambda s: s["found"])


def _made(kind: str, s: Sql, value: Sql | None = None, start: Sql | None = None, confidence: Sql | None = None) -> Sql:
    value = s["value"] if value is None else value
    start = s["start"] if start is None else start
    d = CATALOG[kind]
    return F.struct(
        F.lit(kind).alias("type"), value.alias("value"), start.alias("start"), (start + F.char_length(value)).alias("end"),
        (F.lit(d.confidence) if confidence is None else confidence).alias("confidence"), F.lit(d.rank).alias("rank"), F.lit(ORDINALS[kind]).alias("ordinal"),
    )


def _trimmed(s: Sql) -> tuple[Sql, Sql]:
    """The value without white space at its ends, and its place."""
    left = F.char_length(s["value"]) - F.char_length(F.regexp_replace(s["value"], r"^\s+", ""))
    return F.regexp_replace(s["value"], r"^\s+|\s+$", ""), s["start"] + left


def _tr_phone(s: Sql) -> Sql:
    n = F.char_length(only_digits(s["value"]))
    left, right = F.char_length(F.regexp_extract(s["before"], "([0-9]*)$", 1)), F.char_length(F.regexp_extract(s["after"], "^([0-9]*)", 1))
    return n.between(10, 13) & (left + n + right <= 14)


def _us_phone(s: Sql) -> Sql:
    return F.rlike(only_digits(s["value"]), F.lit("^1?[0-9](?!11)[0-9]{9}$"))


def _intl_phone(s: Sql) -> Sql:
    return F.char_length(only_digits(s["value"])).between(7, 15)


def _bic(s: Sql) -> Sql:
    near = F.concat(F.right(s["before"], F.lit(24)), s["value"], F.left(s["after"], F.lit(24)))
    return V.is_valid_bic(s["value"]) & ((F.char_length(s["value"]) != 8) | F.rlike(near, F.lit("(?i)swift|bic|bank|rout")))


def _loose(s: Sql) -> Sql:
    """A loose value without the words without digits at its end."""
    return F.regexp_replace(F.regexp_replace(s["value"], r"[\s\"']+$", ""), r"(?: [^ 0-9]*)+$", "")


def _checked(kind: str, found: Sql) -> Sql:
    """The detections of a type among the spans of its pattern."""
    none = lambda s: F.lit(True)
    if kind in V.CHECKS and kind not in ("BTC_ADDRESS", "SWIFT_BIC", "FR_NIR", "CREDIT_CARD", "IBAN"):
        check = lambda s: V.CHECKS[kind](s["value"])
    else:
        check = {"TR_PHONE": _tr_phone, "US_PHONE": _us_phone, "INTL_PHONE": _intl_phone, "SWIFT_BIC": _bic, "BTC_ADDRESS": lambda s: V.is_valid_bech32(s["value"]) | V.is_base58_native(s["value"])}.get(kind, none)
    if kind in ("FR_NIR", "CREDIT_CARD"):
        return F.transform(F.filter(found, lambda s: V.CHECKS[kind](_trimmed(s)[0])), lambda s: _made(kind, s, *_trimmed(s)))
    if kind == "IBAN":
        return F.transform(F.filter(found, lambda s: V.is_valid_iban(s["value"])), lambda s: _made(kind, s))
    if kind == "GENERIC_API_KEY":
        varied = lambda v: F.size(F.array_distinct(F.split(v, ""))) / F.char_length(v) > 0.4
        return F.transform(found, lambda s: _made(kind, s, confidence=F.when(varied(s["value"]) | (F.char_length(s["value"]) >= 24), 0.75).otherwise(0.6)))
    if kind == "SWIFT_BIC":
        return F.transform(F.filter(found, check), lambda s: _made(kind, s, confidence=F.when(F.char_length(s["value"]) == 11, 1.0).otherwise(0.9)))
    if kind in ("SEDOL", "CN_ID", "SG_NRIC", "TW_ID", "HK_ID", "VIN", "US_DEA", "US_MBI"):
        return F.transform(F.filter(found, check), lambda s: _made(kind, s, F.upper(s["value"]), s["start"]))
    if kind == "PASSPORT":
        return _passports(found)
    if kind in ("DRIVERS_LICENSE", "HEALTH_INSURANCE_ID"):
        least = 5 if kind == "DRIVERS_LICENSE" else 6
        size = lambda v: F.char_length(F.regexp_replace(v, r"[\s\-]", "")).between(least, 20)
        fits = (lambda v: size(v) & F.rlike(v, F.lit("(?i)[A-Z]")) & F.rlike(v, F.lit("[0-9]"))) if kind == "DRIVERS_LICENSE" else size
        return F.transform(F.filter(found, lambda s: fits(_loose(s))), lambda s: _made(kind, s, _loose(s), s["start"]))
    return F.transform(F.filter(found, check), lambda s: _made(kind, s))


def _passports(found: Sql) -> Sql:
    """A P line with a valid line right after it, as one; a valid line of another kind by itself."""
    kind = "PASSPORT"

    def one(s: Sql, i: Sql) -> Sql:
        after = F.get(found, i + 1)
        pair = F.rlike(s["value"], F.lit("^P")) & F.coalesce((after["start"] == s["start"] + 45) & V.is_valid_mrz_line2(after["value"]), F.lit(False))
        before = F.get(found, i - 1)
        taken = F.coalesce(F.rlike(before["value"], F.lit("^P")) & (before["start"] + 45 == s["start"]), F.lit(False))
        alone = ~F.rlike(s["value"], F.lit("^P")) & V.is_valid_mrz_line2(s["value"]) & ~taken
        both = F.concat(s["value"], F.lit("\n"), after["value"])
        return F.when(pair, _made(kind, s, both, s["start"])).when(alone, _made(kind, s))

    return F.filter(F.transform(found, one), lambda x: x.isNotNull())


def _label_pattern(kind: str) -> str:
    """The pattern of a loose value, which may not hold a label word: a match that does is searched on from its next character."""
    words = X.LICENSE_LABELS if kind == "DRIVERS_LICENSE" else X.HEALTH_LABELS
    most = 19
    barred = rf"(?![A-Za-z0-9\- ]{{0,{most}}}(?<![A-Za-z0-9\-])(?iu:{'|'.join(words)})(?![A-Za-z0-9\-]))"
    return X.PATTERNS[kind].replace(")((?iu:[", f"){barred}((?iu:[", 1)


def resolve(found: Sql) -> Sql:
    """Of overlapping detections the best, in order of place."""

    def before(x: Sql, y: Sql) -> Sql:
        length = lambda d: d["end"] - d["start"]
        key = lambda d: F.struct(-d["confidence"], -d["rank"], -length(d), d["start"], d["ordinal"])
        return F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0)

    kept = lambda k, d: F.when(F.exists(k, lambda x: (d["start"] < x["end"]) & (d["end"] > x["start"])), k).otherwise(F.concat(k, F.array(d)))
    best = F.aggregate(F.array_sort(found, before), F.array().cast(f"array<{RANKED}>"), kept)
    by_place = F.array_sort(best, lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0))
    return F.transform(by_place, lambda d: F.struct(d["type"], d["value"], d["start"], d["end"], d["confidence"]))


def detect(text: Column, regions: str | Collection[str] = "ALL", types: Iterable[str] | None = None, rules: Iterable[CustomRule] = ()) -> Column:
    """The detections of each text: array of struct(type, value, start, end, confidence).

    types: only these of the regions' types. rules: further patterns, which rank last.
    """
    chosen = types_of(regions)
    if types is not None:
        wanted = {*types}
        if unknown := sorted(wanted - {*CATALOG}):
            raise ValueError(f"unknown types {', '.join(unknown)}")
        chosen = [t for t in chosen if t in wanted]
    named = normalize_regions(regions)
    rules = tuple(r for r in rules if "ALL" in named or r.region.upper() in named or r.region.upper() == "GLOBAL")
    return parsed(_detector(tuple(chosen), rules), PF.translate(PF.coalesce(text, PF.lit("")), OPEN + SHUT, SAFE))


@lru_cache(32)
def _detector(chosen: tuple[str, ...], rules: tuple[CustomRule, ...]) -> str:
    """The detections of a text without marks, as a lambda function in SQL; it depends on nothing else."""
    by_search: dict = {}
    for t in chosen:
        loose = t in ("DRIVERS_LICENSE", "HEALTH_INSURANCE_ID")
        by_search.setdefault((GATES[t], _label_pattern(t) if loose else X.PATTERNS[t]), []).append(t)

    def made(t: Sql, low: Sql, none: Sql, bare: Sql) -> Sql:
        """none: no detections. bare: no spans."""

        def search(pattern: str, kinds: list[str]) -> Sql:
            grouped = kinds[0] in ("GENERIC_API_KEY", "IMEI", "DRIVERS_LICENSE", "HEALTH_INSURANCE_ID")
            context = not _IN_CONTEXT.isdisjoint(kinds)
            every = lambda found: _joined([_checked(k, found) for k in kinds])
            some = lambda parts: let(_spans(parts, _no_spans(True) if context else bare, context), every)
            return let(_parts(t, pattern, grouped), lambda parts: F.when(F.size(parts) > 1, some(parts)).otherwise(none))

        def gated(wanted: list) -> list[Sql]:
            by_gate: dict = {}
            for gate, pattern in wanted:
                by_gate.setdefault(gate, []).append((gate, pattern))
            return [F.when(_passes(t, low, gate), _joined([search(p[1], by_search[p]) for p in ps])).otherwise(none) for gate, ps in by_gate.items()]

        def custom(i: int, r: CustomRule) -> Sql:
            confidence = min(1.0, max(0.01, float(r.confidence)))
            one = lambda s: F.struct(F.lit(r.id).alias("type"), s["value"].alias("value"), s["start"].alias("start"), (s["start"] + F.char_length(s["value"])).alias("end"), F.lit(confidence).alias("confidence"), F.lit(0).alias("rank"), F.lit(len(CATALOG) + i).alias("ordinal"))
            return let(_parts(t, r.pattern, False), lambda parts: F.transform(_spans(parts, bare, False), one))

        parts, left = [custom(i, r) for i, r in enumerate(rules)], list(by_search)
        for bound, kinds in ((SIX_DIGITS, _NEED_SIX), (DIGITS, _NEED_DIGIT)):
            own = [k for k in left if all(x in kinds for x in by_search[k])]
            left = [k for k in left if k not in own]
            if own:
                parts.append(F.when(F.rlike(t, bound), _joined(gated(own))).otherwise(none))
        return _joined([*parts, *gated(left)]) if parts or left else none

    def whole(t: Sql, low: Sql) -> Sql:
        found = let(F.array().cast(f"array<{RANKED}>"), lambda none: let(_no_spans(False), lambda bare: made(t, low, none, bare)))
        return let(found, lambda found: F.when(F.size(found) > 0, resolve(found)).otherwise(F.array().cast(f"array<{DETECTION}>")))

    # case-blind patterns also match two letters that have no lower case of their own
    return lambda_text(lambda t: let(F.translate(F.lower(t), "ıſ", "is"), lambda low: whole(t, low)))


def _joined(parts: list[Sql]) -> Sql:
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def add_entities(frame, recognizer, text: str = "text", detections: str = "detections"):
    """Adds to the detections what a recognizer of names finds beside them, in order of place.

    recognizer: from a list of texts to a list, for each, of (type, start, end, confidence); it runs
    on batches in Python workers. Without one (None) nothing is added. Entities rank last: those that
    overlap a detection are left out.
    """
    if recognizer is None:
        return frame
    import pyarrow as pa
    from pyspark.sql import types as T

    kind = pa.list_(pa.struct([("type", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))
    schema = T.StructType([f if f.name != detections else T.StructField(detections, T._parse_datatype_string(f"array<{DETECTION}>")) for f in frame.schema.fields])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(detections)
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            rows = []
            for t, known, names in zip(texts, batch.column(at).to_pylist(), recognizer(texts), strict=True):
                kept = list(known or ())
                for name, start, end, confidence in sorted(names, key=lambda n: (-n[3], n[1])):
                    if all(end <= d["start"] or start >= d["end"] for d in kept):
                        kept.append({"type": name, "value": t[start:end], "start": start, "end": end, "confidence": float(confidence)})
                rows.append(sorted(kept, key=lambda d: d["start"]))
            columns = [batch.column(i) if i != at else pa.array(rows, type=kind) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return frame.mapInArrow(run, schema)


def catalog_frame(spark):
    """The detectors as a small table."""
    rows = [(d.type, d.region, d.severity, d.rank, list(d.compliance), d.confidence) for d in CATALOG.values()]
    return spark.createDataFrame(rows, "type string, region string, severity double, rank int, compliance array<string>, confidence double")


def detector_catalog(spark):
    """type, description, region, compliance, severity, confidence of all detectors, by type, as the service lists them.

    The listed confidence of a type that a check confirms is the general one; catalog_frame() has each one's own.
    """
    listed = lambda d: (X.DESCRIPTIONS[d.type], d.confidence) if d.type in X.DESCRIPTIONS else (f"{d.type} (checksum-validated)", X.LISTED_CONFIDENCE)
    rows = [(d.type, listed(d)[0], d.region, list(d.compliance), d.severity, listed(d)[1]) for d in sorted(CATALOG.values(), key=lambda d: d.type)]
    return spark.createDataFrame(rows, "type string, description string, region string, compliance array<string>, severity double, confidence double")


def register(spark) -> list[str]:
    """Makes the detector and the checks functions of the session's SQL: detect_values(text) and is_valid_*(value)."""
    from veilwright.functions.sqltext import lambda_text

    clean = f"translate(coalesce(v, ''), '{OPEN}{SHUT}', '{SAFE}')"
    made = {"detect_values": (f"array<{DETECTION}>", f"get(transform(array({clean}), {_detector(tuple(CATALOG), ())}), 0)")}
    for name, f in vars(V).items():
        if name.startswith("is_valid_") and name != "is_valid_btc":
            made[name] = ("boolean", f"get(transform(array(v), {lambda_text(lambda x, f=f: f(x))}), 0)")
    for name, (kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS {kind} RETURN {body}")
    return sorted(made)


_JAVA_ONLY = re.compile(r"\(\?P")


def check_rule(rule: CustomRule) -> None:
    """An error unless the rule is complete and its pattern is one."""
    if not rule.id or not rule.pattern:
        raise ValueError("a rule needs an id and a pattern")
    if not 0 < rule.confidence <= 1:
        raise ValueError(f"{rule.id}: the confidence must be over 0 and at most 1")
    if rule.region.upper() not in {*X.REGIONS, "GLOBAL"}:
        raise ValueError(f"{rule.id}: unknown region {rule.region}")
    if _JAVA_ONLY.search(rule.pattern):
        raise ValueError(f"{rule.id}: named groups are written (?<name>...)")
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile(rule.pattern)
    except Exception as e:
        raise ValueError(f"{rule.id}: {str(e).splitlines()[0]}") from None
