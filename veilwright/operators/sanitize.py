"""Taking values out of texts: masks, redaction, keyed hashes, pseudonyms, tokens, format-preserving shifts, noise.

sanitize() rebuilds a text from its detections; sanitize_value() treats a whole value. Null texts
stay null. Salts and keys are constants of one job: draw a salt once, with new_salt(). They stand
in the plan, so keep plans out of logs or set spark.sql.redaction.string.regex.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions import fixed as X

MODES = ("mask", "redact", "hash", "pseudonymize", "vault", "fpe", "noise")
MASK_OF = {t: m for m, ts in X.MASKS.items() for t in ts}
PREFIX_OF = {t: p for p, ts in X.PREFIXES.items() for t in ts}
BLOCK = 64
#: Bytes of a block of the stream of fpe().
STREAM_BLOCK = 32


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once wherever `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def new_salt(size: int = 16) -> str:
    return secrets.token_hex(size)


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(n, F.lit(0)))


def mask_middle(v: Column, first: int = 1, last: int = 1) -> Column:
    n = F.char_length(v)
    return F.when(n <= first + last, stars(n)).otherwise(F.concat(F.left(v, F.lit(first)), stars(n - first - last), F.right(v, F.lit(last))))


def mask_generic(v: Column) -> Column:
    return mask_middle(v)


def mask_email(v: Column) -> Column:
    local, domain = F.substring_index(v, "@", 1), F.regexp_extract(v, "(?s)@(.*)$", 1)
    label = F.substring_index(domain, ".", 1)
    rest = F.regexp_extract(domain, r"(?s)(\..*)$", 1)
    # a label alone is masked like one with more after it, except an empty one
    head = F.when(F.char_length(local) > 2, mask_middle(local)).otherwise(stars(F.char_length(local)))
    return F.when(F.contains(v, F.lit("@")), F.concat(head, F.lit("@"), mask_middle(label, 1, 0), rest)).otherwise(mask_generic(v))


def _all_but(v: Column, kept: int) -> Column:
    """All digits but the last ones are masked; with no more than those, everything is."""
    few = F.char_length(_digits(v)) <= kept
    return F.when(few, stars(F.char_length(v))).otherwise(F.regexp_replace(v, rf"[0-9](?=(?:[^0-9]*[0-9]){{{kept}}})", "*"))


def mask_phone(v: Column) -> Column:
    return _all_but(v, 2)


def mask_credit_card(v: Column) -> Column:
    return _all_but(v, 4)


def mask_tr_national_id(v: Column) -> Column:
    d = _digits(v)
    return F.when(F.length(d) == 11, F.concat(F.left(d, F.lit(2)), F.lit("*" * 8), F.right(d, F.lit(1)))).otherwise(mask_generic(v))


def mask_ip(v: Column) -> Column:
    return (
        F.when(F.rlike(v, F.lit(r"^[^.:]*(?:\.[^.:]*){3}$")), F.concat(F.regexp_replace(v, r"\.[^.]*$", ""), F.lit(".***")))
        .when(F.contains(v, F.lit(":")), F.regexp_replace(F.regexp_replace(v, "(?s):[^:]*$", ":****"), "^:([*]{4})$", "$1"))
        .otherwise(mask_generic(v))
    )


def mask_jwt(v: Column) -> Column:
    return F.when(F.size(F.split(v, r"\.")) >= 3, F.concat(F.substring_index(v, ".", 1), F.lit("." + "*" * 8 + "." + "*" * 8))).otherwise(mask_generic(v))


def mask_api_key(v: Column) -> Column:
    n = F.char_length(v)
    return F.when(n <= 8, stars(n)).when(F.rlike(v, F.lit("^(?:AKIA|ASIA|ABIA|ACCA)")), F.concat(F.left(v, F.lit(4)), stars(n - 4))).otherwise(mask_middle(v, 2, 4))


def mask_generic_id(v: Column) -> Column:
    few = F.char_length(F.regexp_replace(v, r"(?U)\W", "")) < 4
    return F.when(few, mask_generic(v)).otherwise(F.concat(F.left(v, F.lit(2)), stars(F.char_length(v) - 3), F.right(v, F.lit(1))))


def mask_secret(v: Column, first: int = 4, last: int = 2) -> Column:
    return mask_middle(F.regexp_replace(v, r"^\s+|\s+$", ""), first, last)


def mask_url_secret(v: Column) -> Column:
    login = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/@\s]*:)([^@\s]+)(@.*)$"
    host = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/\s?]+)([/?.].*)$"
    part = lambda i: F.regexp_extract(v, login, i)
    return (
        F.when(F.rlike(v, F.lit(login)), F.concat(part(1), stars(F.greatest(F.char_length(part(2)), F.lit(4))), part(3)))
        .when(F.rlike(v, F.lit(host)), F.regexp_extract(v, host, 1))
        .otherwise(mask_secret(v, 8, 0))
    )


def mask_mac(v: Column) -> Column:
    one = lambda sep: F.when(F.size(F.split(v, sep)) == 6, F.concat(F.substring_index(v, sep, 3), F.lit(f"{sep}**" * 3))).otherwise(mask_generic(v))
    return F.when(F.contains(v, F.lit(":")), one(":")).otherwise(one("-"))


def mask_geo(v: Column) -> Column:
    shape = r"^\s*([+-]?[0-9]+\.[0-9]+)\s*([,;])\s*([+-]?[0-9]+\.[0-9]+)\s*$"
    # the exact binary value decides a half, as printing with one decimal does
    near = lambda i: F.bround(F.regexp_extract(v, shape, i).cast("double").cast("decimal(38,30)"), 1).cast("decimal(8,1)").cast("string")
    return F.when(F.rlike(v, F.lit(shape)), F.concat(near(1), F.regexp_extract(v, shape, 2), F.lit(" "), near(3))).otherwise(mask_generic(v))


MASKERS = {
    "email": mask_email, "phone": mask_phone, "credit_card": mask_credit_card, "tr_national_id": mask_tr_national_id, "ip": mask_ip, "jwt": mask_jwt, "api_key": mask_api_key, "generic_id": mask_generic_id, "secret": mask_secret,
    "url_secret": mask_url_secret, "mac": mask_mac, "geo": mask_geo,
}


def mask_value(v: Column, kind: Column | str) -> Column:
    """The mask of the value's type."""
    if isinstance(kind, str):
        return MASKERS.get(MASK_OF.get(kind.upper(), ""), mask_generic)(v)
    out = None
    for name, f in MASKERS.items():
        types = [t for t, m in MASK_OF.items() if m == name]
        out = F.when(F.upper(kind).isin(*types), f(v)) if out is None else out.when(F.upper(kind).isin(*types), f(v))
    return out.otherwise(mask_generic(v))


def hmac_sha256(v: Column, key: str | bytes) -> Column:
    """The keyed hash in hex, from two plain hashes; the padded keys are constants."""
    raw = key.encode() if isinstance(key, str) else key
    raw = (hashlib.sha256(raw).digest() if len(raw) > BLOCK else raw).ljust(BLOCK, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in raw))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(v, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def hash_value(v: Column, salt: str, length: int = 16) -> Column:
    return F.left(hmac_sha256(v, salt), F.lit(length))


def prefix(kind: Column | str) -> Column:
    if isinstance(kind, str):
        return F.lit(PREFIX_OF.get(kind.upper(), "PII"))
    pairs = F.create_map(*(F.lit(x) for pair in PREFIX_OF.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, F.upper(kind)), F.lit("PII"))


def pseudonymize(v: Column, kind: Column | str, salt: str) -> Column:
    return F.concat(prefix(kind), F.lit("_"), F.left(hmac_sha256(v, salt), F.lit(8)))


def pseudonym_map(found: DataFrame, salt: str, detections: str = "detections") -> DataFrame:
    """value, type, token of each value that was found; of a value under several types the least."""
    rows = found.select(F.explode(detections).alias("d")).groupBy(F.col("d.value").alias("value")).agg(F.min("d.type").alias("type"))
    return rows.withColumn("token", pseudonymize(F.col("value"), F.col("type"), salt))


def vault_token(v: Column, kind: Column | str, salt: str) -> Column:
    return F.concat(prefix(kind), F.lit("_"), F.left(hmac_sha256(v, salt), F.lit(12)))


def keystream(key: str, tweak: str, size: int) -> bytes:
    """Bytes that depend on key, tweak and place alone."""
    secret, out, i = hashlib.sha256(key.encode()).digest(), b"", 0
    while len(out) < size:
        out += hmac.new(secret, f"{tweak}:{i}".encode(), hashlib.sha256).digest()
        i += 1
    return out[:size]


def fpe(v: Column, key: str, tweak: str, decrypt: bool = False, longest: int = 512) -> Column:
    """Digits and ASCII letters shifted within their kind by the stream of key and tweak; all else stays.

    The stream of the first `longest` characters (in whole blocks) is in the plan; longer values have the rest computed.
    """
    first_blocks = -(-longest // STREAM_BLOCK)
    held = first_blocks * STREAM_BLOCK
    stream = F.array(*(F.lit(b) for b in keystream(key, tweak, held)))
    secret = hashlib.sha256(key.encode()).digest()
    sign = -1 if decrypt else 1
    n = F.char_length(v)
    numbers = F.sequence(F.lit(first_blocks), F.floor((n - 1) / STREAM_BLOCK).cast("int"))
    more = F.when(n > held, F.transform(numbers, lambda b: hmac_sha256(F.concat(F.lit(f"{tweak}:"), b.cast("string")), secret))).otherwise(F.array().cast("array<string>"))

    def shifted(c: Column, i: Column, more: Column) -> Column:
        block = F.get(more, F.floor(i / STREAM_BLOCK).cast("int") - first_blocks)
        later = F.conv(F.substring(block, i % STREAM_BLOCK * 2 + 1, F.lit(2)), 16, 10).cast("int")
        r = F.when(i < held, F.get(stream, i)).otherwise(later) * sign
        turn = lambda first, size: F.chr(F.pmod(F.ascii(c) - first + r, F.lit(size)) + first)
        return F.when(F.rlike(c, F.lit("^[0-9]$")), turn(48, 10)).when(F.rlike(c, F.lit("^[a-z]$")), turn(97, 26)).when(F.rlike(c, F.lit("^[A-Z]$")), turn(65, 26)).otherwise(c)

    return let(more, lambda m: F.array_join(F.transform(F.split(v, ""), lambda c, i: shifted(c, i, m)), ""))


def laplace_noise(v: Column, epsilon: float, sensitivity: float = 1.0, u: Column | None = None, seed: int | None = None) -> Column:
    """v and Laplace noise of scale sensitivity / epsilon. u: uniform in [-0.5, 0.5); drawn if not given."""
    if epsilon <= 0:
        raise ValueError("epsilon must be over 0")
    u = F.rand(seed) - 0.5 if u is None else u
    sign = F.when(u < 0, -1.0).otherwise(1.0)
    return v - F.lit(sensitivity / epsilon) * sign * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-12)))


def gaussian_noise(v: Column, sigma: float, seed: int | None = None) -> Column:
    return v + sigma * F.randn(seed)


def sanitize_numeric(v: Column, epsilon: float = 1.0, sensitivity: float = 1.0, mechanism: str = "laplace", seed: int | None = None) -> Column:
    if mechanism == "laplace":
        return laplace_noise(v, epsilon, sensitivity, seed=seed)
    if mechanism == "gaussian":
        return gaussian_noise(v, sensitivity, seed)
    raise ValueError(f"unknown mechanism {mechanism!r}")


def _check_mode(mode: str, salt: str | None) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; there are {', '.join(MODES)}")
    if mode in ("hash", "pseudonymize", "vault", "fpe") and not salt:
        raise ValueError(f"{mode} needs a salt")


def sanitize_value(v: Column, kind: Column | str, mode: str = "mask", salt: str | None = None, replacement: str = "[REDACTED]") -> Column:
    """One value as a whole."""
    _check_mode(mode, salt)
    if mode == "noise":
        raise ValueError("noise is for numbers")
    if mode == "mask":
        return mask_value(v, kind)
    if mode == "redact":
        return F.when(v.isNotNull(), F.lit(replacement))
    if mode == "hash":
        return hash_value(v, salt)
    if mode == "pseudonymize":
        return pseudonymize(v, kind, salt)
    if mode == "vault":
        return vault_token(v, kind, salt)
    if isinstance(kind, str):
        return fpe(v, salt, kind)
    out = None
    for t in PREFIX_OF:
        out = F.when(kind == t, fpe(v, salt, t)) if out is None else out.when(kind == t, fpe(v, salt, t))
    return out.otherwise(fpe(v, salt, "PII"))


def sanitize(text: Column, detections: Column, mode: str = "mask", salt: str | None = None, replacement: str = "[REDACTED]", types: list[str] | None = None) -> Column:
    """The text with each detection replaced; detections are disjoint and in order of place, as detect() gives them.

    Where one value is found under two types, the modes with types in their result take that of
    its last place. noise masks, as texts hold no numbers to change. types: all that can occur,
    which keeps the plan of fpe small.
    """
    _check_mode(mode, salt)
    mode = "mask" if mode == "noise" else mode

    def surrogate(raw: Column, d: Column, all_: Column) -> Column:
        if mode in ("mask", "redact", "hash"):
            return sanitize_value(raw, d["type"], mode, salt, replacement)
        same = F.filter(all_, lambda x: x["value"] == d["value"])
        kind = F.element_at(same, -1)["type"]
        if mode == "fpe" and types is not None:
            out = F.lit(None).cast("string")
            for t in types:
                out = F.when(kind == t, fpe(raw, salt, t)).otherwise(out)
            return out
        return sanitize_value(raw, kind, mode, salt, replacement)

    def built(t: Column, all_: Column) -> Column:
        def step(state: Column, d: Column) -> Column:
            gap = F.substring(t, state["at"] + 1, d["start"] - state["at"])
            raw = F.substring(t, d["start"] + 1, d["end"] - d["start"])
            return F.struct(d["end"].alias("at"), F.concat(state["out"], gap, surrogate(raw, d, all_)).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(all_, start, step, lambda s: F.concat(s["out"], F.substring(t, s["at"] + 1, F.char_length(t))))

    return F.when(F.size(detections) > 0, let(text, lambda t: let(detections, lambda all_: built(t, all_)))).otherwise(text)


def redact_text(text: Column, detections: Column, replacement: str = "[REDACTED]") -> Column:
    return sanitize(text, detections, "redact", replacement=replacement)


def mask_text(text: Column, detections: Column) -> Column:
    return sanitize(text, detections, "mask")
